"""Junction algebra, motif pairs and sampled sequences against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import junctions, simulate


def expanded(cigar):
    return "".join(op * int(n) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar))


def packed(ops):
    return "".join(f"{len(m[0])}{m[1]}" for m in re.finditer(r"(.)\1*", ops))


def brute_gap(cigar, before, size):
    """Letter by letter: the gap comes before the letter that covers the reference base behind the first ``before``."""
    ops, at, out = expanded(cigar), 0, ""
    for k, c in enumerate(ops):
        if c in "MDN=X":
            if at == before and before > 0:
                out += "N" * size
            at += 1
        out += c
    return packed(out) if 0 < before < sum(c in "MDN=X" for c in ops) else packed(ops)


def test_junctions_on_genome(spark):
    rng = random.Random(5)
    reads, frames = [], []
    for k in range(300):
        cigar = "".join(f"{rng.randrange(0, 9)}{rng.choice('MMMIDS=X')}" for _ in range(rng.randrange(1, 7)))
        flank, pos, intron = rng.randrange(1, 30), rng.randrange(1, 40), rng.randrange(1, 500)
        reads.append((k, f"j{k}", pos, cigar, "x"))
        frames.append((f"j{k}", f"c{k % 3}", rng.randrange(1, 10_000), flank, intron))
    reads += [(900, "j1", 0, "5M", "x"), (901, "j1", 3, "*", "x"), (902, "none", 3, "5M", "x"), (903, None, 3, "5M", "x"), (904, "j1", None, "5M", "x")]
    sam = spark.createDataFrame(reads, "id int, rname string, pos bigint, cigar string, seq string")
    table = spark.createDataFrame(frames, "junction string, seq string, start bigint, flank bigint, intron bigint")
    want = {}
    for (k, _, pos, cigar, _), (_, seq, start, flank, intron) in zip(reads, frames, strict=False):
        before, span = flank - pos + 1, sum(c in "MDN=X" for c in expanded(cigar))
        want[k] = (seq, start + pos - 1 + (0 if before > 0 else intron), brute_gap(cigar, before, intron), 0 < before < span)
    every = {r.id: (r.rname, r.pos, r.cigar) for r in junctions.junctions_on_genome(sam, table, only_spliced=False).collect()}
    assert every == {k: v[:3] for k, v in want.items()}
    got = junctions.junctions_on_genome(sam, table)
    assert got.columns == sam.columns and {r.id for r in got.collect()} == {k for k, v in want.items() if v[3]} and got.count() > 50
    assert junctions.junctions_on_genome(sam.where("false"), table).count() == 0


@pytest.mark.parametrize("shortest, longest", [(0, 60), (5, 5), (-20, 30), (0, 100_000)])
def test_motif_pairs(spark, shortest, longest):
    rng = random.Random(longest)
    motifs = [(f"c{rng.randrange(2)}", rng.randrange(1, 400), rng.random() < 0.5, 1) for _ in range(250)] + [("c0", 7, True, 1), ("c0", 7, True, 1), ("c0", None, True, 1)]
    spots = [(k, f"c{k % 2}", a, a + rng.randrange(60), b, b + rng.randrange(60), 1) for k in range(12) for a, b in [(rng.randrange(300), rng.randrange(300))]]
    got = sorted(tuple(r) for r in junctions.motif_pairs(spark.createDataFrame(spots, "spot bigint, seq string, left_start bigint, left_end bigint, right_start bigint, right_end bigint, pos int"), spark.createDataFrame(motifs, "seq string, pos bigint, opening boolean, spot int"), longest, shortest, 64).select("spot", "seq", "start", "end").collect())
    points = {m[:3] for m in motifs if m[1] is not None}
    want = [(k, c, i, j) for k, c, a, b, x, y, _ in spots for s, i, o in points for t, j, p in points if s == t == c and o and not p and a <= i <= b and x <= j <= y and shortest <= j - i <= longest]
    assert got == sorted(want)


def test_sampled_cds_is_the_same_under_any_partitioning(spark):
    rng = np.random.default_rng(3)
    model = rng.dirichlet(np.ones(4), (3, 4**2)) * (rng.random((3, 16, 4)) < 0.8)
    rows = spark.range(400).select("id", (F.col("id") % 50).alias("n_codons"), F.lit("x").alias("bases"))
    odd = spark.createDataFrame([(None, 3, "x"), (5000, None, "x"), (5001, -4, "x")], "id bigint, n_codons bigint, bases string")
    rows = rows.unionByName(odd)
    one, many = (sorted((r.id if r.id is not None else -1, r.bases) for r in simulate.sampled_cds(rows.repartition(n), model, seed=9).collect()) for n in (1, 16))
    assert one == many and len(one) == 403
    by = dict(one)
    assert all(len(by[i]) == 2 + 3 * (i % 50) for i in range(400)) and len(by[5000]) == len(by[5001]) == 2
    assert not any(s[i : i + 3] in simulate.STOPS for s in by.values() for i in range(2, len(s), 3))
    assert sorted(r.bases for r in simulate.sampled_cds(rows, model, seed=10).collect()) != sorted(by.values())


def test_sampled_shares_are_those_of_the_model(spark):
    model = np.random.default_rng(4).dirichlet(np.full(4, 2.0), (3, 4**3))
    texts = [r.bases for r in simulate.sampled_cds(spark.range(4000).select("id", F.lit(40).alias("n_codons")), model).collect()]
    seen = np.zeros((3, 64, 4))
    for s in texts:
        x = ["acgt".index(c) for c in s]
        for i in range(3, len(x)):
            seen[(i - 3) % 3, 16 * x[i - 3] + 4 * x[i - 2] + x[i - 1], x[i]] += 1
    want = model.copy()
    want[2][simulate.stop_contexts(3)] = 0
    want /= want.sum(axis=2, keepdims=True)
    often = seen.sum(axis=2) > 1000
    assert often.mean() > 0.9
    assert np.abs(seen / seen.sum(axis=2, keepdims=True) - want)[often].max() < 0.06
    first = np.bincount([4 * "acgt".index(s[0]) + "acgt".index(s[1]) for s in texts], minlength=16) / len(texts)
    assert np.abs(first - 1 / 16).max() < 0.02


def test_a_model_is_learned_and_checked(spark):
    model = simulate.codon_model(["ATGAAACCC", "atgnnnccc"], 2, 0.0)
    assert model.sum() == 9 and model[2, 3, 2] == 2
    with pytest.raises(ValueError):
        simulate.sampled_cds(spark.range(1), np.ones((3, 4, 4)))


def test_motif_places(spark):
    """Each place of a motif, overlapping ones and those behind wide letters too, and none over a text's end."""
    rng = random.Random(5)
    texts = {k: "".join(rng.choice("actgé") for _ in range(rng.randrange(0, 90))) for k in range(60)} | {60: "aaa", 61: "c", 62: "t", 63: None}
    places = junctions.motif_places(spark.createDataFrame(list(texts.items()), "seq bigint, bases string"), ("ct", "aa", "t"))
    got = sorted(tuple(r) for r in places.collect())
    assert got == sorted((k, i + 1, j) for k, x in texts.items() for j, m in enumerate(("ct", "aa", "t")) for i in range(len(x or "")) if x[i : i + len(m)] == m)


def test_splice_candidates_keep_the_motifs_strand(spark):
    jumps = spark.createDataFrame([(1, "c", 1, 10, ".", 11, 20, "."), (2, "c", 1, 10, "+", 11, 20, "-"), (3, "c", 1, 10, "-", 11, 20, ".")], "spot bigint, seq string, start bigint, end bigint, strand string, start_next bigint, end_next bigint, strand_next string")
    motifs = spark.createDataFrame([("c", 3, True, "+"), ("c", 12, False, "+"), ("c", 4, True, "-"), ("c", 13, False, "-")], "seq string, pos bigint, opening boolean, strand string")
    got = sorted(tuple(r) for r in junctions.splice_candidates(jumps, motifs, 2, 50, 16).select("spot", "start", "end", "strand", "sign").collect())
    assert got == [(1, 3, 12, ".", "+"), (1, 4, 13, ".", "-"), (3, 4, 13, ".", "-")]
