"""Operators without SQL of their own, each against a plain version."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from locusframe.functions import scores as S
from locusframe.functions.sequence import tempered
from locusframe.operators import alignments, decode, genes, msa, phylo, signals, training
from locusframe.sources.readers import parse_newick


def test_gene_clusters(spark):
    rng = random.Random(1)
    rows = [(t, f"c{t % 2}", rng.choice("+-") if t % 9 == 0 else "+", s, s + rng.randrange(5, 40), rng.randrange(3)) for t in range(60) for s in [rng.randrange(600) for _ in range(rng.randrange(1, 4))]]
    got = {r.tid: r.gene for r in genes.gene_clusters(spark.createDataFrame(rows, "tid bigint, seq string, strand string, start bigint, end bigint, frame int"), 64).collect()}
    label = {t: t for t in range(60)}
    while True:
        before = dict(label)
        for a in rows:
            for b in rows:
                if a[1:3] == b[1:3] and (a[3] - a[5]) % 3 == (b[3] - b[5]) % 3 and a[3] <= b[4] and b[3] <= a[4]:
                    label[a[0]] = label[b[0]] = min(label[a[0]], label[b[0]])
        if label == before:
            break
    assert got == label and 5 < len(set(label.values())) < 60


def brute_block_hints(blocks):
    by = defaultdict(list)
    for b in blocks:
        by[b[0]].append(b)
    out = []
    for own in by.values():
        own.sort(key=lambda b: (b[2], b[3]))
        exons, bad = [], False
        for prev, b in zip([None, *own], own, strict=False):
            gap = None if prev is None else b[2] - prev[3] - 1
            if prev is None or alignments.INTRON_LEAST <= gap <= alignments.INTRON_MOST:
                exons.append([b[2], b[3], b[4], None if prev is None else prev[5]])
            else:
                bad |= gap > alignments.BLOCK_GAP
                exons[-1][1] = max(exons[-1][1], b[3])
        if bad:
            continue
        aid, seq = own[0][:2]
        for k, (s, e, q, qp) in enumerate(exons):
            last = k + 1 == len(exons)
            if k:
                size = lambda x: x[1] - x[0] + 1
                if q - qp - 1 <= alignments.QUERY_GAP and (k > 1 or size(exons[k - 1]) >= alignments.END_BLOCK) and (not last or size(exons[k]) >= alignments.END_BLOCK):
                    out.append((aid, seq, "intron", exons[k - 1][1] + 1, s - 1))
            a, z = s + (0 if k else alignments.END_TRIM), e - (alignments.END_TRIM if last else 0)
            if a <= z:
                out.append((aid, seq, "exonpart", a, z))
    return sorted(out)


def test_block_hints(spark):
    rng = random.Random(2)
    blocks = []
    for aid in range(150):
        at = q = 1
        for _ in range(rng.randrange(1, 7)):
            n = rng.choice([3, 7, 8, 25, 60])
            blocks.append((aid, f"c{aid % 3}", at, at + n - 1, q, q + n - 1, 1))
            at += n + rng.choice([0, 3, 14, 32, 100, 400] + [20, 400_000] * (aid % 5 == 0))
            q += n + rng.choice([0, 0, 5, 6])
    frame = spark.createDataFrame(blocks, "aid bigint, seq string, start bigint, end bigint, q_start bigint, q_end bigint, type int").drop("type")
    want = brute_block_hints([b[:6] for b in blocks])
    assert sorted(tuple(r) for r in alignments.block_hints(frame).collect()) == want
    assert sorted(tuple(r) for r in alignments.block_hints(frame, introns_only=True).collect()) == [w for w in want if w[2] == "intron"]
    assert {w[2] for w in want} == {"intron", "exonpart"}


def test_packed_chunks(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(1, 9)) for k in range(100)]
    got = {r.cluster: r.chunk for r in genes.packed_chunks(spark.createDataFrame(rows, "cluster bigint, n bigint"), 20).collect()}
    total, want = 0, {}
    for k, n in rows:
        want[k] = total // 20
        total += n
    assert got == want


def test_joined_neighbours(spark):
    rng = random.Random(4)
    rows = []
    for ref in ("r1", "r2"):
        at = defaultdict(int)
        for b in range(60):
            own = {}
            for s in rng.sample("abcd", rng.randrange(0, 4)):
                at[s] += rng.choice([0, 3, 9, 10])
                own[s] = (rng.choice(["c", "c", "c", "d"]), "+", at[s], at[s] + 5)
                at[s] += 5
            rows.append((ref, b * 10, b, own))
    kind = "ref string, ref_start bigint, block bigint, rows map<string, struct<seq:string,strand:string,start:bigint,end:bigint>>"
    got = {(r.ref, r.block): r.joined for r in msa.joined_neighbours(spark.createDataFrame(rows, kind)).collect()}
    for ref in ("r1", "r2"):
        number, prev = 0, None
        for _, _, b, own in (r for r in rows if r[0] == ref):
            shared = own.keys() & prev.keys() if prev is not None else set()
            if not shared or not all(prev[s][:2] == own[s][:2] and 0 <= own[s][2] - prev[s][3] <= 9 for s in shared):
                number += 1
            assert got[ref, b] == number
            prev = own
    assert len(set(got.values())) > 5


def test_folds_and_best_parameters(spark):
    rows = spark.range(5000).select((F.col("id") % 1000).alias("key"))
    one, many = (training.folds(rows.repartition(n), 5, "key", 3).distinct().collect() for n in (1, 8))
    assert sorted(one) == sorted(many) and len(one) == 1000
    sizes = np.bincount([r.fold for r in one])
    assert len(sizes) == 5 and sizes.min() > 150
    assert sorted(training.folds(rows, 5, "key", 4).distinct().collect()) != sorted(one)
    scores = [("a", 0, 0.5), ("a", 1, 0.7), ("b", 0, 0.9), ("b", 1, 0.3), ("c", 0, 0.6), ("c", 1, 0.6)]
    best = training.best_parameters(spark.createDataFrame(scores, "parameters string, fold int, score double")).collect()
    assert [(r.parameters, round(r["mean"], 9), r.folds) for r in best] == [("a", 0.6, 2)]


def test_first_empty_and_functions(spark):
    rows = [("t", 3, 1.0), ("t", 1, 2.0), ("t", 5, 0.0), ("t", 9, 0.0), ("u", 1, 0.0), ("v", 1, 4.0)]
    assert {(r.tid, r["at"]) for r in signals.first_empty(spark.createDataFrame(rows, "tid string, pos bigint, value double")).collect()} == {("t", 5), ("u", 1)}
    got = spark.range(1).select(S.floor_mod(F.lit(-7), 3).alias("a"), S.floor_mod(F.lit(7), 3).alias("b"), S.part_penalty(F.lit(0.5), F.lit(3)).alias("c"), tempered(F.lit(0.25), 4.0).alias("d"), tempered(F.lit(0.25), 0.0).alias("e")).first()
    assert tuple(got) == (2, 1, 0.125, 0.5, 0.25)


def test_transcripts_of(spark):
    segs = [("s", 1, 10, "n"), ("s", 11, 20, "e"), ("s", 21, 25, "i"), ("s", 26, 30, "e"), ("s", 31, 40, "n"), ("s", 41, 50, "e"), ("t", 1, 5, "e"), ("t", 6, 9, "x")]
    frame = spark.createDataFrame(segs, "seq string, begin bigint, end bigint, state string")
    got = sorted(tuple(r) for r in decode.transcripts_of(frame, "n", {"e": "CDS", "i": "intron"}).collect())
    assert got == [("s", 1, "CDS", 11, 20), ("s", 1, "CDS", 26, 30), ("s", 1, "intron", 21, 25), ("s", 2, "CDS", 41, 50), ("t", 0, "CDS", 1, 5)]


def test_omega_prefixes_are_running_sums(spark):
    rng = random.Random(6)
    tree = parse_newick("(a:0.3,b:0.5);")
    rows = [(bits, f, i, ",".join(rng.choice(["ATG", "ATA", "---", "CCC"]) for _ in range(2))) for bits in (1, 2) for f in range(2) for i in range(12)]
    frame = spark.createDataFrame(rows, "bits bigint, frame int, i int, pattern string")
    each = {r.pattern: np.array(r.loglik) for r in phylo.column_scores(frame, tree).collect()}
    got = {(r.bits, r.frame, r.i): np.array(r.total) for r in phylo.omega_prefixes(frame, tree).collect()}
    for bits, f, i, _ in rows:
        want = sum(each[p] for b, g, j, p in rows if (b, g) == (bits, f) and j <= i)
        assert np.allclose(got[bits, f, i], want)


def test_content_clusters_tell_compositions_apart(spark):
    rng = random.Random(7)
    rows = []
    for k in range(40):
        letters = "ACGT" if k % 2 else "AATTTACG"
        text = "".join(rng.choice(letters) for _ in range(400))
        counts = defaultdict(int)
        for i in range(399):
            counts[text[i : i + 2]] += 1
        rows += [(k, w, n) for w, n in counts.items()]
    got = {r.seq: (r.cluster, r.prob) for r in training.content_clusters(spark.createDataFrame(rows, "seq bigint, kmer string, n bigint"), 2, rounds=8).collect()}
    odd, even = {got[k][0] for k in range(1, 40, 2)}, {got[k][0] for k in range(0, 40, 2)}
    assert len(odd) == len(even) == 1 and odd != even and min(p for _, p in got.values()) > 0.9


def test_gene_clusters_take_one_link_of_each_exon(spark, monkeypatch):
    """A deep stack of exons has as many links as exons, not a pair for each two."""
    rng = random.Random(4)
    rows = [(t, "c", "+", s, s + rng.randrange(1, 300), 0) for t in range(400) for s in [3 * rng.randrange(30)]] + [(t, "c", "+", 3000 + 9 * t, 3005 + 9 * t, 0) for t in range(400, 440)] + [(7, "c", "+", 9000, 9005, 0), (430, "c", "+", 9004, 9002, 2), (439, "c", "+", 9003, 9010, 0)]
    seen, keep = [], genes.connected
    monkeypatch.setattr(genes, "connected", lambda edges, nodes: seen.append(edges.count()) or keep(edges, nodes))
    frame = spark.createDataFrame(rows, "tid bigint, seq string, strand string, start bigint, end bigint, frame int")
    got = {r.tid: r.gene for r in genes.gene_clusters(frame, 64).collect()}
    assert seen[0] < len(rows)
    assert got == {t: 0 if t < 400 or t == 439 else t for t in range(440)}


def test_components_keep_no_table_of_earlier_rounds(spark, monkeypatch):
    from locusframe.operators import graphs

    rng = random.Random(8)
    names = rng.sample(range(10_000), 900)
    links = list(zip(names[:300], names[1:301])) + [(rng.choice(names[400:]), rng.choice(names[400:])) for _ in range(300)] + [(5, 5)]
    label = {x: x for e in links for x in e if e[0] != e[1]}
    while any(label[u] != label[v] for u, v in links if u != v):
        for u, v in links:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    made, gone, keep, drop = [], [], graphs.written, graphs.dropped
    monkeypatch.setattr(graphs, "written", lambda df, name: made.append(1) or keep(df, name))
    monkeypatch.setattr(graphs, "dropped", lambda *tables: gone.extend(tables) or drop(*tables))
    got = graphs.connected(spark.createDataFrame(links, "u bigint, v bigint"))
    assert {r.node: r.component for r in got.collect()} == label
    # the last edges, which are empty, and what the result reads
    assert len(made) - len(gone) == 2
