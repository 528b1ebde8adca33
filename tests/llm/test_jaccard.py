import random

import pytest
from pyspark.sql import functions as F

from locusframe.llm import jaccard_join
from locusframe.llm.components import components

from .helpers import frame, jaccard_components, messy, words_of


def result(spark, rows):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()}


def test_messy(spark):
    assert result(spark, messy()) == jaccard_components(messy())


@pytest.mark.parametrize(("block", "few"), [(4, -1), (256, 20_000)])
def test_groups_chains_and_passages(spark, monkeypatch, block, few):
    """Near copies that don't all link, chains, shared passages and sets of unlike sizes, with candidate pairs shuffled or broadcast."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BROADCAST_PAIRS", few)
    rng = random.Random(11)
    rows, number = [], 0
    passage = words_of(rng, 30, 10**6)
    for _ in range(5):
        base = words_of(rng, rng.randrange(20, 200), 10**6).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 40) + 1)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            rows.append((number, " ".join(copy)))
            number += 1
        for k in range(20):
            rows.append((number, " ".join(base[k:] + [f"t{j}" for j in range(k)])))
            number += 1
    for _ in range(30):
        rows.append((number, words_of(rng, 40, 10**6) + " " + passage + " " + words_of(rng, rng.randrange(1, 60), 10**6)))
        number += 1
    rng.shuffle(rows)
    assert result(spark, rows) == jaccard_components(rows)


def test_large_hash_values_of_pairs_with_few_shingles(spark):
    rows = [(i, f"a b c d{i % 3}") for i in range(12)] + [(20, "a b c"), (21, "a  b\tC"), (22, "c b a")]
    assert result(spark, rows) == jaccard_components(rows)


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "p q r s t"), (1, "p q r s t"), (None, "p q r s t"), (2, "P q r s t")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in jaccard_join.jaccard_join(frame(spark, rows)).collect())
    assert got == [(-1, 2, -1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert jaccard_join.jaccard_join(frame(spark, []).limit(0)).count() == 0


def test_sql_agrees(spark):
    import duckdb

    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", messy())
    got = c.sql(jaccard_join.OP1_SQL).select("doc_id", "n_shingles", "component_id", "n_links").fetchall()
    assert {r[0]: r[1:] for r in got} == jaccard_components(messy())


def test_prefix_is_long_enough():
    for n in range(1, 300):
        least = -(-85 * n // 100)
        assert jaccard_join.prefix_length(n, 85) == n - least + 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_lists_are_skipped_only_if_no_size_can_link(spark):
    n, lo, hi, shared = (F.col(c) for c in ("n", "lo", "hi", "shared"))
    ends = spark.range(1, 41).toDF("n").join(spark.range(1, 41).toDF("lo")).join(spark.range(1, 41).toDF("hi"), F.col("lo") <= F.col("hi")).join(spark.range(0, 6).toDF("shared"))
    for percent in (15, 50, 80, 85, 100):
        one = F.exists(F.sequence(lo, hi), lambda m: (100 + percent) * (shared + F.ceil(F.greatest(n, m) * percent / 100) - 1) >= percent * (n + m))
        assert ends.where(jaccard_join._near(n, lo, hi, shared, percent) != one).count() == 0


def test_link_through_a_list_whose_largest_size_cannot_link(spark):
    """17 of 20 shingles shared, in a list with a set of 20, and one side follows another pivot."""
    rows, number = [], 0
    for k in range(40):
        w, z, own = ([f"{c}{k}x{j}" for j in range(n)] for c, n in (("w", 20), ("z", 19), ("o", 3)))
        rows += [(number, " ".join([own[0], *w])), (number + 1, " ".join(w + own[1:])), (number + 2, " ".join(w[:4] + z)), (number + 3, " ".join([own[0], *w[:3]]))]
        # long texts make all other shingles of the four more frequent than the one in the list
        rows += [(number + 4 + j, " ".join(w[1:] + [f"p{k}x{j}x{i}" for i in range(200)] + w[1:4] + z)) for j in range(4)]
        number += 8
    assert result(spark, rows) == jaccard_components(rows)
