"""Scans of sequences, each against a plain version."""

import random
from collections import Counter

from pyspark.sql import functions as F

from locusframe.functions.sequence import kmers
from locusframe.operators import sequences as Q


def test_repetitive_without_a_row_for_each_word(spark):
    rng = random.Random(3)
    texts = [None, "", "ac", "a" * 40, "acgt" * 30, *("".join(rng.choice(x) for _ in range(rng.randrange(1, 300))) for x in ("ac", "aA", "acgt", "a") for _ in range(20)), *(("acgTtgaé"[: rng.randrange(3, 9)]) * 9 for _ in range(10))]
    frame = spark.createDataFrame(list(enumerate(texts)), "seq bigint, bases string")
    out = Q.repetitive(frame, 8, 3, 2)
    assert "Generate" not in out._jdf.queryExecution().toString()
    want = {}
    for i, t in enumerate(texts):
        for k in range(3, 9):
            c = Counter((t or "")[j : j + k] for j in range(len(t or "") - k + 1))
            if c and (share := sum(n for n in c.values() if n > 2) / c.total()) >= (0.5 if k > 5 else 0.75):
                want[i] = k, share
    assert {r.seq: (r.k, r.share) for r in out.collect()} == want and len(want) > 20


def test_kmers(spark):
    texts = ["", "ac", "acgtn", "a\ncé", "x😀yz", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.a, r.b) for r in frame.select("i", kmers("t", 3).alias("a"), kmers("t", F.col("i") % 2 + 1, 2).alias("b")).collect()}
    for i, t in enumerate(texts):
        t, k = t or "", i % 2 + 1
        assert got[i] == ([t[j : j + 3] for j in range(len(t) - 2)], [t[j : j + k] for j in range(0, len(t) - k + 1, 2)])


def test_spans_are_cut_from_short_pieces(spark, monkeypatch):
    """A span's cost is that of the walk to it, so no long text or stored chunk is joined to spans."""
    from pyspark.sql import functions as F

    from locusframe.operators import sequences

    own, longest = sequences.fetch_chunks, []

    def watched(chunks, *rest):
        longest.append(chunks.agg(F.max(F.length("bases"))).first()[0])
        return own(chunks, *rest)

    monkeypatch.setattr(sequences, "fetch_chunks", watched)
    text = "".join("acgt"[(i * i // 7) % 4] for i in range(9000))
    seqs = spark.createDataFrame([("c", text), ("empty", "")], "seq string, bases string")
    rows = spark.createDataFrame([(s, "c", s, s + n) for s, n in ((1, 2), (1023, 4), (2048, 3000), (8990, 50))] + [(0, "empty", 1, 2)], "id int, seq string, start bigint, end bigint")
    for source in (seqs, sequences.chunked(seqs, 4096)):
        got = {r.id: r.x for r in sequences.fetched(rows, source, {"x": (F.col("start"), F.col("end"))}).collect()}
        assert got == {s: text[s - 1 : s + n] for s, n in ((1, 2), (1023, 4), (2048, 3000), (8990, 50))}
    assert max(longest) <= 1024
