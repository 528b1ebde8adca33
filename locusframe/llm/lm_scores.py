"""Language-model scores by deleted interpolation of bigrams.

The probability of a word w after v mixes three estimates with weights that depend on how often the
context v was seen, in buckets by powers of two: ``P(w|v) = a c(vw) / c(v) + b c(w) / N + u / (V + 1)``.
The weights are learned by expectation-maximisation on the counts of a held-out fold of the training
documents, against the counts of the others; the scores then use the counts of both.  A text's boundary
is the context of its first word and the word after its last.

Counts are exact and grow with the corpus, but for 64-bit hashes of words, pairs and documents:

1. Words are tallied in each task and then by word.  The most frequent, ``TIER`` at most, get a rank and are
   broadcast.
2. Pairs of ranks with a product up to ``CELLS`` have counters in an array of fixed size, which is summed over
   all tasks.  So no other pair has over ``N / sqrt(CELLS)`` places, and those are dealt by pair, a row for each
   place: a window over the pair counts it, and each task adds up what its pairs give a document.
3. Places with a word without a rank are dealt by that word, which counts both the word and its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _bins, _text
from ._store import dropped, small_batches, written
from .jaccard_join import bit_filter, has_bit

#: Training documents are those whose crc32(doc_id) mod 7 isn't 2; one of so many is in the held-out fold.
SPLIT, TEST, FOLDS = 7, 2, 50
#: Words with a rank, as a power of two, and the largest product of ranks with a counter of its own.
RANK_BITS = 20
TIER, CELLS = 1 << RANK_BITS, 300_000
_RANK = TIER - 1
#: Bits of the filter of pairs in the held-out fold.
FILTER_BITS = 26
#: Rounds of expectation-maximisation at most; it ends when the log-likelihood grows by less than this share.
ROUNDS, ENOUGH = 30, 1e-6
#: Different words or pairs that a task tallies before it passes them on.
TALLY = 1 << 19
BUCKETS = 66
_U = np.uint64
_SIGN = _U(1 << 63)
#: The boundary of a text, as a word.
EDGE = np.array([_U(0xE0D6C1A5B7F3928D) | _SIGN]).view(np.int64)[0]
_TEST, _TRAIN, _FOLD = 0, 1, 2


def _edges(part: _text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token, the one before it, and its row; words are 63-bit hashes with the sign set."""
    words = part.last - part.first
    w = np.empty(len(part.start) + len(words), np.int64)
    row = np.repeat(np.arange(len(words)), words + 1)
    end = np.cumsum(words + 1) - 1
    inside = np.ones(len(w), bool)
    inside[end] = False
    w[inside] = (part.hashes(lower=True) | _SIGN).view(np.int64)
    w[end] = EDGE
    v = np.empty_like(w)
    v[:1] = EDGE
    v[1:] = w[:-1]
    return v, w, row


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (_text.mix(_text.mix(v.view(_U)) + w.view(_U)) | _SIGN).view(np.int64)


class _Tally:
    """Sums by id, in numpy; :meth:`drained` passes them on when there are many."""

    def __init__(self, n_sums: int) -> None:
        self.n_sums, self.parts, self.rows = n_sums, [], 0

    def add(self, ids: np.ndarray, *values: np.ndarray) -> None:
        self.parts.append((ids, *values))
        self.rows += len(ids)

    def _packed(self) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        ids, first, at = np.unique(columns[0], return_index=True, return_inverse=True)
        sums = [np.bincount(at, c, len(ids)).astype(np.int64) for c in columns[1 : 1 + self.n_sums]]
        return ids, *sums, *(c[first] for c in columns[1 + self.n_sums :])

    def drained(self, last: bool = False) -> Iterator[list[pa.Array]]:
        if self.rows and (last or self.rows > 4 * TALLY):
            out = self._packed()
            if last or len(out[0]) > TALLY:
                yield [pa.array(c, pa.int64()) for c in out]
                self.parts, self.rows = [], 0
            else:
                self.parts, self.rows = [out], len(out[0])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally, names = _Tally(2), ["word", "n", "n_fold"]
    for batch in batches:
        fold = (batch.column(0).to_numpy() & 3) == _FOLD
        for part in _text.chunks(batch.column(1), _text.NOT_SPACE):
            _, w, row = _edges(part)
            tally.add(w, np.ones(len(w), bool), fold[part.lo : part.hi][row])
            for arrays in tally.drained():
                yield pa.RecordBatch.from_arrays(arrays, names)
    for arrays in tally.drained(last=True):
        yield pa.RecordBatch.from_arrays(arrays, names)


class Ranks:
    """The most frequent words: their counts by rank, and ranks by word.

    Words are hashes, so sorted ones are evenly spread, and a table of their first bits says where to look.
    """

    def __init__(self, words: np.ndarray, n: np.ndarray, n_fold: np.ndarray) -> None:
        if not len(words):
            # nothing was learned from: a boundary that was never seen
            words, n, n_fold = np.array([EDGE]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        order = np.lexsort((words, -n))
        self.n, self.n_fold = n[order], n_fold[order]
        by_word = np.argsort(words[order])
        self.words, self.rank = words[order][by_word], by_word.astype(np.int32)
        self.first = np.searchsorted(self._slot(self.words), np.arange(TIER + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max())

    @staticmethod
    def _slot(words: np.ndarray) -> np.ndarray:
        return ((words.view(_U) & ~_SIGN) >> _U(63 - RANK_BITS)).astype(np.int32)

    def of(self, words: np.ndarray) -> np.ndarray:
        """Ranks of words, -1 for those without."""
        out = np.full(len(words), -1, np.int64)
        slot = self._slot(words)
        at, end = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(at < end)
        for _ in range(self.longest):
            here = at[left]
            hit = self.words[here] == words[left]
            out[left[hit]] = self.rank[here[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
            if not len(left):
                break
        return out


_row_of_cell = CELLS // np.arange(1, CELLS + 1)
#: Where the counters of each first rank begin; the last is their number.
CELL_AT = np.concatenate([[0], np.cumsum(_row_of_cell)])


def cells_of(rv: np.ndarray, rw: np.ndarray) -> np.ndarray:
    """Counters of pairs of ranks, -1 for those without."""
    own = (rv >= 0) & (rw >= 0) & ((rv + 1) * (rw + 1) <= CELLS)
    return np.where(own, CELL_AT[np.minimum(np.maximum(rv, 0), CELLS - 1)] + rw, -1)


def _ranked(ranks: Ranks, part: _text.Words) -> tuple[np.ndarray, ...]:
    v, w, row = _edges(part)
    rw = ranks.of(w)
    rv = np.empty_like(rw)
    rv[:1] = ranks.of(np.array([EDGE]))
    rv[1:] = rw[:-1]
    return v, w, row, rv, rw


def _pair_ids(v: np.ndarray, w: np.ndarray, rv: np.ndarray, rw: np.ndarray) -> np.ndarray:
    """A pair of ranks is named by both, others by a hash, which is negative."""
    return np.where((rv >= 0) & (rw >= 0), (rv << RANK_BITS) | rw, pair_hash(v, w))


def _fold_pairs(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch.column(1), _text.NOT_SPACE):
                v, w, _, rv, rw = _ranked(broadcast.value, part)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_pair_ids(v, w, rv, rw)))], ["pair"])

    return run


def _pair_counts(broadcast, fold_filter):
    """Counts, in the fold and outside of it, of pairs that the fold may have; words of those that have no rank."""
    names = ["pair", "n", "n_fold", "v", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(2)
        for batch in batches:
            fold = (batch.column(0).to_numpy() & 3) == _FOLD
            for part in _text.chunks(batch.column(1), _text.NOT_SPACE):
                v, w, row, rv, rw = _ranked(broadcast.value, part)
                pair = _pair_ids(v, w, rv, rw)
                keep = np.flatnonzero(has_bit(fold_filter.value, pair, FILTER_BITS))
                own = fold[part.lo : part.hi][row[keep]]
                hashed = pair[keep] < 0
                tally.add(pair[keep], ~own, own, np.where(hashed, v[keep], 0), np.where(hashed, w[keep], 0))
                for arrays in tally.drained():
                    yield pa.RecordBatch.from_arrays(arrays, names)
        for arrays in tally.drained(last=True):
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _cell_counts(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELL_AT[-1], np.int64)
        for batch in batches:
            for part in _text.chunks(batch.column(0), _text.NOT_SPACE):
                *_, rv, rw = _ranked(broadcast.value, part)
                at = cells_of(rv, rw)
                np.add.at(cells, at[at >= 0], 1)
        yield _bins.parts(cells)

    return run


def bucket_of(n: np.ndarray) -> np.ndarray:
    """0 for a context that wasn't seen, else one more than the whole part of its binary logarithm."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64) * (n > 0)


def estimates(x: np.ndarray, y: np.ndarray, z: np.ndarray, n: int, v: int) -> np.ndarray:
    """The three estimates of a word from the counts of the word, the context and the pair."""
    return np.stack([np.where(y > 0, z / np.maximum(y, 1), 0.0), x / max(n, 1), np.full(len(x), 1.0 / (v + 1))])


def _expected(weights: np.ndarray, n: int, v: int):
    """One step of expectation-maximisation: by bucket, what each estimate is responsible for, and the log-likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, BUCKETS))
        for batch in _joined(batches):
            x, y, z, times = (batch.column(c).to_numpy() for c in ("x", "y", "z", "times"))
            bucket = bucket_of(y)
            own = estimates(x, y, z, n, v) * weights[bucket].T
            total = own.sum(axis=0)
            for k in range(3):
                sums[k] += np.bincount(bucket, own[k] / total * times, BUCKETS)
            sums[3] += np.bincount(bucket, np.log(total) * times, BUCKETS)
        has = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(has), *(pa.array(s[has]) for s in sums)], ["bucket", "r2", "r1", "r0", "ll"])

    return run


def settled(shares: np.ndarray) -> np.ndarray:
    """Weights by bucket from what each estimate is responsible for.

    Buckets without held-out tokens take the weights of all tokens together, and those of the first context
    bucket, which has no pairs, are without a share of pairs.
    """
    shares = np.where(shares.sum(axis=1, keepdims=True) > 0, shares, shares.sum(axis=0, keepdims=True))
    shares = np.where(shares.sum(axis=1, keepdims=True) > 0, shares, 1.0)
    shares[0, 0] = 0.0
    shares[0] = np.where(shares[0].sum() > 0, shares[0], [0.0, 1.0, 1.0])
    return shares / shares.sum(axis=1, keepdims=True)


def learned_weights(held_out: DataFrame, n: int, v: int) -> np.ndarray:
    """Mixture weights (a row for each bucket: pair, word, uniform) from ``x, y, z, times`` of held-out tokens.

    No tokens leave equal weights.  What reaches the driver in a round is a row for each bucket.
    """
    weights, before = settled(np.zeros((BUCKETS, 3))), -math.inf
    for _ in range(ROUNDS):
        rows = held_out.mapInArrow(_expected(weights, n, v), "bucket bigint, r2 double, r1 double, r0 double, ll double").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("r2", "r1", "r0", "ll"))).collect()
        shares = np.zeros((BUCKETS, 3))
        for r in rows:
            shares[r["bucket"]] = r["r2"], r["r1"], r["r0"]
        weights, now = settled(shares), sum(r["ll"] for r in rows)
        if not rows or now - before <= ENOUGH * abs(now):
            break
        before = now
    return weights


class Model:
    """What a task needs for scoring: totals, weights, ranks and the counters of frequent pairs."""

    def __init__(self, n: int, v: int, weights: np.ndarray, ranks: Ranks, cells: np.ndarray) -> None:
        self.ranks, self.cells, self.base = ranks, cells, math.log10(n + v + 1)
        self.pair, self.word, self.uniform = weights[:, 0].copy(), weights[:, 1] / max(n, 1), weights[:, 2] / (v + 1)

    def log10(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Of words seen ``x`` times, after contexts seen ``y`` times, in pairs seen ``z`` times."""
        bucket = bucket_of(y)
        return np.log10(self.pair[bucket] * (z / np.maximum(y, 1)) + self.word[bucket] * x + self.uniform[bucket])


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of numbers put together to larger ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_LOCAL = "key bigint, doc_id bigint, copies bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _local(broadcast):
    """What a document's own task knows: tokens, ranked words, and pairs with a counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for batch in batches:
            for part in _text.chunks(batch.column(2), _text.NOT_SPACE):
                *_, row, rv, rw = _ranked(m.ranks, part)
                rows = part.hi - part.lo
                add = lambda at, values: np.bincount(row[at], values, rows)
                known = np.flatnonzero(rw >= 0)
                x = m.ranks.n[rw[known]]
                tokens = np.bincount(row, minlength=rows)
                base = add(known, np.log10(x + 1.0)) - tokens * m.base
                cell = cells_of(rv, rw)
                own = np.flatnonzero(cell >= 0)
                score = add(own, m.log10(m.ranks.n[rw[own]], m.ranks.n[rv[own]], m.cells[cell[own]])) if len(own) else np.zeros(rows)
                ids = [batch.column(k).slice(part.lo, rows) for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(np.ones(rows, np.int64)), pa.array(tokens, pa.int64()), pa.array(np.bincount(row[known[x > 0]], minlength=rows), pa.int64()), pa.array(base), pa.array(score)],
                    ["key", "doc_id", "copies", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def _ranked_places(broadcast):
    """``pair, key`` of each place of two ranked words without a counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            for part in _text.chunks(batch.column(1), _text.NOT_SPACE):
                *_, row, rv, rw = _ranked(broadcast.value.ranks, part)
                at = np.flatnonzero((rv >= 0) & (rw >= 0) & (cells_of(rv, rw) < 0))
                yield pa.RecordBatch.from_arrays([pa.array((rv[at] << RANK_BITS) | rw[at]), pa.array(key[part.lo : part.hi][row[at]])], ["pair", "key"])

    return run


def _rare_places(broadcast):
    """``word, other, after, key`` of each place with a word without a rank.

    ``word`` has none.  ``other`` is the word before it, or the ranked one after it if ``after``; a rank or, below 0, a hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            for part in _text.chunks(batch.column(1), _text.NOT_SPACE):
                v, w, row, rv, rw = _ranked(broadcast.value.ranks, part)
                ends, begins = np.flatnonzero(rw < 0), np.flatnonzero((rv < 0) & (rw >= 0))
                at = np.concatenate([ends, begins])
                word = np.concatenate([w[ends], v[begins]])
                other = np.concatenate([np.where(rv[ends] >= 0, rv[ends], v[ends]), rw[begins]])
                after = np.arange(len(at)) >= len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(other), pa.array(after), pa.array(key[part.lo : part.hi][row[at]])], ["word", "other", "after", "key"])

    return run


def _ranked_scores(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for batch in _joined(batches):
            pair, z = batch.column("pair").to_numpy(), batch.column("z").to_numpy()
            scores = m.log10(m.ranks.n[pair & _RANK], m.ranks.n[pair >> RANK_BITS], z)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores)], ["key", "score"])

    return run


def _rare_scores(broadcast):
    """Also the part of the base score and of the known tokens that words without a rank make up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for batch in _joined(batches):
            other, after, c, z, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("other", "after", "c", "z", "y"))
            ranked = m.ranks.n[np.where(other >= 0, other, 0)]
            x = np.where(after, ranked, c)
            before = np.where(after, c, np.where(other >= 0, ranked, y))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array((~after & (c > 0)).astype(np.int64)), pa.array(np.where(after, 0.0, np.log10(c + 1.0))), pa.array(m.log10(x, before, z))], ["key", "n_known", "base_score", "score"]
            )

    return run


def _tier(words: DataFrame, size: int) -> Ranks:
    """The most frequent words, ``size`` at most, all of one count band or none, and the boundary."""
    level = F.floor(8 * F.log2("n")).cast("int")
    left, lowest = size - 1, math.inf
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["level"]):
        left -= r["words"]
        if left < 0:
            break
        lowest = r["level"]
    found = words.where((level >= F.lit(lowest)) | (F.col("word") == F.lit(int(EDGE)))).toArrow()
    return Ranks(*(found.column(c).to_numpy() for c in ("word", "n", "n_fold")))


def _held_out(rows: DataFrame, words: DataFrame, ranks: Ranks) -> DataFrame:
    """``x, y, z, times`` of the tokens of the fold: counts outside of it, and how many tokens have them."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(ranks)
    pairs = rows.where(F.col("key").bitwiseAND(3) == _FOLD).select("key", "text").mapInArrow(_fold_pairs(shared), "pair bigint")
    wanted = context.broadcast(bit_filter(pairs, FILTER_BITS))
    counts = rows.where(F.col("key").bitwiseAND(3) != _TEST).select("key", "text").mapInArrow(_pair_counts(shared, wanted), "pair bigint, n bigint, n_fold bigint, v bigint, w bigint")
    counts = counts.groupBy("pair").agg(F.sum("n").alias("z"), F.sum("n_fold").alias("times"), F.min("v").alias("v"), F.min("w").alias("w")).where("times > 0")
    counts = written(counts, "scores-held-out")

    def of_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value.n - shared.value.n_fold
        for batch in _joined(batches):
            pair = batch.column("pair").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(n[pair & _RANK]), pa.array(n[pair >> RANK_BITS]), batch.column("z"), batch.column("times")], ["x", "y", "z", "times"])

    ranked = counts.where("pair >= 0").select("pair", "z", "times").mapInArrow(of_ranks, "x bigint, y bigint, z bigint, times bigint")
    outside = (F.col("n") - F.col("n_fold")).alias("c")
    hashed = counts.where("pair < 0").join(words.select(F.col("word").alias("w"), outside).withColumnRenamed("c", "x"), "w").join(words.select(F.col("word").alias("v"), outside).withColumnRenamed("c", "y"), "v")
    return written(ranked.unionByName(hashed.select("x", "y", "z", "times")).groupBy("x", "y", "z").agg(F.sum("times").alias("times")), "scores-mixture")


def scores(docs: DataFrame, tier: int = TIER, folds: int = FOLDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs`` (``doc_id, text``).

    Null texts are empty: their only token is the end.  Rows without a ``doc_id`` are scored but not
    learned from, and count as held out.  Rows that repeat a ``doc_id`` are documents of their own, learned
    from each time.  Without training documents all probabilities are uniform.  Other columns are not read.
    """
    spark = docs.sparkSession
    rest = F.crc32(F.col("doc_id").cast("string"))
    flag = F.when(rest.isNull() | (rest % SPLIT == TEST), _TEST).when(F.floor(rest / SPLIT) % folds == 0, _FOLD).otherwise(_TRAIN)
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("flag", flag)
    # the key of a row has its use in the lowest bits
    key = F.xxhash64("doc_id", "text", F.col("doc_id").isNull()).bitwiseAND(F.lit(-4)) + F.col("flag")
    rows = rows.select(key.cast("long").alias("key"), "doc_id", "text")
    learned = rows.where(F.col("key").bitwiseAND(3) != _TEST).select("key", "text")

    words = learned.mapInArrow(_word_counts, "word bigint, n bigint, n_fold bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_fold").alias("n_fold"))
    words = written(words, "scores-words")
    total = words.agg(F.sum("n").alias("n"), F.sum("n_fold").alias("n_fold"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    ranks = _tier(words, min(tier, TIER))
    held_out = _held_out(rows, words, ranks)
    weights = learned_weights(held_out, n - (total["n_fold"] or 0), v)
    dropped(held_out)

    shared = spark.sparkContext.broadcast(ranks)
    texts = learned.select("text")
    cells = _bins.merged(texts.mapInArrow(_cell_counts(shared), _bins.PARTS), _bins.tasks_of(texts), int(CELL_AT[-1]))
    model = spark.sparkContext.broadcast(Model(n, v, weights, ranks, cells))

    learned_from = (F.col("key").bitwiseAND(3) != _TEST).cast("long")
    count = lambda *by: F.sum(learned_from).over(Window.partitionBy(*by))
    places = rows.select("key", "text")
    ranked = places.mapInArrow(_ranked_places(model), "pair bigint, key bigint").withColumn("z", count("pair"))
    ranked = ranked.mapInArrow(_ranked_scores(model), "key bigint, score double")
    rare = places.mapInArrow(_rare_places(model), "word bigint, other bigint, after boolean, key bigint")
    # each place of a word is the end of one pair
    rare = rare.withColumn("z", count("word", "after", "other")).withColumn("c", F.sum(F.when(F.col("after"), 0).otherwise(learned_from)).over(Window.partitionBy("word")))
    both = F.col("other") < 0
    known = words.select(F.col("word").alias("other"), F.col("n").alias("y"))
    rare = rare.where(both).join(known, "other", "left").withColumn("y", F.coalesce("y", F.lit(0).cast("long"))).unionByName(rare.where(~both).withColumn("y", F.lit(0).cast("long")))
    rare = rare.mapInArrow(_rare_scores(model), "key bigint, n_known bigint, base_score double, score double")

    own = rows.mapInArrow(_local(model), _LOCAL)
    sums: list[Column] = [F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base_score", "score"))]
    found = own.unionByName(rare, allowMissingColumns=True).unionByName(ranked, allowMissingColumns=True).groupBy("key").agg(*sums)
    # equal rows share a key
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    each = lambda c: (F.col(c) / F.col("copies")).alias(c)
    return found.select(
        "doc_id",
        (F.col("key").bitwiseAND(3) == _TEST).alias("held_out"),
        each("n_tokens").cast("long").alias("n_tokens"),
        each("n_known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        each("base_score"),
        each("score"),
    )


def op12_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
