"""Runs of words that repeat with a period, found with a suffix automaton.

A run is a stretch of words with smallest period q that is at least three periods long and can't grow.
In a suffix automaton of the words each state has the ordered set of positions where its words end.  The
sets are merged from the longest states up, the smaller into the larger, and each position that is put
in has two new neighbours: if one is no further away than the state is long, the state's words at both
places make up a square, which is extended to a run.  A run of length L is seen where its words all but
the last q first meet themselves, q words before, so that no run is missed.

An exact screen comes first: a run of at least ``min_length`` words and ``min_periods`` periods holds windows
of ``min_length - min_length // min_periods`` words that occur twice in the text, and such windows cover it.
Only stretches of words that are covered so are given to automata, one for each stretch.
Documents are independent, so nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import small_batches

MIN_LENGTH, MIN_PERIODS = 24, 3
#: Positions in one block of an ordered set.
BLOCK = 512
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "lf_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, best struct<start:bigint,length:bigint,period:bigint>, collapsed string"


class EndPositions:
    """An ordered set of positions in sorted blocks."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, x: int) -> None:
        self.blocks, self.tops, self.size = [[x]], [x], 1

    def add(self, x: int) -> tuple[int, int]:
        """Put in a new position; its neighbours before and after, -1 for none."""
        k = bisect_left(self.tops, x)
        if k == len(self.tops):
            k -= 1
            block = self.blocks[k]
            before, after = block[-1], -1
            block.append(x)
            self.tops[k] = x
        else:
            block = self.blocks[k]
            i = bisect_left(block, x)
            after = block[i]
            before = block[i - 1] if i else self.blocks[k - 1][-1] if k else -1
            block.insert(i, x)
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.tops[k : k + 1] = [block[BLOCK - 1], block[-1]]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and end position of each state; clones have -1 for the last."""
    length, link, end, after = [0], [-1], [-1], [{}]
    last = 0
    for at, w in enumerate(words):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(at)
        after.append({})
        p = last
        while p >= 0 and w not in after[p]:
            after[p][w] = new
            p = link[p]
        if p >= 0:
            q = after[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                after.append(after[q].copy())
                while p >= 0 and after[p].get(w) == q:
                    after[p][w] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return length, link, end


def squares(words: list[int], min_length: int, min_periods: int) -> list[tuple[int, int, int]]:
    """``length, start, period`` of stretches with that period, as long as a run must be: each run is among them as a whole."""
    length, link, end = suffix_automaton(words)
    least = min_length - min_length // min_periods
    sets = [EndPositions(x) if x >= 0 and n >= least else None for x, n in zip(end, length, strict=True)]
    out = []
    for s in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        n = length[s]
        if n < least:
            break
        p = link[s]
        n = length[p]
        small, sets[s] = sets[s], None
        # shorter states can't hold the square of a run
        if n < least or small is None:
            continue
        large = sets[p]
        if large is None:
            sets[p] = small
            continue
        if small.size > large.size:
            small, large = large, small
        sets[p] = large
        for x in small:
            before, after = large.add(x)
            for a, b in ((before, x), (x, after)):
                d = b - a
                if a >= 0 and 0 < d <= n and n + d >= min_length and n + d >= min_periods * d:
                    out.append((n + d, a - n + 1, d))
    return out


def runs_of(words: list[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of ``words``, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    by_period: dict[int, tuple[list[int], list[int]]] = {}
    for n, start, d in sorted(squares(words, min_length, min_periods), reverse=True):
        starts, ends = by_period.setdefault(d, ([], []))
        k = bisect_right(starts, start) - 1
        if k >= 0 and start + n <= ends[k]:
            continue
        a, b = start, start + n
        while a > 0 and words[a - 1] == words[a - 1 + d]:
            a -= 1
        while b < len(words) and words[b] == words[b - d]:
            b += 1
        k = bisect_left(starts, a)
        starts.insert(k, a)
        ends.insert(k, b)
        # a multiple of the smallest period has the same stretch
        found[a, b] = min(d, found.get((a, b), d))
    return sorted((a, b - a, d) for (a, b), d in found.items())


def _repeated(part: _text.Words, window: int) -> np.ndarray:
    """Words inside windows that occur twice or more in their row."""
    h = part.hashes(lower=False)
    row = np.repeat(np.arange(part.hi - part.lo), part.last - part.first)
    size = len(h) - window + 1
    covered = np.zeros(len(h), bool)
    if size < 1:
        return covered
    at = np.flatnonzero(row[:size] == row[window - 1 :])
    key = _text.mix(row[at].astype(np.uint64) + np.uint64(1))
    for k in range(window):
        key = _text.mix(key + h[at + k])
    order = np.argsort(key)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = np.diff(key[order]) == 0
    twice = at[order[same[1:] | same[:-1]]]
    if len(twice):
        step = np.zeros(len(h) + 1, np.int64)
        np.add.at(step, twice, 1)
        np.add.at(step, twice + window, -1)
        covered = np.cumsum(step)[:-1] > 0
    return covered


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; the first of equal ones."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _found(min_length: int, min_periods: int):
    window = min_length - min_length // min_periods

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch.column(1), _text.NOT_SPACE):
                covered = _repeated(part, window)
                raw = part.buf.tobytes()
                all_runs, texts = [], []
                for r in range(part.hi - part.lo):
                    words = raw[part.row_start[r] : part.row_end[r]].split()
                    own = covered[part.first[r] : part.last[r]]
                    runs: list[tuple[int, int, int]] = []
                    if own.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                            names: dict[bytes, int] = {}
                            runs += [(a + s, n, d) for s, n, d in runs_of([names.setdefault(w, len(names)) for w in words[a:b]], min_length, min_periods)]
                        gone = np.zeros(len(words) + 1, np.int64)
                        for s, n, d in runs:
                            gone[s + d] += 1
                            gone[s + n] -= 1
                        words = [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]
                    all_runs.append(runs)
                    texts.append(b" ".join(words).decode())
                best = [_best(x) for x in all_runs]
                as_run = lambda x: dict(zip(("start", "length", "period"), x, strict=True)) if x else None
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.lo, part.hi - part.lo), pa.array(part.last - part.first, pa.int64()), pa.array([[as_run(x) for x in runs] for runs in all_runs], pa.list_(_RUN)), pa.array([as_run(x) for x in best], _RUN), pa.array(texts, pa.string())],
                    ["lf_id", "n_words", "runs", "best", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``id_col, n_words, runs, best, collapsed`` for every row.

    ``runs`` are start, length and period in words, by start, then period; ``best`` is the one of the greatest
    exponent, null without runs; ``collapsed`` has the words, joined by one space, without those that a run
    repeats after its first period.  Null and empty texts have no words and an empty ``collapsed``.  Ids may
    be null or repeated; each row has its own result.  Other columns are not read.
    """
    if min_periods < 2 or min_length < min_periods:
        raise ValueError("a run has two periods or more, and a word for each")
    rows = small_batches(docs).select(F.col(id_col).alias("lf_id"), F.col(text_col).alias("lf_text"))
    found = rows.mapInArrow(_found(min_length, min_periods), SCHEMA.format(kind=dict(rows.dtypes)["lf_id"]))
    return found.withColumnRenamed("lf_id", id_col)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: of documents whose h = crc32(doc_id) is divisible by 10 the end is made periodic.

    Words from a = g % n on, g = h / 10, repeat the first p of them, p = 1 + (n - a) / (3 + g % 8).
    Texts without words, and rows without a ``doc_id``, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w")).withColumns({"n": F.size("w"), "g": F.floor(h / 10)})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest: Column = F.col("n") - F.col("a")
    unit = F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))
    planted = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(F.flatten(unit), F.lit(1), rest))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of every document, those planted in a tenth of them included."""
    found = periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
