"""Interaction of quality filters: what each of them removes in any order, by Walsh-Hadamard sums.

A document fails a set of filters, a mask of bits.  For every part and label 32 signed parity sums are
aggregated, ``W[s] = sum of (-1)^|mask & s|``; they are plain sums, so that Spark adds them up before
the shuffle, however many documents a part has.  The transform is its own inverse up to a factor,
``cells[m] = 1/32 sum of (-1)^|m & s| W[s]``, and the counts of documents by mask come back exactly.
All orders, and Shapley values in closed form, are evaluated on these cells: over the 120 orders each of
the k filters that a document fails comes first, and so removes it, 120 / k times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import small_batches, written

#: Fixed values of the contract.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, MARKS = 200, 50, 2, b"#$%&*|"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LABELS = ("all", "good", "toxic")

_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_MARK = np.array([b in MARKS for b in range(256)])


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _own_failures(part: _text.Words) -> np.ndarray:
    """Bits of the filters A to D, which a text fails by itself."""
    rows, words = part.hi - part.lo, part.last - part.first
    row = np.repeat(np.arange(rows), words)
    key = _text.mix(part.hashes(lower=False) ^ _text.mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = np.diff(key[order]) != 0
    distinct = np.bincount(row[order[new]], minlength=rows)
    points = _text.code_point_prefix(part.buf)
    upper, marks = _sums(_UPPER[part.buf]), _sums(_MARK[part.buf])
    inside = lambda sums: sums[part.row_end] - sums[part.row_start]
    failed = [words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words, 100 * inside(upper) > MAX_UPPER_PERCENT * inside(points), inside(marks) > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(failed))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _text.chunks(batch.column(2), _text.NOT_SPACE):
            raw = part.buf.tobytes()
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(part.row_start.tolist(), part.row_end.tolist(), strict=True)]
            own = [batch.column(k).slice(part.lo, part.hi - part.lo) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(digests, pa.binary()), pa.array(_own_failures(part), pa.int32())], ["doc_id", "part", "digest", "mask"])


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` of every row of ``docs`` (``doc_id, text, source``): a bit for each filter it fails.

    Null texts are empty, and a null source is the part ''.  Texts are compared by their SHA-256, over the whole
    table.  A row fails E if its text is that of a smaller ``doc_id``, so rows that repeat a ``doc_id`` don't fail
    by each other, and a null ``doc_id`` neither fails E nor makes another fail.  Other columns aren't read.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    measured = written(rows.mapInArrow(_measure, "doc_id bigint, part string, digest binary, mask int"), "audit-measured")
    least = measured.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    # as a table, so that the join's hot digests can be split over tasks
    least = written(least.where("least < most").drop("most"), "audit-copied")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    return measured.join(least, "digest", "left").select("doc_id", "part", (F.col("mask") + copy * (1 << 4)).alias("mask"))


def labelled(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``masks`` with ``good`` and ``toxic``: whether any row of ``labels`` says so of the ``doc_id``."""
    by_doc = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    by_doc = by_doc.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    return masks.join(by_doc, "doc_id", "left").select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in LABELS[1:]))


def _sign(mask: Column, subset: Column) -> Column:
    return F.lit(1).cast("long") - 2 * F.bit_count(mask.bitwiseAND(subset)).bitwiseAND(F.lit(1))


def parity_sums(documents: DataFrame) -> DataFrame:
    """``part, label, sums``: 32 signed parity sums for the documents (``part, mask, good, toxic``) with each label."""
    label = F.explode(F.array_compact(F.array(F.lit(LABELS[0]), *(F.when(F.col(c), c) for c in LABELS[1:])))).alias("label")
    rows = documents.select("part", "mask", label)
    sums = [F.sum(_sign(F.col("mask"), F.lit(s))).alias(f"w{s}") for s in range(MASKS)]
    return rows.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*(f"w{s}" for s in range(MASKS))).alias("sums"))


def mask_cells(sums: DataFrame) -> DataFrame:
    """``part`` and an array of document counts by mask for each label, from the inverse transform."""
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))
    cell = lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda got, s: got + _sign(m, s) * F.get("sums", s))
    cells = sums.select("part", "label", F.transform(every, lambda m: F.shiftright(cell(m), len(FILTERS))).alias("cells"))
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    return cells.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("label") == name, F.col("cells"))), none).alias(name) for name in LABELS))


def evaluated(cells: DataFrame) -> DataFrame:
    """A row for each part, order and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1), F.ascii(F.substring("filter_order", k, 1)) - ord(FILTERS[0]))
    steps, before = [], F.lit(0)
    for k in range(1, len(FILTERS) + 1):
        steps.append(F.struct(F.lit(k).alias("step"), bit(k).alias("own"), before.alias("before")))
        before = before + bit(k)
    rows = cells.withColumn("filter_order", F.explode(F.array(*(F.lit(o) for o in ORDERS)))).withColumn("at", F.explode(F.array(*steps)))
    own, before = F.col("at.own"), F.col("at.before")
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def total(name: str, chosen, times=lambda m: F.lit(1)) -> Column:
        return F.aggregate(F.filter(every, chosen), F.lit(0).cast("long"), lambda got, m: got + F.get(name, m) * times(m))

    fails = lambda m: m.bitwiseAND(own) != 0
    earlier = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~earlier(m)
    share = lambda m: F.floor(F.lit(len(ORDERS)) / F.bit_count(m)).cast("long")
    return rows.select(
        "part",
        "filter_order",
        F.col("at.step").alias("step"),
        total("all", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total("all", here).alias("removed"),
        total("all", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.get("all", own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("all", fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`evaluated` for the five filters over ``docs``; no documents give no rows.

    A label that several rows of ``labels`` give counts once; labels of unknown documents count nowhere.
    """
    sums = written(parity_sums(labelled(failures(docs), labels)), "audit-sums")
    return evaluated(mask_cells(sums))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """``part, filter_order, step`` and what the filter of that step does there."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
with texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), masks as (
  select doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * (doc_id > min(doc_id) over (partition by t))::int as mask from texts
), marked as (
  select part, mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic from masks left join (
    select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id) using (doc_id)
), cells as (
  select part, mask, count(*) as n, count(*) filter (where good) as g, count(*) filter (where toxic) as x from marked group by all
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l), orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps as (
  select filter_order, step, 1 << (ascii(filter_order[step]) - 65) as own, list_sum([1 << (ascii(x) - 65) for x in string_split(filter_order[1 : step - 1], '') if x <> ''])::int as earlier
  from orders, (select unnest(range(1, 6))::int as step)
)
select part, filter_order, step,
  coalesce(sum(n) filter (where mask & (own | coalesce(earlier, 0)) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (where mask & own <> 0 and mask & coalesce(earlier, 0) = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (where mask & own <> 0 and mask & coalesce(earlier, 0) <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (where mask = own), 0)::bigint as unique_fails,
  coalesce(sum(g) filter (where mask & own <> 0 and mask & coalesce(earlier, 0) = 0), 0)::bigint as good_lost,
  coalesce(sum(x) filter (where mask & own <> 0 and mask & coalesce(earlier, 0) = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) filter (where mask & own <> 0), 0)::bigint as shapley
from cells, steps group by part, filter_order, step
"""
