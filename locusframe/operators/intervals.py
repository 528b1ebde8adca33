"""Interval algebra.

An interval table has the columns ``seq, start, end`` (closed, integer) and any others.  Joins are
equi-joins on (sequence, bin): an interval stands in every bin that it touches, and a pair counts
only in the bin where the later of the two starts lies, so it is found once and a long sequence is
spread over its bins.  Running totals use :mod:`.scans`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import max_before, next_value, running_sum

BIN = 1 << 14
CHUNK = 1 << 20


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    return df.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str] = ("seq",), width: int = BIN, condition: Column | None = None, suffix: str = "_r") -> DataFrame:
    """Pairs of overlapping intervals; columns of ``right`` other than ``on`` get ``suffix``.

    Intervals with start > end meet nothing.
    """
    other = right.select(*[F.col(c).alias(c if c in on else c + suffix) for c in right.columns])
    a, b = _binned(left, "start", "end", width), _binned(other, "start" + suffix, "end" + suffix, width)
    met = a.join(b, [*on, "_bin"]).where((F.col("start") <= F.col("end" + suffix)) & (F.col("start" + suffix) <= F.col("end")))
    met = met.where(F.col("_bin") == F.floor(F.greatest("start", "start" + suffix) / width)).drop("_bin")
    return met if condition is None else met.where(condition)


def contained_join(left: DataFrame, right: DataFrame, on: Sequence[str] = ("seq",), width: int = BIN, suffix: str = "_r") -> DataFrame:
    """Pairs in which the interval of ``left`` lies inside that of ``right``."""
    return overlap_join(left, right, on, width, (F.col("start" + suffix) <= F.col("start")) & (F.col("end") <= F.col("end" + suffix)), suffix)


def starts_in(left: DataFrame, right: DataFrame, on: Sequence[str] = ("seq",), width: int = BIN, suffix: str = "_r") -> DataFrame:
    """Pairs in which the interval of ``left`` begins inside that of ``right``."""
    return overlap_join(left, right, on, width, F.col("start").between(F.col("start" + suffix), F.col("end" + suffix)), suffix)


def ends_in(left: DataFrame, right: DataFrame, on: Sequence[str] = ("seq",), width: int = BIN, suffix: str = "_r") -> DataFrame:
    """Pairs in which the interval of ``left`` ends inside that of ``right`` (the in-memory fetch)."""
    return overlap_join(left, right, on, width, F.col("end").between(F.col("start" + suffix), F.col("end" + suffix)), suffix)


def containing_points(points: DataFrame, intervals: DataFrame, pos: str = "pos", on: Sequence[str] = ("seq",), width: int = BIN, suffix: str = "_r") -> DataFrame:
    """Pairs of a point and an interval that contains it."""
    p = points.withColumns({"start": F.col(pos), "end": F.col(pos)})
    return overlap_join(p, intervals, on, width, None, suffix).drop("start", "end")


def _keys(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``left`` with a hash of each row, and the distinct rows by that hash."""
    keyed = left.withColumn("_key", F.xxhash64(*left.columns))
    return keyed, keyed.select("_key", *left.columns).dropDuplicates(["_key"])


def overlap_semi(left: DataFrame, right: DataFrame, on: Sequence[str] = ("seq",), width: int = BIN) -> DataFrame:
    """Rows of ``left`` that overlap a row of ``right``."""
    keyed, distinct = _keys(left)
    met = overlap_join(distinct, right.select(*on, "start", "end"), on, width).select("_key").distinct()
    return keyed.join(met, "_key", "left_semi").drop("_key")


def overlap_anti(left: DataFrame, right: DataFrame, on: Sequence[str] = ("seq",), width: int = BIN) -> DataFrame:
    """Rows of ``left`` that overlap no row of ``right``."""
    keyed, distinct = _keys(left)
    met = overlap_join(distinct, right.select(*on, "start", "end"), on, width).select("_key").distinct()
    return keyed.join(met, "_key", "left_anti").drop("_key")


def clustered(df: DataFrame, on: Sequence[str] = ("seq",), touching: bool = False, gap: int = 0, out: str = "cluster", chunk: int = CHUNK, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with the number, from 1, of each interval's overlap cluster along its sequence.

    A cluster ends where the next start is beyond the largest end so far: with ``touching`` adjacent
    intervals join (start = end + 1), with ``gap`` also those up to so many bases apart.  ``ties`` order
    intervals of equal start and end, which matters only where they don't join.
    """
    reach = gap + (1 if touching else 0)
    order = ["start", "end", *ties]
    seen = max_before(df, on, "start", order, "end", "_reach", chunk)
    fresh = seen.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + reach), 1).otherwise(0)).drop("_reach")
    # rows with equal start and end are alike here but for the first of them, which comes first
    return running_sum(fresh, on, "start", [*order, F.desc("_new")], "_new", out, chunk).drop("_new")


def merged(df: DataFrame, on: Sequence[str] = ("seq",), touching: bool = False, gap: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The union of the intervals as disjoint ones, with the number ``n`` of intervals in each."""
    got = clustered(df.select(*on, "start", "end"), on, touching, gap, "_island", chunk)
    return got.groupBy(*on, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")


def gaps(df: DataFrame, on: Sequence[str] = ("seq",), least: int = 1, most: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """The spaces between the merged intervals of each key, of ``least`` to ``most`` bases."""
    joined = merged(df, on, chunk=chunk)
    nxt = next_value(joined, on, "start", ["start"], "start", "_next", chunk).where("_next is not null")
    out = nxt.select(*on, (F.col("end") + 1).alias("start"), (F.col("_next") - 1).alias("end"))
    size = F.col("end") - F.col("start") + 1
    return out.where((size >= least) & (size <= most) if most is not None else size >= least)


def complement(df: DataFrame, bounds: DataFrame, on: Sequence[str] = ("seq",), chunk: int = CHUNK) -> DataFrame:
    """What of each sequence's ``lo .. hi`` (in ``bounds``) the intervals leave uncovered."""
    edge = bounds.select(*on, (F.col("lo") - 1).alias("start"), (F.col("lo") - 1).alias("end")).unionByName(bounds.select(*on, (F.col("hi") + 1).alias("start"), (F.col("hi") + 1).alias("end")))
    inside = df.select(*on, "start", "end").join(bounds, list(on)).where("end >= lo and start <= hi").select(*on, F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"))
    return gaps(inside.unionByName(edge), on, chunk=chunk)


def coverage(df: DataFrame, on: Sequence[str] = ("seq",), weight: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Maximal steps of constant coverage above 0: ``on, start, end, cov``."""
    w = F.col(weight) if weight else F.lit(1)
    up = df.select(*on, F.col("start").alias("pos"), w.cast("long").alias("d"))
    down = df.select(*on, (F.col("end") + 1).alias("pos"), (-w).cast("long").alias("d"))
    events = up.unionByName(down).groupBy(*on, "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    level = running_sum(events, on, "pos", ["pos"], "d", "cov", chunk)
    step = next_value(level, on, "pos", ["pos"], "pos", "_next", chunk)
    return step.where("cov > 0").select(*on, F.col("pos").alias("start"), (F.col("_next") - 1).alias("end"), "cov")


def covered_bases(df: DataFrame, windows: DataFrame, on: Sequence[str] = ("seq",), width: int = BIN, chunk: int = CHUNK) -> DataFrame:
    """``windows`` with ``covered`` and ``uncovered`` bases; windows are distinct."""
    met = overlap_join(windows.select(*on, "start", "end"), merged(df, on, chunk=chunk), on, width)
    part = F.least("end", "end_r") - F.greatest("start", "start_r") + 1
    sums = met.groupBy(*on, "start", "end").agg(F.sum(part).alias("covered"))
    out = windows.join(sums, [*on, "start", "end"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
    return out.withColumn("uncovered", (F.col("end") - F.col("start") + 1 - F.col("covered")).cast("long"))


def without_nested(df: DataFrame, on: Sequence[str] = ("seq", "strand"), chunk: int = CHUNK) -> DataFrame:
    """Intervals that lie in no other one; of equal intervals one stays."""
    one = df.dropDuplicates([*on, "start", "end"]).withColumn("_back", -F.col("end"))
    seen = max_before(one, on, "start", ["start", "_back"], "end", "_reach", chunk)
    return seen.where("_reach is null or end > _reach").drop("_reach", "_back")


def nearest_after(points: DataFrame, marks: DataFrame, on: Sequence[str] = ("seq",), pos: str = "pos", mark: str = "mark", chunk: int = CHUNK) -> DataFrame:
    """``points`` with ``next_mark``, the first mark of the same key beyond the point (as-of join)."""
    from pyspark.sql import Window

    both = points.select(*[F.col(c) for c in points.columns], F.lit(None).cast("long").alias("_mark"), F.col(pos).cast("long").alias("_at"), F.lit(1).alias("_kind"))
    own = marks.select(*on, F.col(mark).cast("long").alias("_mark")).distinct()
    mine = own.select(*[F.col(c) if c in on else F.lit(None).cast(t).alias(c) for c, t in points.dtypes], "_mark", F.col("_mark").alias("_at"), F.lit(0).alias("_kind"))
    rows = both.unionByName(mine).withColumn("_chunk", F.floor(F.col("_at") / chunk).cast("long"))
    # a mark at the point itself doesn't count: it sorts before the point
    inside = Window.partitionBy(*on, "_chunk").orderBy("_at", "_kind").rowsBetween(1, Window.unboundedFollowing)
    near = rows.withColumn("_near", F.min("_mark").over(inside))
    chunks = rows.groupBy(*on, "_chunk").agg(F.min("_mark").alias("_first"))
    after = Window.partitionBy(*on).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    chunks = chunks.select(*on, "_chunk", F.min("_first").over(after).alias("_later"))
    out = near.where("_kind = 1").join(chunks, [*on, "_chunk"])
    return out.select(*points.columns, F.coalesce("_near", "_later").alias("next_mark"))


def legacy_merge_pieces(df: DataFrame, on: Sequence[str] = ("seq",), chunk: int = CHUNK) -> DataFrame:
    """Union in which an interval that starts where the last one ended, or with it, stays apart."""
    order = ["start", "end"]
    seen = max_before(df.select(*on, "start", "end").distinct(), on, "start", order, "end", "_reach", chunk)
    seen = max_before(seen, on, "start", order, "start", "_last", chunk)
    fresh = seen.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")) | (F.col("start") <= F.col("_last")), 1).otherwise(0))
    got = running_sum(fresh.drop("_reach", "_last"), on, "start", order, "_new", "_island", chunk)
    return got.groupBy(*on, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
