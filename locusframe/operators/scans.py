"""Running totals along an axis, in two levels.

A window over a whole sequence puts the sequence into one task.  Here the axis is cut into chunks:
windows run inside (key, chunk), the chunks' totals run along the key, and both are put together.
The second level has a row for each chunk, so one long sequence is shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _chunked(df: DataFrame, axis: str, width: int) -> DataFrame:
    return df.withColumn("_scan_chunk", F.floor(F.col(axis) / width).cast("long"))


def _levels(df: DataFrame, by: Sequence[str], axis: str, order: Sequence[str], width: int, value: Column, total: Column, outer: Column, last: int) -> DataFrame:
    """``_in``: the running ``value`` inside the chunk up to row offset ``last``; ``_before``: that of the chunks before."""
    rows = _chunked(df, axis, width)
    inside = Window.partitionBy(*by, "_scan_chunk").orderBy(*order)
    rows = rows.withColumn("_scan_in", value.over(inside.rowsBetween(Window.unboundedPreceding, last)))
    chunks = _chunked(df, axis, width).groupBy(*by, "_scan_chunk").agg(total.alias("_scan_total"))
    before = Window.partitionBy(*by).orderBy("_scan_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_scan_before", outer.over(before)).drop("_scan_total")
    return rows.join(chunks, [*by, "_scan_chunk"]).drop("_scan_chunk")


def running_sum(df: DataFrame, by: Sequence[str], axis: str, order: Sequence[str], value: str, out: str, width: int) -> DataFrame:
    """``out``: sum of ``value`` over the rows up to this one, along ``axis`` within ``by``.

    ``order`` starts with ``axis`` and must be total among rows of different value.
    """
    got = _levels(df, by, axis, order, width, F.sum(value), F.sum(value), F.sum("_scan_total"), Window.currentRow)
    return got.withColumn(out, F.coalesce("_scan_in", F.lit(0)) + F.coalesce("_scan_before", F.lit(0))).drop("_scan_in", "_scan_before")


def max_before(df: DataFrame, by: Sequence[str], axis: str, order: Sequence[str], value: str, out: str, width: int) -> DataFrame:
    """``out``: the largest ``value`` of the rows before this one, null for the first."""
    got = _levels(df, by, axis, order, width, F.max(value), F.max(value), F.max("_scan_total"), -1)
    return got.withColumn(out, F.greatest("_scan_in", "_scan_before")).drop("_scan_in", "_scan_before")


def next_value(df: DataFrame, by: Sequence[str], axis: str, order: Sequence[str], value: str, out: str, width: int) -> DataFrame:
    """``out``: ``value`` of the next row, null for the last."""
    rows = _chunked(df, axis, width)
    inside = Window.partitionBy(*by, "_scan_chunk").orderBy(*order)
    rows = rows.withColumns({"_scan_next": F.lead(value).over(inside), "_scan_last": F.lead(F.lit(1)).over(inside).isNull()})
    first = F.min(F.struct(*order, F.col(value).alias("_v")))
    chunks = _chunked(df, axis, width).groupBy(*by, "_scan_chunk").agg(first.alias("_scan_first"))
    after = Window.partitionBy(*by).orderBy("_scan_chunk")
    chunks = chunks.select(*by, "_scan_chunk", F.lead("_scan_first._v").over(after).alias("_scan_after"))
    return rows.join(chunks, [*by, "_scan_chunk"]).withColumn(out, F.when(F.col("_scan_last"), F.col("_scan_after")).otherwise(F.col("_scan_next"))).drop("_scan_next", "_scan_last", "_scan_after", "_scan_chunk")
