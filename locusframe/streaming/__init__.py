"""Streaming forms of collapsing and coverage, with watermarks.

The batch operators need no sorted input; these keep state only as long as late rows may come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapsed_stream(hints: DataFrame, event_time: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Hints of equal place, type, strand, frame and source within a window of event time, collapsed;
    rows later than ``late`` are dropped."""
    key = ["seq", "type", "start", "end", "strand", "frame", "esource"]
    return hints.withWatermark(event_time, late).groupBy(F.window(event_time, window), *key).agg(F.sum(F.coalesce("mult", F.lit(1))).cast("long").alias("mult"))


def coverage_events_stream(intervals: DataFrame, event_time: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Coverage changes by position and window of event time: ``window, seq, pos, d``; their running
    sum along ``pos`` is the coverage, which a batch over the written events takes."""
    rows = intervals.withWatermark(event_time, late)
    change = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d"))))
    return rows.select(event_time, "seq", change.alias("c")).groupBy(F.window(event_time, window), "seq", F.col("c.pos").alias("pos")).agg(F.sum("c.d").cast("long").alias("d"))


def first_seen_stream(rows: DataFrame, key: list[str], event_time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key, duplicates within the watermark dropped."""
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(key)
