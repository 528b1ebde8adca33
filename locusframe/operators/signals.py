"""Signals along sequences: windows, islands and coverage profiles.

Tables have ``seq, pos, value`` with a row per position, or steps ``seq, start, end, value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import CHUNK
from .scans import running_sum


def sliding_sum(signal: DataFrame, before: int, after: int, value: str = "value", out: str = "sum", block: int = 1 << 14) -> DataFrame:
    """``signal`` with ``out``: the sum of ``value`` over positions ``pos - before .. pos + after``.

    Each block of positions also gets copies of the rows just outside it, so a window runs inside its
    block and a long sequence is spread over many tasks.  ``before`` and ``after`` are below ``block``.
    """
    here = F.floor(F.col("pos") / block)
    blocks = F.array_distinct(F.array(here, F.floor((F.col("pos") - after) / block), F.floor((F.col("pos") + before) / block)))
    dealt = signal.withColumns({"_home": here, "_block": F.explode(blocks)})
    near = Window.partitionBy("seq", "_block").orderBy("pos").rangeBetween(-before, after)
    return dealt.withColumn(out, F.sum(value).over(near)).where("_home = _block").drop("_home", "_block")


def window_identity(columns: DataFrame, rows: int, window: int = 40) -> DataFrame:
    """Percent identity along a reference: ``seq, pos, identity`` from alignment columns ``seq, col,
    pos, same`` (``pos`` null where the reference has a gap; ``same``: other rows equal to it).

    The window runs over columns, its size is the divisor at the edges too, and gaps aren't shown.
    """
    r = window // 2
    summed = sliding_sum(columns.withColumnsRenamed({"pos": "_ref", "col": "pos"}), r, r, "same", "_sum")
    return summed.where("_ref is not null").select("seq", F.col("_ref").alias("pos"), (F.col("_sum") / F.lit((rows - 1) * (2 * r + 1))).alias("identity"))


def islands(signal: DataFrame, threshold: float, gap: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Runs of positions of at least ``threshold``, joined over up to ``gap`` missing positions:
    ``seq, start, end, n, total``."""
    from .intervals import clustered

    high = signal.where(F.col("value") >= threshold).withColumns({"start": F.col("pos"), "end": F.col("pos")})
    got = clustered(high, ("seq",), touching=True, gap=gap, out="_island", chunk=chunk)
    return got.groupBy("seq", "_island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).drop("_island")


def best_island(signal: DataFrame, threshold: float, gap: int = 0) -> DataFrame:
    """The island of the largest total of each sequence; the first of equal ones."""
    best = F.max_by(F.struct("start", "end", "total"), F.struct("total", (-F.col("start")).alias("s"))).alias("_b")
    return islands(signal, threshold, gap).groupBy("seq").agg(best).select("seq", "_b.*")


def island_hints(signal: DataFrame, threshold: float = 0.4, margin: int = 20, width: int = 40, least: float = 0.4, bin_width: int = 1 << 10) -> DataFrame:
    """Evenly spaced hints inside islands: ``seq, start, end, score``.

    An island loses ``margin`` at both ends, is cut into ``int(length / width)`` pieces, at least one,
    and each piece whose mean signal is above ``least`` is a hint.  ``signal`` has a row for each position (``seq, pos, value``) or disjoint
    spans of equal value (``seq, start, end, value``), which stay whole: spans and pieces, which are
    under twice ``width`` long, meet by bins of ``bin_width``.
    """
    from ..tables import written
    from .intervals import merged, overlap_join

    spans = signal if "pos" not in signal.columns else signal.withColumns({"start": F.col("pos"), "end": F.col("pos")})
    # read by islands and by their pieces
    spans = written(spans.select("seq", "start", "end", "value"), "island-spans")
    islands_ = merged(spans.where(F.col("value") >= threshold), ("seq",), touching=True)
    trimmed = islands_.select("seq", (F.col("start") + margin).alias("s"), (F.col("end") - margin).alias("e")).where("s <= e")
    n = F.greatest(F.floor((F.col("e") - F.col("s") + 1) / width), F.lit(1)).cast("int")
    piece = trimmed.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    size = (F.col("e") - F.col("s") + 1) / F.col("n")
    piece = piece.select("seq", (F.col("s") + F.floor(F.col("i") * size)).cast("long").alias("start"), (F.col("s") + F.floor((F.col("i") + 1) * size) - 1).cast("long").alias("end"))
    met = overlap_join(piece, spans, ("seq",), bin_width)
    total = F.sum(F.col("value_r") * (F.least("end", "end_r") - F.greatest("start", "start_r") + 1))
    return met.groupBy("seq", "start", "end").agg((total / (F.max("end") - F.max("start") + 1)).alias("score")).where(F.col("score") > least)


def steepest_decline(signal: DataFrame, window: int, by: str = "tid") -> DataFrame:
    """For each spliced axis (``by, pos, value``): the position where coverage falls most, ``at, drop``.

    ``drop`` is the least of ``(c[k+w] + c[k-w] - 2 c[k]) / w ** 2`` over cumulative coverage ``c``; the
    first position wins.  Axes are as long as a transcript end.
    """
    along = Window.partitionBy(by).orderBy("pos")
    c = F.sum("value").over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = signal.withColumn("_c", c).withColumns({"_n": F.lead("_c", window).over(along), "_p": F.lag("_c", window).over(along)})
    drop = (F.col("_n") + F.col("_p") - 2 * F.col("_c")) / (window * window)
    found = rows.where("_n is not null and _p is not null").withColumn("_d", drop)
    return found.groupBy(by).agg(F.min(F.struct("_d", "pos")).alias("_m")).select(by, F.col("_m.pos").alias("at"), F.col("_m._d").alias("drop"))


def first_empty(signal: DataFrame, by: str = "tid") -> DataFrame:
    """The first position without coverage on each axis."""
    return signal.where("value <= 0").groupBy(by).agg(F.min("pos").alias("at"))


def run_lengths(signal: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Positions as spans of equal value: ``seq, start, end, value``."""
    from .intervals import clustered

    one = signal.withColumns({"start": F.col("pos"), "end": F.col("pos")})
    got = clustered(one, ("seq", "value"), touching=True, out="_run", chunk=chunk)
    return got.groupBy("seq", "value", "_run").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).select("seq", "start", "end", "value")


def spread(spans: DataFrame) -> DataFrame:
    """Spans as a row per position."""
    return spans.withColumn("pos", F.explode(F.sequence("start", "end"))).drop("start", "end")


def coverage_jumps(steps: DataFrame, ratio: float, longest: int, chunk: int = CHUNK) -> DataFrame:
    """Neighbouring steps of a coverage track (``seq, start, end, value``) between which it jumps:
    ``value_next >= value * ratio`` or ``value / ratio < value_next``, none longer than ``longest``."""
    from .scans import next_value

    rows = steps
    for column in ("start", "end", "value"):
        rows = next_value(rows, ["seq"], "start", ["start"], column, f"{column}_next", chunk)
    short = (F.col("end") - F.col("start") < longest) & (F.col("end_next") - F.col("start_next") < longest)
    jump = (F.col("value_next") >= F.col("value") * ratio) | (F.col("value") / ratio < F.col("value_next"))
    return rows.where((F.col("start_next") == F.col("end") + 1) & short & jump)


def prefix_counts(flags: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``flags`` (``seq, pos, value``) with ``total``: the running count, for range queries by difference."""
    return running_sum(flags, ["seq"], "pos", ["pos"], "value", "total", chunk)
