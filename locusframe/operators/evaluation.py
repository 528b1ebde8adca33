"""Accuracy of predicted structures against annotated ones, at base, exon and transcript level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import BIN, CHUNK, merged, overlap_join

NEAR, MAX_UTR_DISTANCE = 20, 5000


def exon_classes(predicted: DataFrame, annotated: DataFrame, near: int = NEAR, width: int = BIN) -> DataFrame:
    """``predicted`` with ``class``: 4 exact, 3 both ends within ``near``, 2 one end equal, 1 overlap,
    0 none; the best over annotated exons of the sequence and strand.

    Ends within ``near`` count without overlap too.  An equal end is always an overlap, by that base at
    least.  With the two sides swapped it gives the classes of annotated exons: those below 4 are false
    negatives.
    """
    one = predicted.select("seq", "strand", F.col("start").alias("_s"), F.col("end").alias("_e"), (F.col("start") - near).alias("start"), (F.col("end") + near).alias("end")).distinct()
    met = overlap_join(one, annotated.select("seq", "strand", "start", "end").distinct(), ("seq", "strand"), width)
    met = met.drop("start", "end").withColumnsRenamed({"_s": "start", "_e": "end"})
    overlap = (F.col("start") <= F.col("end_r")) & (F.col("start_r") <= F.col("end"))
    left, right = F.abs(F.col("start") - F.col("start_r")), F.abs(F.col("end") - F.col("end_r"))
    kind = F.when((left == 0) & (right == 0), 4).when((left <= near) & (right <= near), 3).when((left == 0) | (right == 0), 2).when(overlap, 1).otherwise(0)
    best = met.groupBy("seq", "strand", "start", "end").agg(F.max(kind).alias("class"))
    return predicted.join(best, ["seq", "strand", "start", "end"], "left").withColumn("class", F.coalesce("class", F.lit(0)))


def base_counts(predicted: DataFrame, annotated: DataFrame, width: int = BIN, chunk: int = CHUNK) -> DataFrame:
    """``tp, fp, fn`` bases by sequence and strand."""
    on = ("seq", "strand")
    p, a = merged(predicted, on, chunk=chunk), merged(annotated, on, chunk=chunk)
    size = F.sum(F.col("end") - F.col("start") + 1)
    tp = overlap_join(p, a, on, width).groupBy(*on).agg(F.sum(F.least("end", "end_r") - F.greatest("start", "start_r") + 1).alias("tp"))
    both = p.groupBy(*on).agg(size.alias("np")).join(a.groupBy(*on).agg(size.alias("na")), list(on), "full_outer").join(tp, list(on), "left").na.fill(0)
    return both.select(*on, F.col("tp").cast("long").alias("tp"), (F.col("np") - F.col("tp")).cast("long").alias("fp"), (F.col("na") - F.col("tp")).cast("long").alias("fn"))


def exon_counts(predicted: DataFrame, annotated: DataFrame) -> DataFrame:
    """``tp, fp, fn`` of distinct exons equal in place and strand, over everything."""
    key = ["seq", "strand", "start", "end"]
    p, a = predicted.select(*key).distinct().withColumn("_p", F.lit(1)), annotated.select(*key).distinct().withColumn("_a", F.lit(1))
    both = p.join(a, key, "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    has_p, has_a = F.col("_p").isNotNull(), F.col("_a").isNotNull()
    return both.agg(count(has_p & has_a).alias("tp"), count(has_p & ~has_a).alias("fp"), count(~has_p & has_a).alias("fn"))


def chain_counts(predicted: DataFrame, annotated: DataFrame) -> DataFrame:
    """``tp, predicted, annotated`` of transcripts by their whole exon chain (``chain``, ``complete``).

    A predicted chain is true only if it is complete; predictions are counted once for each chain.
    """
    p = predicted.groupBy("chain").agg(F.max(F.col("complete").cast("int")).alias("complete"))
    a = annotated.select("chain").distinct().withColumn("_a", F.lit(1))
    both = p.join(a, "chain", "full_outer")
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return both.agg(one((F.col("complete") == 1) & F.col("_a").isNotNull()).alias("tp"), one(F.col("complete").isNotNull()).alias("predicted"), one(F.col("_a").isNotNull()).alias("annotated"))


def boundary_distances(predicted: DataFrame, annotated: DataFrame) -> DataFrame:
    """Distance of UTR ends of transcripts with the same coding boundary (``seq, strand, cds_end, utr_end``)."""
    a = annotated.select("seq", "strand", "cds_end", F.col("utr_end").alias("utr_a"))
    return predicted.join(a, ["seq", "strand", "cds_end"]).withColumn("distance", F.abs(F.col("utr_end") - F.col("utr_a")).cast("long")).drop("utr_a")


def capped_distances(distances: DataFrame, by: list[str], cap: int = MAX_UTR_DISTANCE) -> DataFrame:
    """``by, n, mean, median``: distances above ``cap`` count as it; the median is the first distance
    at which twice the cumulated count reaches ``n``."""
    from pyspark.sql import Window

    bins = distances.select(*by, F.least("distance", F.lit(cap)).cast("long").alias("d")).groupBy(*by, "d").agg(F.count(F.lit(1)).alias("c"))
    along = Window.partitionBy(*by).orderBy("d")
    rows = bins.withColumns({"_cum": F.sum("c").over(along), "_n": F.sum("c").over(Window.partitionBy(*by))})
    return rows.groupBy(*by).agg(F.max("_n").alias("n"), (F.sum(F.col("c") * F.col("d")) / F.max("_n")).alias("mean"), F.min(F.when(2 * F.col("_cum") >= F.col("_n"), F.col("d"))).alias("median"))


def source_accuracy(hints: DataFrame, features: DataFrame) -> DataFrame:
    """``esource, type, correct, wrong``: hints with and without an annotated feature of equal place."""
    key = ["seq", "type", "start", "end"]
    known = features.select(*key).distinct().withColumn("_k", F.lit(1))
    rows = hints.join(known, key, "left")
    n = lambda c: F.sum(c.cast("long")).cast("long")
    return rows.groupBy("esource", "type").agg(n(F.col("_k").isNotNull()).alias("correct"), n(F.col("_k").isNull()).alias("wrong"))


def rates(counts: DataFrame) -> DataFrame:
    """``counts`` with ``sensitivity, specificity, f_score`` from ``tp, fp, fn``."""
    from ..functions.scores import f_score

    sn = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    sp = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    return counts.withColumns({"sensitivity": sn, "specificity": sp}).withColumn("f_score", f_score("sensitivity", "specificity"))
