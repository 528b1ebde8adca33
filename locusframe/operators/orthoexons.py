"""Feature tables of exons with orthologs: one of each place, features by name, and a class against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_join

#: Features of the attribute column and what they are where they are missing.
FEATURES = {
    "MLomega": -1.0, "PMomega": -1.0, "varOmega": -1.0, "cons": 0.0, "div": 0.0, "contain": 0.0, "n": 0.0, "oescore": 0.0, "postProb": 0.0, "mbp": 0.0, "subst": -1.0, "gapProp": 0.0,
}
PLACE = ("seq", "start", "end", "strand", "frame")


def feature(name: str, missing: float) -> Column:
    """The number that ``attributes`` (``key=value;``) has for a name."""
    return F.coalesce(F.regexp_extract("attributes", rf"(?:^|;)\s*{name}=([^;]*)", 1).try_cast("double"), F.lit(missing)).alias(name)


def best_exons(exons: DataFrame) -> DataFrame:
    """Of exons in one place (sequence, range, strand and frame) the one with the most species (``n``), ties to the lesser ``attributes``.

    ``exons``: ``seq, start, end, strand, frame, score, attributes``.  Gene ranges overlap, so places repeat.
    """
    n = F.col("n").cast("double")
    rows = exons.select(*PLACE, "score", "attributes", feature("n", FEATURES["n"])).withColumn("n", n)
    best = F.min(F.struct((-F.col("n")).alias("less"), F.coalesce("attributes", F.lit("")).alias("attributes"), F.col("score").alias("score"))).alias("b")
    return rows.groupBy(*PLACE).agg(best, F.count(F.lit(1)).alias("copies")).select(*PLACE, F.col("b.score").alias("score"), F.col("b.attributes").alias("attributes"), "copies")


def classified(exons: DataFrame, reference: DataFrame, width: int = 1 << 14) -> DataFrame:
    """``exons`` with ``class``, ``left_code`` and ``right_code`` against coding parts of a reference (``seq, start, end, strand, frame``).

    Class 1: a reference part of that range, strand and frame; -1: one that overlaps on the strand in a frame that
    fits; else 0.  Codes tell where a boundary is against the reference part that overlaps, strand aside (the equal one, else the last by
    start, then end): 0 no such part, 1 the same, 2 outside, 3 inside.
    """
    numbered = exons.withColumn("lf_key", F.xxhash64(*PLACE))
    met = overlap_join(numbered.select("lf_key", *PLACE), reference.select(*PLACE).distinct(), ("seq",), width)
    c = F.col
    plus = (c("frame") - c("frame_r") + c("start") - c("start_r")) % 3 == 0
    minus = (c("end_r") - c("end") + c("frame") - c("frame_r")) % 3 == 0
    fits = (c("strand") == c("strand_r")) & F.when(c("strand_r") == "+", plus).when(c("strand_r") == "-", minus).otherwise(False)
    same = fits & (c("start") == c("start_r")) & (c("end") == c("end_r")) & (c("frame") == c("frame_r"))
    top = F.max(F.struct(same.alias("same"), c("start_r"), c("end_r"))).alias("ref")
    found = met.groupBy("lf_key").agg(F.max(same.cast("int")).alias("real"), F.max(fits.cast("int")).alias("half"), top)
    out = numbered.join(found, "lf_key", "left")
    code = lambda own, ref, outside: F.when(c(ref).isNull(), 0).when(c(own) == c(ref), 1).when(outside, 2).otherwise(3)
    return out.select(
        *exons.columns,
        F.when(c("real") == 1, 1).when(c("half") == 1, -1).otherwise(0).alias("class"),
        code("start", "ref.start_r", c("start") < c("ref.start_r")).alias("left_code"),
        code("end", "ref.end_r", c("end") > c("ref.end_r")).alias("right_code"),
    )


def feature_table(exons: DataFrame, reference: DataFrame, features: dict[str, float] = FEATURES, width: int = 1 << 14) -> DataFrame:
    """A row for each place of an exon: its length, copies, features and class (:func:`best_exons`, :func:`classified`)."""
    rows = classified(best_exons(exons), reference, width)
    return rows.select(*PLACE, "score", "copies", (F.col("end") - F.col("start") + 1).alias("length"), *(feature(k, v) for k, v in features.items()), "class", "left_code", "right_code")
