"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import dropped, written


def _pointed(edges: DataFrame, centre: str) -> tuple[DataFrame, DataFrame]:
    """``edges`` (``u, v``) with ``m``, the least node of each ``u``'s star; and the table of those."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), f"components-{centre}")
    # the table of least nodes is read, not aggregated, below the join: hot centres can be split
    return edges.join(least, "u").withColumn("m", F.least("m", "u")), least


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component``: every node of ``edges`` (``u, v``) with the smallest node it reaches.

    Each round reads and writes one edge table; the number of rounds grows with the logarithm of the
    longest chain.  Null nodes and loops are ignored.
    """
    edges = written(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "components-edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star, least = _pointed(both, "large")
        large = star.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "components-stars")
        dropped(edges, least)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        star, least = _pointed(down, "small")
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "components-edges")
        dropped(large, least)
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
