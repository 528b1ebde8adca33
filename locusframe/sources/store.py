"""A genome store: sequences in chunks, hints and names as Parquet tables partitioned by species.

Loading writes partitions, deleting a species overwrites its partition with nothing, and fetching is a
join that reads only the species' partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import in_region
from ..operators.sequences import chunked, fetch_chunks
from ..tables import written

CHUNK_BASES = 50_000


def dimension(values: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """``column, key``: surrogate keys of the distinct values, new ones, in order, after those ``known`` (same columns).

    Values are dealt by ranges, numbered inside each, and moved on by what the ranges before hold, so that no
    task has all of them; what one window orders is a row for each range.
    """
    from pyspark.sql import Window

    new = values.select(column).where(F.col(column).isNotNull()).distinct()
    if known is not None:
        new = new.join(known, column, "left_anti")
    new = written(new.repartitionByRange(column).withColumn("_range", F.spark_partition_id()), "dimension")
    sizes = new.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    numbered = new.withColumn("_place", inside).join(before, "_range").select(column, (F.col("_place") + F.col("_before")).cast("long").alias("key"))
    if known is None:
        return numbered
    top = known.agg(F.coalesce(F.max("key"), F.lit(0)).alias("_top"))
    return known.select(column, "key").unionByName(numbered.join(F.broadcast(top)).select(column, (F.col("key") + F.col("_top")).alias("key")))


@dataclass
class GenomeStore:
    """Tables under ``path``: ``genomes`` (``species, seq, offset, bases``) and ``hints``."""

    spark: SparkSession
    path: str

    def _write(self, df: DataFrame, name: str, replace: bool) -> None:
        writer = df.write.partitionBy("species")
        if replace:
            writer = writer.option("partitionOverwriteMode", "dynamic").mode("overwrite")
        else:
            writer = writer.mode("append")
        writer.parquet(f"{self.path}/{name}")

    def load_genome(self, species: str, sequences: DataFrame, size: int = CHUNK_BASES, replace: bool = True) -> None:
        """Store ``sequences`` (``seq, bases``) of a species in chunks."""
        self._write(chunked(sequences, size).withColumn("species", F.lit(species)), "genomes", replace)

    def load_hints(self, species: str, hints: DataFrame, replace: bool = False) -> None:
        """Store hints; those equal in every column of the key stay once."""
        key = ["seq", "source", "type", "start", "end", "score", "strand", "frame", "priority", "grp", "mult", "esource"]
        self._write(hints.select(*key).dropDuplicates().withColumn("species", F.lit(species)), "hints", replace)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def species(self) -> list[str]:
        return sorted(r["species"] for r in self.table("genomes").select("species").distinct().collect())

    def delete(self, species: str) -> None:
        """Take a species out of all tables."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in ("genomes", "hints"):
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/species={species}")
            p.getFileSystem(conf).delete(p, True)

    def bases(self, species: str, regions: DataFrame) -> DataFrame:
        """``rid, bases`` of regions (``rid, seq, start, end``)."""
        return fetch_chunks(self.table("genomes").where(F.col("species") == species).drop("species"), regions)

    def hints(self, species: str, regions: DataFrame, mode: str = "overlap") -> DataFrame:
        """Hints of the species in each region."""
        return in_region(self.table("hints").where(F.col("species") == species).drop("species"), regions, mode)

    def orphan_sequences(self) -> DataFrame:
        """``species, seq`` with hints but without a sequence."""
        return self.table("hints").select("species", "seq").distinct().join(self.table("genomes").select("species", "seq").distinct(), ["species", "seq"], "left_anti")
