"""Multiple alignments as rows: ``block, species, seq, start, size, strand, src_size, text``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join

#: Fixed value: code point of a gap.
GAP = ord("-")


def filtered(maf: DataFrame, species: list[str] | None = None, least_rows: int = 2, regions: DataFrame | None = None) -> DataFrame:
    """Blocks with at least ``least_rows`` rows of ``species`` that (their forward span) overlap a region.

    ``regions``: ``species, seq, lo, hi``, 0-based half open on the forward strand.
    """
    rows = maf.where(F.col("species").isin(species)) if species else maf
    size = rows.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_rows).select("block")
    rows = rows.join(size, "block", "left_semi")
    if regions is None:
        return rows
    lo = F.when(F.col("strand") == "-", F.col("src_size") - F.col("start") - F.col("size")).otherwise(F.col("start"))
    spans = rows.select("block", "species", "seq", lo.alias("start"), (lo + F.col("size") - 1).alias("end"))
    hit = overlap_join(spans, regions.select("species", "seq", F.col("lo").alias("start"), (F.col("hi") - 1).alias("end")), ("species", "seq"))
    return rows.join(hit.select("block").distinct(), "block", "left_semi")


def without_gap_columns(maf: DataFrame) -> DataFrame:
    """Rows without the columns in which all rows of their block have gaps."""
    rows = maf.where("block is not null").groupBy("block").agg(F.collect_list(F.struct(*maf.columns)).alias("rows"))
    names, at = maf.columns, maf.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0)
            for k in range(len(blocks)):
                own = blocks[k].values
                texts = [None if t is None else _letters(t) for t in own.field(at).to_pylist()]
                width = max((len(t) for t in texts if t is not None), default=0)
                keep = np.zeros(width, bool)
                for t in texts:
                    if t is not None:
                        keep[: len(t)] |= t != GAP
                if keep.any():
                    cut = [None if t is None else t[keep[: len(t)]].tobytes().decode("utf-32-le") for t in texts]
                    columns = [pa.array(cut, pa.string()) if i == at else own.field(i) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("rows").mapInArrow(run, maf.schema)


def conservation(maf: DataFrame, n_species: int) -> DataFrame:
    """``block, i, score``: ``(1 - H / 2) * present / n_species`` of each column, H in bits over ACGT.

    Absent rows count in the divisor.
    """
    rows = maf.where("text is not null").groupBy("block").agg(F.collect_list(F.upper("text")).alias("texts"))
    kind = dict(maf.dtypes)["block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, blocks = batch.column(0), batch.column(1)
            for k in range(len(blocks)):
                texts = [_letters(t) for t in blocks[k].as_py()]
                counts = np.zeros((4, max(len(t) for t in texts)))
                for t in texts:
                    for c, letter in enumerate(b"ACGT"):
                        counts[c, : len(t)] += t == letter
                total = counts.sum(axis=0)
                at = np.flatnonzero(total)
                n, t = counts[:, at], total[at]
                entropy = np.log2(t) - (n * np.log2(np.maximum(n, 1))).sum(axis=0) / t
                score = (1 - entropy / 2) * t / n_species
                yield pa.RecordBatch.from_arrays([pa.repeat(names[k], len(at)), pa.array(at, pa.int32()), pa.array(score)], ["block", "i", "score"])

    return rows.mapInArrow(run, f"block {kind}, i int, score double")


def _letters(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def ortho_tuples(candidates: DataFrame, least: int = 2) -> DataFrame:
    """Exon candidates (``species, akey, cid``) of equal alignment key in at least ``least`` species.

    ``members`` is sorted by species; a key that one species has twice is an error of the input and left out.
    """
    by = candidates.groupBy("akey").agg(F.countDistinct("species").alias("n"), F.count(F.lit(1)).alias("_all"), F.array_sort(F.collect_list(F.struct("species", "cid"))).alias("members"))
    return by.where((F.col("n") >= least) & (F.col("n") == F.col("_all"))).drop("_all")


def joined_neighbours(blocks: DataFrame, most: int = 9) -> DataFrame:
    """``block, joined``: consecutive blocks along a reference as one while all rows they share go on
    after 0 to ``most`` bases.  ``blocks``: ``ref, ref_start, block, rows map<species, struct<seq, strand, start, end>>`` (half open)."""
    by = Window.partitionBy("ref").orderBy("ref_start", "block")
    rows = blocks.withColumn("_prev", F.lag("rows").over(by))
    shared = F.array_intersect(F.map_keys("rows"), F.map_keys("_prev"))

    def goes_on(k):
        a, b = F.element_at("_prev", k), F.element_at("rows", k)
        return (a["seq"] == b["seq"]) & (a["strand"] == b["strand"]) & (b["start"] - a["end"]).between(0, most)

    fresh = F.when(F.col("_prev").isNull() | (F.size(shared) == 0) | ~F.forall(shared, goes_on), 1).otherwise(0)
    numbered = rows.withColumn("_new", fresh).withColumn("joined", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.select("ref", "block", "joined")


#: Fixed value: the order of residues in profiles.
RESIDUES = "GDERKNQSTAVLIFYWHMCP"


def profile(alignment: DataFrame, pseudo: float = 1.0, letters: str = RESIDUES, most_gaps: float = 0.5) -> DataFrame:
    """Protein alignment rows (``text``) as a profile: ``block, col, aa, prob``.

    Columns with a larger share of gaps than ``most_gaps`` part the blocks; pseudocounts are spread evenly.
    """
    cells = alignment.select(F.posexplode(F.split(F.upper("text"), "")).alias("i", "aa"))
    counts = cells.groupBy("i", "aa").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.groupBy("i").agg(F.sum(F.when(F.col("aa").isin(*letters), F.col("n")).otherwise(0)).alias("t"), F.sum("n").alias("rows"))
    good = stats.where(F.col("t") >= (1 - most_gaps) * F.col("rows"))
    # an alignment has as many columns as a protein has residues
    by = Window.orderBy("i")
    good = good.withColumn("_g", F.col("i") - F.row_number().over(by)).withColumn("block", (F.dense_rank().over(Window.orderBy("_g")) - 1).cast("int"))
    good = good.withColumn("col", (F.col("i") - F.min("i").over(Window.partitionBy("block"))).cast("int"))
    each = good.withColumn("aa", F.explode(F.array(*[F.lit(x) for x in letters])))
    return each.join(counts, ["i", "aa"], "left").select("block", "col", "aa", ((F.coalesce("n", F.lit(0)) + pseudo / len(letters)) / (F.col("t") + pseudo)).alias("prob"))


def profile_hits(proteins: DataFrame, profile_table: DataFrame, background: float = 0.05) -> DataFrame:
    """``seq, block, pos, score``: log odds of each place of a block in each protein (``seq, bases``).

    The profile is a small table.
    """
    size = profile_table.groupBy("block").agg((F.max("col") + 1).alias("width"))
    letters = proteins.select("seq", F.length("bases").alias("len"), F.posexplode(F.split(F.upper("bases"), "")).alias("i", "aa"))
    met = letters.join(F.broadcast(profile_table.join(size, "block")), "aa")
    pos = F.col("i") - F.col("col")
    met = met.withColumn("pos", pos).where((F.col("pos") >= 0) & (F.col("pos") + F.col("width") <= F.col("len")))
    return met.groupBy("seq", "block", "pos", "width").agg(F.sum(F.log2(F.col("prob") / background)).alias("score"), F.count(F.lit(1)).alias("_n")).where("_n = width").drop("_n", "width")
