"""Annotated stretches: genes with flanks that end in the middle between neighbours, in coordinates of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import clustered
from .sequences import fetch_chunks

GENES = "array<struct<gid:string,strand:string,parts:array<struct<start:bigint,end:bigint>>>>"


def flanked_loci(parts: DataFrame, lengths: DataFrame, flank: int) -> DataFrame:
    """``locus, seq, start, end, genes``: genes that overlap, with ``flank`` bases around them at most.

    ``parts``: ``gid, seq, strand, start, end`` of coding parts; ``lengths``: ``seq, length``.  Genes overlap by their whole spans, on either
    strand.  A flank ends at the sequence's end and in the middle between two neighbours, so loci never overlap.  ``genes`` have their
    parts in order, in coordinates of the locus.  A gene is on one strand of one sequence; other rows of its name are another gene.
    """
    genes = parts.where("start <= end").groupBy("gid", "seq", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("parts"))
    rows = clustered(genes, ("seq",), out="_locus")
    spans = rows.groupBy("seq", "_locus").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.collect_list(F.struct("start", "gid", "strand", "parts")).alias("genes"))
    along = Window.partitionBy("seq").orderBy("lo")
    spans = spans.withColumns({"_before": F.lag("hi").over(along), "_after": F.lead("lo").over(along)}).join(lengths.select("seq", "length"), "seq")
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    start = F.greatest(F.lit(1), F.col("lo") - flank, F.coalesce(middle("_before", "lo") + 1, F.lit(1)))
    end = F.least(F.col("length"), F.col("hi") + flank, F.coalesce(middle("hi", "_after"), F.col("length")))
    spans = spans.select("seq", start.alias("start"), end.alias("end"), F.array_sort("genes").alias("genes"))
    shifted = lambda g: F.struct(g["gid"].cast("string").alias("gid"), g["strand"].alias("strand"), F.transform(g["parts"], lambda p: F.struct((p["start"] - F.col("start") + 1).alias("start"), (p["end"] - F.col("start") + 1).alias("end"))).alias("parts"))
    name = F.concat_ws("_", F.col("seq").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"))
    return spans.select(name.alias("locus"), "seq", "start", "end", F.transform("genes", shifted).alias("genes"))


def with_bases(loci: DataFrame, chunks: DataFrame) -> DataFrame:
    """``loci`` with their ``bases``, fetched from stored chunks (``seq, offset, bases``)."""
    got = fetch_chunks(chunks, loci.select(F.col("locus").alias("rid"), "seq", "start", "end"))
    return loci.join(got.withColumnRenamed("rid", "locus"), "locus")


def gene_parts(records: DataFrame) -> DataFrame:
    """``gid, seq, strand, start, end, length``: coding parts of records (see ``read_genbank``) in coordinates of the sequence.

    A record's name ends in its first and last base, as :func:`flanked_loci` names it; of other records it is the sequence, and
    coordinates stay.  Features other than ``CDS`` are left out.
    """
    name = r"^(.*)_(\d+)_(\d+)$"
    ours = F.col("seq").rlike(name)
    offset = F.when(ours, F.regexp_extract("seq", name, 2).try_cast("long") - 1).otherwise(F.lit(0))
    rows = records.select(F.when(ours, F.regexp_extract("seq", name, 1)).otherwise(F.col("seq")).alias("seq"), offset.alias("_at"), "length", F.explode("features").alias("f")).where("f.kind = 'CDS'")
    rows = rows.select(F.col("f.gene").alias("gid"), "seq", F.col("f.strand").alias("strand"), "_at", "length", F.explode("f.parts").alias("p"))
    return rows.select("gid", "seq", "strand", (F.col("p.start") + F.col("_at")).alias("start"), (F.col("p.end") + F.col("_at")).alias("end"), "length")
