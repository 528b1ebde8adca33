"""Writers: rows become lines inside the tasks, and Spark writes them as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.mode("errorifexists").text(path)


def _text(c: str, default: str = ".") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(default))


def write_fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    """``seq, bases`` as FASTA, wrapped at ``width`` letters."""
    body = F.regexp_replace("bases", f"(.{{{width}}})(?=.)", "$1\n")
    _lines(sequences, F.concat(F.lit(">"), F.col("seq").cast("string"), F.lit("\n"), body), path)


def write_gff(hints: DataFrame, path: str) -> None:
    """Hints as GFF with ``mult``, ``pri``, ``grp`` and ``src`` attributes; unset ones are left out."""
    a = F.concat_ws(
        ";",
        F.when(F.col("mult") > 1, F.concat(F.lit("mult="), F.col("mult").cast("string"))),
        F.when(F.col("priority") >= 0, F.concat(F.lit("pri="), F.col("priority").cast("string"))),
        F.when(F.col("grp").isNotNull(), F.concat(F.lit("grp="), F.col("grp"))),
        F.when(F.col("esource").isNotNull(), F.concat(F.lit("src="), F.col("esource"))),
    )
    _lines(hints, F.concat_ws("\t", *[_text(c) for c in ("seq", "source", "type", "start", "end", "score", "strand", "frame")], a), path)


def write_gtf(segments: DataFrame, path: str, gff3: bool = False) -> None:
    """Segments (``seq, source, type, start, end, score, strand, frame, gid, tid``) as GTF or GFF3, genes together."""
    if gff3:
        a = F.when(F.col("type") == "gene", F.concat(F.lit("ID="), F.col("gid"))).when(F.col("type").isin("transcript", "mRNA"), F.concat(F.lit("ID="), F.col("tid"), F.lit(";Parent="), F.col("gid"))).otherwise(F.concat(F.lit("Parent="), F.col("tid")))
    else:
        a = F.when(F.col("type") == "gene", F.concat(F.lit('gene_id "'), F.col("gid"), F.lit('";'))).otherwise(F.concat(F.lit('transcript_id "'), F.col("tid"), F.lit('"; gene_id "'), F.col("gid"), F.lit('";')))
    rank = F.when(F.col("type") == "gene", 0).when(F.col("type").isin("transcript", "mRNA"), 1).otherwise(2)
    rows = segments.repartition("seq", "gid").sortWithinPartitions("seq", "gid", F.coalesce("tid", F.lit("")), rank, "start")
    _lines(rows, F.concat_ws("\t", *[_text(c) for c in ("seq", "source", "type", "start", "end", "score", "strand", "frame")], a), path)


def write_bed12(segments: DataFrame, path: str) -> None:
    """A transcript per line, its exons as blocks and its coding part thick (0-based, half open)."""
    exon = F.col("type").isin("exon", "CDS", "UTR")
    by = segments.where(exon).groupBy("tid", "seq", "strand").agg(F.min(F.when(F.col("type") == "CDS", F.col("start"))).alias("cs"), F.max(F.when(F.col("type") == "CDS", F.col("end"))).alias("ce"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("x"))
    first, last = F.get("x", F.lit(0))["start"], F.array_max(F.transform("x", lambda b: b["end"]))
    join = lambda f: F.concat(F.array_join(F.transform("x", f), ","), F.lit(","))
    line = F.concat_ws(
        "\t", "seq", (first - 1).cast("string"), last.cast("string"), F.col("tid").cast("string"), F.lit("0"), "strand", (F.coalesce("cs", first) - 1).cast("string"), F.coalesce(F.col("ce"), first - 1).cast("string"), F.lit("0"),
        F.size("x").cast("string"), join(lambda b: (b["end"] - b["start"] + 1).cast("string")), join(lambda b: (b["start"] - first).cast("string")),
    )
    _lines(by, line, path)


def write_wiggle(spans: DataFrame, path: str, track: str = "track") -> None:
    """Spans (``seq, start, end, value``) as variable step lines; each sequence in one file, in order.

    A declaration precedes each span length, so equal neighbours cost one line.
    """
    from pyspark.sql import Window

    size = (F.col("end") - F.col("start") + 1).cast("string")
    by = Window.partitionBy("seq").orderBy("start")
    rows = spans.withColumns({"_size": size, "_old": F.lag(size).over(by)})
    head = F.concat(F.lit("variableStep chrom="), F.col("seq").cast("string"), F.lit(" span="), F.col("_size"), F.lit("\n"))
    line = F.concat(F.when(F.col("_old").isNull(), F.lit(f"track type=wiggle_0 name={track}\n")).otherwise(""), F.when(F.col("_old").isNull() | (F.col("_old") != F.col("_size")), head).otherwise(""), F.col("start").cast("string"), F.lit(" "), F.col("value").cast("string"))
    _lines(rows, line, path)


def write_bedgraph(spans: DataFrame, path: str) -> None:
    """Spans as bedGraph lines (0-based, half open)."""
    rows = spans.repartition("seq").sortWithinPartitions("seq", "start")
    _lines(rows, F.concat_ws("\t", F.col("seq").cast("string"), (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.col("value").cast("string")), path)


def write_genbank(genes: DataFrame, sequences: DataFrame, path: str, flank: int = 0) -> None:
    """Each gene (``gid, seq, strand, parts``) with ``flank`` bases around it as a record of its own.

    ``parts``: sorted ``array<struct<start,end>>`` of its coding parts, 1-based.  Coordinates are those of the piece.
    """
    from ..functions.sequence import pieces, subsequence

    rows = genes.join(sequences.select("seq", "bases"), "seq").withColumns({"_lo": F.greatest(F.get("parts", F.lit(0))["start"] - flank, F.lit(1)), "_hi": F.least(F.element_at("parts", -1)["end"] + flank, F.length("bases"))})
    piece = F.lower(subsequence("bases", "_lo", "_hi"))
    place = F.array_join(F.transform("parts", lambda x: F.concat((x["start"] - F.col("_lo") + 1).cast("string"), F.lit(".."), (x["end"] - F.col("_lo") + 1).cast("string"))), ",")
    place = F.when(F.size("parts") > 1, F.concat(F.lit("join("), place, F.lit(")"))).otherwise(place)
    place = F.when(F.col("strand") == "-", F.concat(F.lit("complement("), place, F.lit(")"))).otherwise(place)
    body = F.array_join(F.transform(pieces(piece, 60), lambda x, i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), x)), "\n")
    name = F.concat_ws("_", F.col("seq").cast("string"), F.col("_lo").cast("string"), F.col("_hi").cast("string"))
    line = F.concat(F.lit("LOCUS       "), name, F.lit("   "), F.length(piece).cast("string"), F.lit(" bp  DNA\nFEATURES             Location/Qualifiers\n     source          1.."), F.length(piece).cast("string"), F.lit("\n     CDS             "), place, F.lit('\n                     /gene="'), F.col("gid").cast("string"), F.lit('"\nORIGIN\n'), body, F.lit("\n//"))
    _lines(rows, line, path)


def write_loci(loci: DataFrame, path: str) -> None:
    """Loci with bases (``locus, genes, bases``, see ``operators.loci``) as GenBank records with a CDS for each gene."""
    from ..functions.sequence import pieces

    span = lambda p: F.concat(p["start"].cast("string"), F.lit(".."), p["end"].cast("string"))

    def feature(g):
        place = F.array_join(F.transform(g["parts"], span), ",")
        place = F.when(F.size(g["parts"]) > 1, F.concat(F.lit("join("), place, F.lit(")"))).otherwise(place)
        place = F.when(g["strand"] == "-", F.concat(F.lit("complement("), place, F.lit(")"))).otherwise(place)
        return F.concat(F.lit("     CDS             "), place, F.lit('\n                     /gene="'), g["gid"], F.lit('"\n'))

    size = F.length("bases").cast("string")
    body = F.array_join(F.transform(pieces(F.lower("bases"), 60), lambda x, i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), x)), "\n")
    head = F.concat(F.lit("LOCUS       "), F.col("locus"), F.lit("   "), size, F.lit(" bp  DNA\nFEATURES             Location/Qualifiers\n     source          1.."), size, F.lit("\n"))
    _lines(loci, F.concat(head, F.array_join(F.transform("genes", feature), ""), F.lit("ORIGIN\n"), body, F.lit("\n//")), path)


def write_genepred(parts: DataFrame, path: str) -> None:
    """Transcripts of gene set rows (``tid, seq, strand, type, start, end``) in genePred's 10 columns.

    Exons are those of type ``exon``, or the ``CDS`` parts of a transcript without any.  Without coding parts the coding range is empty at
    the transcript's end.
    """
    span = F.struct("start", "end")
    only = lambda kind: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("type") == kind, span))))
    rows = parts.where(F.col("type").isin("exon", "CDS") & F.col("tid").isNotNull()).groupBy("tid", "seq", "strand").agg(only("exon").alias("exon"), only("CDS").alias("cds"))
    rows = rows.withColumn("exons", F.when(F.size("exon") > 0, F.col("exon")).otherwise(F.col("cds")))
    text = lambda c: c.cast("string")
    joined = lambda f: F.concat(F.array_join(F.transform("exons", f), ","), F.lit(","))
    end = F.array_max(F.transform("exons", lambda x: x["end"]))
    coding = F.size("cds") > 0
    low, high = F.when(coding, F.get("cds", F.lit(0))["start"] - 1).otherwise(end), F.when(coding, F.array_max(F.transform("cds", lambda x: x["end"]))).otherwise(end)
    line = F.concat_ws(
        "\t", "tid", F.col("seq").cast("string"), "strand", text(F.get("exons", F.lit(0))["start"] - 1), text(end), text(low), text(high), text(F.size("exons")), joined(lambda x: text(x["start"] - 1)), joined(lambda x: text(x["end"])),
    )
    _lines(rows, line, path)
