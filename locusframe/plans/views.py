"""The driver's tables in the roles of genomic ones, as DataFrames and as SQL for the oracle.

Intervals: sequence = supplier, start = days since 1992-01-01, length = quantity, strand by return flag.
Sequences: letters of the documents, DNA by a fixed translation of the alphabet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins and chunks for an axis of days.
WIDTH, CHUNK = 64, 512
#: Fixed value: how letters become bases.
LETTERS, AS_DNA = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"
TYPE_OF = ("exonpart", "exon", "intronpart", "intron", "CDS", "CDSpart", "UTRpart")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, seq, start, end, strand, src, score, mult, type, priority``."""
    t = table(spark, sf_dir, "lineitem")
    start = F.date_diff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long")
    return t.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_suppkey").alias("seq"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("long") - 1).alias("end"),
        F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "N", "-").otherwise(".").alias("strand"),
        F.col("l_linestatus").alias("src"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_orderkey") % 3 + 1).cast("long").alias("mult"),
        F.element_at(F.array(*[F.lit(x) for x in TYPE_OF]), F.col("l_linenumber").cast("int") % len(TYPE_OF) + 1).alias("type"),
        F.col("l_linenumber").cast("long").alias("priority"),
    )


IV = f"""iv as (
  select l_orderkey * 10 + l_linenumber as id, l_suppkey as seq,
    date_diff('day', date '1992-01-01', l_shipdate::date)::bigint as s,
    date_diff('day', date '1992-01-01', l_shipdate::date)::bigint + l_quantity::bigint - 1 as e,
    case l_returnflag when 'A' then '+' when 'N' then '-' else '.' end as strand, l_linestatus as src, l_extendedprice as score,
    (l_orderkey % 3 + 1)::bigint as mult,
    (array[{", ".join(repr(x) for x in TYPE_OF)}])[l_linenumber::int % {len(TYPE_OF)} + 1] as type, l_linenumber::bigint as priority
  from lineitem)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rid, seq, start, end``: a hundred days for each supplier and year."""
    t = table(spark, sf_dir, "supplier")
    return t.select(F.col("s_suppkey").alias("seq"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("y")).select((F.col("seq") * 10 + F.col("y")).alias("rid"), "seq", (F.col("y") * 365 + 30).cast("long").alias("start"), (F.col("y") * 365 + 129).cast("long").alias("end"))


REGIONS = """regions as (
  select s_suppkey * 10 + y as rid, s_suppkey as seq, (y * 365 + 30)::bigint as rs, (y * 365 + 129)::bigint as re
  from supplier, (select unnest(range(7)) as y))"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, bases``: DNA of both cases from a document's letters."""
    t = table(spark, sf_dir, "documents")
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    return t.select(F.col("doc_id").alias("seq"), F.translate(letters, LETTERS + LETTERS.upper(), AS_DNA + AS_DNA.upper()).alias("bases"))


SEQ = f"""sequences as (
  select doc_id as seq, translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{LETTERS + LETTERS.upper()}', '{AS_DNA + AS_DNA.upper()}') as bases
  from documents)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, pos, value``: number of lines a supplier ships on a day."""
    return intervals(spark, sf_dir).groupBy("seq", F.col("start").alias("pos")).agg(F.count(F.lit(1)).cast("long").alias("value"))


SIGNAL = "signal as (select seq, s as pos, count(*) as value from iv group by seq, s)"
