"""A training corpus from raw documents: five stages, each a table of its own.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``, whatever
others there are.  An empty table gives an empty table.  Rows are told apart by their columns, not by
``doc_id``: null ids and ids that repeat are allowed in each stage, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from locusframe.llm._store import written

#: Near duplicates share this percentage of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: A text whose language is less probable than this is rejected, as are texts without letters.
MIN_LANGUAGE_SCORE = 0.5


def _all(docs: DataFrame) -> list[Column]:
    """All columns, also those with a dot in their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is determined: null and empty texts go.  Each row is judged by its own text."""
    keyed = docs.withColumn("lf_row", F.struct(*_all(docs)))
    found = language_id.identify(keyed, language_id.training_sample(docs), "lf_row", "text")
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("lf_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document has; documents left without a word go.

    Rows that repeat a ``doc_id`` are one document, and rows without one stay as they are.
    """
    cleaned = line_dedup.dedup_lines(docs)
    left = cleaned.withColumn("text", F.when(F.col("lf_n_dropped") > 0, F.col("lf_kept")).otherwise(F.col("text")))
    left = left.where((F.col("lf_n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("lf_n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*_all(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest ``doc_id``, of each group of near duplicates.

    Of rows equal in ``doc_id`` and text one stays.  Rows that share a ``doc_id`` with other texts are
    nodes of their own; rows without one take no part and stay.
    """
    found = jaccard_join.jaccard_join(docs.select("doc_id", "text"), size=NEAR_WORDS, percent=NEAR_PERCENT)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*_all(docs))
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "corpus-repeated")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, "doc_id", "left_anti").select(*_all(docs))
    again = left.join(repeated, "doc_id", "left_semi").select(*_all(docs)).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item; each row is judged by its own text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs.withColumn("lf_text", F.col("text")), items)
    return found.where("lf_n_hit = 0").select("lf_row.*").withColumnRenamed("lf_text", "text").select(*_all(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences: a place for every piece of every row."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pack", pack)]

#: Prediction by partial matching and best-fit search aren't expressible in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's table is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
