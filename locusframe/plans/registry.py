"""Queries over the driver's tables, one for each operator or more, with the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, and the SQL for the same rows."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed, weighted evidence overlapping target regions."""
    return QUERIES["evidence_by_region"](spark, sf_dir)


from . import alignment_queries, evidence_queries, gene_queries, interval_queries, model_queries, range_queries, sequence_queries, storage_queries  # noqa: E402, F401
