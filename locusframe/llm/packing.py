"""Best-fit packing of documents into training sequences, with conflicts.

Pieces of documents are dealt by hash into shards of about ``SHARD_ROWS``, whatever the size of the
corpus, and each shard is packed by itself: longest first, into the fullest bin that still has room.
Bins are kept in the order of their residual space and carry bitmaps of the sources and duplicate
clusters they hold; the search starts at the tightest bin that fits and goes on to the next one until
it meets a bin without a conflict.  A duplicate cluster is a component of near copies.
"""

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import small_batches, written
from .jaccard_join import jaccard_join

CAPACITY = 2048
#: A cluster's documents are linked if they share this percentage of their shingles of so many words.
CLUSTER_WORDS, CLUSTER_PERCENT = 5, 80
#: Pieces in a shard, on average; a shard leaves about one bin of each source part empty.
SHARD_ROWS = 4000
_OUT = "doc_id bigint, piece int, first_token bigint, n_tokens bigint, shard bigint, bin int, offset bigint"


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each item; items come longest first and none is over ``capacity``.

    Bitmaps are integers with a bit for each source and cluster number.
    """
    residual: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    out = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = 1 << source, 1 << cluster
        k = bisect_left(residual, (length, -1))
        while k < len(residual) and (held[residual[k][1]][0] & s or held[residual[k][1]][1] & c):
            k += 1
        if k == len(residual):
            number, room = len(held), capacity
            held.append((0, 0))
        else:
            room, number = residual.pop(k)
        held[number] = (held[number][0] | s, held[number][1] | c)
        insort(residual, (room - length, number))
        out.append((number, capacity - room))
    return out


def _pack(capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("row_key", "ascending"), ("piece", "ascending")]
        table = table.sort_by(order)
        number = lambda name: np.unique(np.array([repr(x) for x in table.column(name).to_pylist()], dtype=object).astype(str), return_inverse=True)[1].tolist()
        placed = best_fit(table.column("length").to_pylist(), number("source"), number("cluster"), capacity)
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "piece": table.column("piece"),
                "first_token": table.column("first_token"),
                "n_tokens": table.column("length"),
                "shard": table.column("shard"),
                "bin": pa.array([b for b, _ in placed], pa.int32()),
                "offset": pa.array([o for _, o in placed], pa.int64()),
            }
        )

    return run


def _pieces(capacity: int) -> Column:
    return F.greatest(F.ceil(F.col("length").cast("long") / capacity), F.lit(1))


def pack(items: DataFrame, n_pieces: int, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Bins for ``items`` (``doc_id, length, source, cluster``), which are cut into ``n_pieces``.

    A row per piece: ``doc_id, piece, first_token, n_tokens, shard, bin, offset``; a bin is named by
    shard and number.  Items over ``capacity`` are cut into full pieces and a rest.  Two pieces of
    one source or of one cluster never share a bin; null sources are a source, as are null clusters
    a cluster.  Null lengths count as 0; items of length 0 get a place like any other.  Repeated rows
    are items of their own; a null ``doc_id`` is packed too.
    """
    shards = max(1, math.ceil(n_pieces / shard_rows))
    length = F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0))
    rows = items.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("whole"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "whole", "source", "cluster"))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("whole") / capacity).cast("int") - 1, F.lit(0))))
    rows = rows.withColumn("piece", piece).withColumn("first_token", F.col("piece").cast("long") * capacity)
    rows = rows.withColumn("length", F.least(F.col("whole") - F.col("first_token"), F.lit(capacity).cast("long")))
    # full pieces need no search; dealing by row and piece keeps a very long or much repeated document from filling a shard
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row_key", "piece", F.lit(17)), F.lit(shards)))
    return rows.drop("whole").groupBy("shard").applyInArrow(_pack(capacity), _OUT)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _text.chunks(batch.column(3), _text.NOT_SPACE):
            rows = [batch.column(k).slice(part.lo, part.hi - part.lo) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(part.last - part.first, pa.int64())], ["doc_id", "source", "lf_key", "length"])


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source, length, cluster`` of documents: words between white space, and the component of
    near copies (:func:`jaccard_join`) that the text is in.  A text without words is a cluster of its own."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    # every row takes part, null and repeated doc_ids too: a key is shared by equal rows only
    rows = rows.withColumn("lf_key", F.xxhash64("doc_id", "source", "text", F.col("doc_id").isNull(), F.col("source").isNull()))
    found = jaccard_join(rows.select(F.col("lf_key").alias("doc_id"), "text"), CLUSTER_WORDS, CLUSTER_PERCENT)
    clusters = found.groupBy(F.col("doc_id").alias("lf_key")).agg(F.min("component_id").alias("cluster"))
    lengths = rows.select("doc_id", "source", "lf_key", "text").mapInArrow(_measured, "doc_id bigint, source string, lf_key bigint, length bigint")
    return lengths.join(clusters, "lf_key").select("doc_id", "source", "length", "cluster")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """:func:`pack` over whole documents."""
    items = written(measured(docs), "packing-items")
    return pack(items, items.agg(F.sum(_pieces(capacity))).first()[0] or 0, capacity)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
