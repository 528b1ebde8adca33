"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Items are cut into windows of consecutive normalised words.  Spark forms the distinct windows with the
items they are of; a window is a sequence of word numbers, and the automaton runs over numbers.  A
number is written in two digits, so that no state has more ways on than the root of the vocabulary's
size.  Each text's words are numbered, scanned once, and matches are mapped back to the original text.

Words are 64-bit hashes.  An automaton takes at most some 870 bytes a window in a worker (measured on
windows with few common beginnings: 19 nodes of 32 bytes and their edges), so one of
``BLOCK_WINDOWS`` takes up to 220 MB.  A benchmark of more windows than that is scanned for one block
of windows after the other, each scan in a job of its own, so that neither a worker nor the driver
holds more than a block.  A scan's table is deleted once the next one is written; the last of them is
what the result reads.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from . import _text
from ._store import dropped, small_batches, written

#: Windows in one automaton, about: windows are dealt to blocks by hash.
BLOCK_WINDOWS = 250_000


@dataclass
class Block:
    """Sorted hashes of the words of some windows; each window's words as numbers, and its items."""

    words: np.ndarray
    numbers: np.ndarray
    offsets: np.ndarray
    items: list[str]
    own_items: np.ndarray
    item_offsets: np.ndarray

    def digits(self, numbers: np.ndarray) -> list[int]:
        """Two digits for each number, of ranges of their own; zeros for -1."""
        base = math.isqrt(len(self.words)) + 1
        out = np.zeros((len(numbers), 2), np.int32)
        known = numbers >= 0
        out[known, 0], out[known, 1] = 1 + numbers[known] // base, 1 + base + numbers[known] % base
        return out.ravel().tolist()


def _windows(size: int):
    """All runs of ``size`` consecutive words of each item; a shorter text that has words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch.column(1), _text.ALNUM_CASED):
                h = part.hashes(lower=True).view(np.int64)
                n = part.last - part.first
                count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
                row = np.repeat(np.arange(len(n)), count)
                start = part.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                length = np.minimum(n[row], size)
                offsets = np.concatenate([[0], np.cumsum(length)])
                flat = h[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
                words = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([words, batch.column(0).take(pa.array(row + part.lo))], ["words", "item"])

    return run


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``words, items``: each distinct window as hashes of words, with the sorted ids of its items."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    found = items.mapInArrow(_windows(window), "words array<bigint>, item string")
    return found.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _block(table: pa.Table) -> Block:
    words, items = (table.column(c).combine_chunks() for c in ("words", "items"))
    known, numbers = np.unique(np.asarray(words.flatten()), return_inverse=True)
    names = items.flatten().dictionary_encode()
    return Block(known, numbers.astype(np.int32), np.asarray(words.offsets), names.dictionary.to_pylist(), np.asarray(names.indices), np.asarray(items.offsets))


@lru_cache(maxsize=1)
def _automaton(key: str):
    import ahocorasick

    block = _automaton.source.value
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    digits, at = block.digits(block.numbers), (2 * block.offsets).tolist()
    for n, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        found.add_word(tuple(digits[a:b]), n)
    found.make_automaton()
    return found


def _scan(broadcast, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _automaton.source = broadcast
        automaton, block = _automaton(key), broadcast.value
        for batch in batches:
            for part in _text.chunks(batch.column("lf_text"), _text.ALNUM_CASED):
                rows = part.hi - part.lo
                own = batch.slice(part.lo, rows)
                starts, ends, items = (own.column(c).to_pylist() for c in ("lf_from", "lf_to", "lf_items"))
                h = part.hashes(lower=True).view(np.int64)
                at = np.minimum(np.searchsorted(block.words, h), len(block.words) - 1)
                number = np.where(block.words[at] == h, at, -1)
                # what is no word of a window stands between rows
                stream, first = tuple(block.digits(np.insert(number, part.first[1:], -1))), part.first + np.arange(rows)
                for stop, n in automaton.iter(stream) if stream else ():
                    r = int(np.searchsorted(first, stop // 2, "right")) - 1
                    last = stop // 2 - int(first[r]) + 1
                    starts[r].append(last - int(block.offsets[n + 1] - block.offsets[n]))
                    ends[r].append(last)
                    items[r] += [block.items[i] for i in block.own_items[block.item_offsets[n] : block.item_offsets[n + 1]]]
                items = [sorted(set(x)) for x in items]
                yield pa.RecordBatch.from_arrays(
                    [own.column("lf_row"), own.column("lf_text"), pa.array(part.last - part.first, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    ["lf_row", "lf_text", "lf_n_words", "lf_from", "lf_to", "lf_items"],
                )

    return run


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Code point spans in the original text of the runs of hit words."""
    words = next(_text.chunks(pa.array([text]), _text.ALNUM_CASED))
    points = _text.code_point_prefix(words.buf)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(points[words.start[a]]), "end": int(points[words.end[b - 1]])} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = batch.column("lf_n_words").to_pylist()
        rows = zip(counts, batch.column("lf_from").to_pylist(), batch.column("lf_to").to_pylist(), strict=True)
        n_hit, spans = [], []
        for i, (n, starts, ends) in enumerate(rows):
            if not starts:
                n_hit.append(0)
                spans.append([])
                continue
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, starts, 1)
            np.add.at(step, ends, -1)
            hit = np.cumsum(step)[:n] > 0
            n_hit.append(int(hit.sum()))
            spans.append(_spans(batch.column("lf_text")[i].as_py().encode(), hit))
        items = batch.column("lf_items")
        ids = items.to_pylist()
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lf_row"), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), items, pa.array([len(x) for x in ids], pa.int64()), pa.array(digest), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["lf_row", "lf_n_words", "lf_n_hit", "lf_items", "lf_n_items", "lf_items_sha256", "lf_spans"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Every row of ``docs`` as the struct ``lf_row``, with its hits.

    ``lf_n_words``; ``lf_n_hit``: words inside any occurrence of a benchmark window; ``lf_items``:
    ids of the items with occurring windows, as sorted strings; ``lf_n_items``; ``lf_items_sha256``;
    ``lf_spans``: the runs of hit words as code point spans of the original text.

    Null or empty text has no words.  Items without words, and null texts in the benchmark, have no
    windows; an empty benchmark hits nothing; equal items are all reported.  Null item ids are
    skipped.  Repeated rows and null ids give a result each; other columns, whatever their names, ride
    along inside ``lf_row``.
    """
    table = written(benchmark_windows(benchmark, window), "benchmark-windows")
    blocks = max(1, -(-table.count() // BLOCK_WINDOWS))
    none = F.array().cast("array<bigint>")
    out = small_batches(docs).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("lf_row"),
        F.col("text").alias("lf_text"),
        F.lit(0).cast("long").alias("lf_n_words"),
        none.alias("lf_from"),
        none.alias("lf_to"),
        F.array().cast("array<string>").alias("lf_items"),
    )
    schema, before = out.schema, None
    for b in range(blocks):
        block = _block(table.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).toArrow())
        if not len(block.words):
            # nothing to find: a window of two words that no text has
            block = Block(np.zeros(1, np.int64), np.zeros(2, np.int32), np.array([0, 2]), [], np.zeros(0, np.int32), np.zeros(2, np.int64))
        scanned = out.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex), schema)
        if b + 1 == blocks:
            out = scanned
            break
        out = written(scanned, "benchmark-scanned")
        if before is not None:
            dropped(before)
        before = out
    dropped(table)
    found = StructType([schema["lf_row"]])
    for name, kind in (("lf_n_words", "bigint"), ("lf_n_hit", "bigint"), ("lf_items", "array<string>"), ("lf_n_items", "bigint"), ("lf_items_sha256", "string"), ("lf_spans", "array<struct<start:bigint,end:bigint>>")):
        found = found.add(name, DataType.fromDDL(kind))
    return out.mapInArrow(_finish, found)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "lf_row.doc_id",
        F.col("lf_n_words").alias("n_words"),
        F.col("lf_n_hit").alias("n_hit"),
        F.col("lf_n_items").alias("n_items"),
        F.col("lf_items_sha256").alias("items_sha256"),
        (F.col("lf_n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), item_windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + 9], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item_words where len(w) > 0)
), sizes as (select distinct n from item_windows),
doc_windows as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, sizes)
), hits as (
  select doc_id, d.n, i, item_id from doc_windows d join item_windows b on d.n = b.n and d.g = b.g
), hit_words as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id
), hit_items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit_words using (doc_id) left join hit_items using (doc_id)
"""
