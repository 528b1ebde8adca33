"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to ``ORDER`` with counts from its training
texts, frozen after training.  A byte's code length is that of its longest known context, with
escapes (method C, with exclusion) down to an order below 0 where all bytes are alike.  A text's
language is the one whose tree codes the whole text in the fewest bits.

Spark counts the byte grams of the training texts; the driver and the workers only hold the sums.  A
tree is sorted arrays: for each order the known grams and contexts with their counts.  What a context
excludes is the bytes of its longer context, so the counts that are left after an escape are two more
numbers a context, and code lengths of many grams are found by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _text
from ._store import small_batches

ORDER = 3
#: Training bound: texts and code points a language, and code points of all languages together.  Every
#: language is learned.  Texts are whole, but for the last one of a language, which is cut where the
#: language's share ends.  A code point is at most four bytes, and a byte adds at most one gram, so a
#: model has under 16 million grams at 12 bytes.
TRAIN_DOCS, TRAIN_CHARS, TOTAL_CHARS = 300, 400_000, 4_000_000
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_FEED = 0x0A
_U = np.uint32


@dataclass
class Tree:
    """One language.  Per order: ``grams`` (context and byte) with ``counts``; ``contexts`` with the counts
    and kinds ``total, kinds`` of their bytes, and ``less``: what those bytes count in the next shorter context."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    total: list[np.ndarray]
    kinds: list[np.ndarray]
    less: list[np.ndarray]


def grams_of(part: _text.Words) -> np.ndarray:
    """For each byte of the rows, the number of the ``ORDER`` bytes before it and itself; A-Z count as a-z.

    A text starts after line feeds.
    """
    buf = _text.LOWER[part.buf].astype(_U)
    n = len(buf)
    since = np.arange(n) - np.repeat(part.row_start, part.row_end - part.row_start)
    out = np.zeros(n, _U)
    for back in range(ORDER, 0, -1):
        before = np.full(n, _FEED, _U)
        before[back:] = buf[:-back] if back < n else before[back:]
        before[since < back] = _FEED
        out = (out << _U(8)) | before
    return (out << _U(8)) | buf


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def tree(grams: np.ndarray, counts: np.ndarray) -> Tree:
    """The tree of the sorted grams of the longest order: shorter orders are their sums."""
    by_order = [(grams, counts.astype(np.int64))]
    for order in range(ORDER - 1, -1, -1):
        shorter, own = np.unique(by_order[0][0] & _U((1 << (8 * (order + 1))) - 1), return_inverse=True)
        by_order.insert(0, (shorter, np.bincount(own, by_order[0][1], len(shorter)).astype(np.int64)))
    out = Tree([], [], [], [], [], [])
    for order, (own, n) in enumerate(by_order):
        context, row = np.unique(own >> _U(8), return_inverse=True)
        size = len(context)
        less = np.zeros(len(own), np.int64)
        if order:
            less = out.counts[-1][_at(out.grams[-1], own & _U((1 << (8 * order)) - 1))[0]]
        for kept, value in zip((out.grams, out.counts, out.contexts, out.total, out.kinds, out.less), (own, n, context, np.bincount(row, n, size), np.bincount(row, minlength=size), np.bincount(row, less, size)), strict=True):
            kept.append(value if value.dtype == _U else value.astype(np.int32))
    return out


def code_lengths_of_grams(model: Tree, grams: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each gram after the bytes before it."""
    bits = np.zeros(len(grams))
    open_ = np.arange(len(grams))
    # what the next longer context excludes: counts, and kinds
    less, fewer = np.zeros(len(grams)), np.zeros(len(grams))
    for order in range(ORDER, -1, -1):
        own = grams[open_] & _U((1 << (8 * (order + 1))) - 1 if order < 3 else 0xFFFFFFFF)
        where, known = _at(model.contexts[order], own >> _U(8))
        if not len(model.contexts[order]):
            continue
        n = np.where(known, model.total[order][where] - less[open_], 0)
        kinds = np.where(known, model.kinds[order][where] - fewer[open_], 0)
        at, has = _at(model.grams[order], own)
        found = np.flatnonzero(has)
        bits[open_[found]] -= np.log2(model.counts[order][at[found]] / (n[found] + kinds[found]))
        escape = np.flatnonzero(~has & (n > 0))
        bits[open_[escape]] -= np.log2(kinds[escape] / (n[escape] + kinds[escape]))
        seen = open_[known]
        less[seen], fewer[seen] = model.less[order][where[known]], model.kinds[order][where[known]]
        open_ = open_[~has]
    left = 256 - (model.kinds[0][0] if len(model.kinds[0]) else 0)
    bits[open_] += np.log2(max(1, left))
    return bits


def code_lengths(model: dict[str, Tree], part: _text.Words) -> np.ndarray:
    """Bits of each whole row under each language."""
    out = np.zeros((part.hi - part.lo, len(model)))
    grams, place = np.unique(grams_of(part), return_inverse=True)
    has = np.flatnonzero(part.row_end > part.row_start)
    if len(has):
        for k, own in enumerate(model.values()):
            out[has, k] = np.add.reduceat(code_lengths_of_grams(own, grams)[place], part.row_start[has])
    return out


def _predict(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        names = list(model)
        for batch in batches:
            texts = batch.column(1)
            langs, scores, costs = [], [], []
            for part in _text.chunks(texts, _text.NOT_SPACE):
                bits = code_lengths(model, part)
                best = np.argmin(bits, axis=1)
                odds = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000))
                n_bytes = part.row_end - part.row_start
                known = np.array([_LETTER.search(texts[part.lo + r].as_py() or "") is not None for r in range(part.hi - part.lo)])
                langs += [names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                scores.append(np.where(known, 1 / odds.sum(axis=1), 0.0))
                costs.append(np.where(known, bits.min(axis=1) / np.maximum(n_bytes, 1), 0.0))
            # one result a batch: the id column, which may hold whole rows, is passed on as it is
            none = [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores or none)), pa.array(np.concatenate(costs or none))], ["lf_id", "lang_pred", "score", "bits_per_byte"])

    return run


def training_sample(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, total_chars: int = TOTAL_CHARS) -> DataFrame:
    """``lang, text``: training texts of every language.

    Only documents whose crc32 of ``doc_id`` (as text) is not 1 modulo 3, with a ``lang`` and a text that
    isn't empty.  A language's texts come in the order of a hash of ``doc_id``: at most ``train_docs``,
    and ``train_chars`` code points, or its equal share of ``total_chars`` if that is less (but one at
    least); the text in which that ends is cut there.  So each language has a text, however long all of
    its texts are.

    A hash bound that lets about four times as many pass, from the language's count, goes before the
    ranking, so that no task ranks more than that, however large the corpus is.
    """
    usable = docs.where("doc_id is not null and lang is not null and text <> '' and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n_langs = counts.count()
    most = max(1, min(train_chars, total_chars // max(1, n_langs)))
    chance = F.xxhash64("doc_id").bitwiseAND(F.lit(2**63 - 1))
    bound = F.least(F.lit(1.0), F.lit(4.0 * train_docs) / F.col("n"))
    rows = usable.select("lang", "doc_id", "text", chance.alias("lf_chance"))
    chosen = rows.join(F.broadcast(counts) if n_langs <= 10_000 else counts, "lang").where(F.col("lf_chance") / F.lit(2.0**63) <= bound)
    by = Window.partitionBy("lang").orderBy("lf_chance", "doc_id", "text")
    ranked = chosen.withColumns({"lf_rank": F.row_number().over(by), "lf_to": F.sum(F.length("text").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    room = (F.lit(most) - F.col("lf_to") + F.length("text")).cast("int")
    return ranked.where((F.col("lf_rank") <= train_docs) & (room > 0)).select("lang", F.substring("text", F.lit(1), room).alias("text"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of the rows of a batch with their counts, by language."""
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        code = np.asarray(names.indices, np.int64)
        for part in _text.chunks(batch.column(1), _text.NOT_SPACE):
            lang = np.repeat(code[part.lo : part.hi], part.row_end - part.row_start)
            key, n = np.unique((lang << 32) | grams_of(part).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(key >> 32)), pa.array(key & 0xFFFFFFFF), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def train(sample: DataFrame) -> dict[str, Tree]:
    """The tree of each language in ``sample`` (``lang, text``), in the order of their names.

    Only the sums of the grams come here, at most one for each byte of the sample.
    """
    grams = sample.select("lang", "text").mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = grams.toArrow()
    names = table.column("lang").combine_chunks().dictionary_encode()
    code, gram, n = np.asarray(names.indices), table.column("gram").to_numpy().astype(_U), table.column("n").to_numpy()
    out = {}
    for lang, k in sorted((x, k) for k, x in enumerate(names.dictionary.to_pylist())):
        own = np.flatnonzero(code == k)
        own = own[np.argsort(gram[own])]
        out[lang] = tree(gram[own], n[own])
    return out


def identify(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, bits_per_byte`` for every row, by trees trained on ``sample``.

    The model is broadcast, so ``sample`` (``lang, text``) must be bounded, as :func:`training_sample` is.
    ``lang_pred`` is ``und`` with score 0 where the text is null, has no letter, or nothing was
    learned; ties go to the language that sorts first.  ``score`` is the probability of the language
    given the text and equal priors.  Ids may be null or repeat, and only the two named columns are read.
    """
    model = train(sample)
    rows = small_batches(docs).select(F.col(id_col).alias("lf_id"), F.col(text_col).alias("lf_text"))
    if not model:
        return rows.select(F.col("lf_id").alias(id_col), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([rows.schema["lf_id"]]).add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return rows.mapInArrow(_predict(shared), schema).withColumnRenamed("lf_id", id_col)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, training_sample(docs))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
