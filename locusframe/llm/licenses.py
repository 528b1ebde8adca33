"""License scans: a positional index of rare words of licence passages.

Corpus-wide document frequencies of the passages' words (a table as small as their vocabulary) give
the IDF.  Every word of a passage has postings: the passages and positions where it stands.  A file
looks up the licence words it has, those of highest IDF first.  Postings are intersected by relative
position: a place is where at least two of the file's looked-up words agree on the begin of a passage.
It counts if the passage's mandatory key phrase stands there and enough of its IDF mass does.

The three phrases of the contract are passages as well, with themselves as key phrase.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import small_batches
from .license_texts import PASSAGES

#: Fixed values of the contract.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: A file's words of highest IDF that are looked up in any case.
LOOKUPS = 8
MIN_COVERAGE = 0.6
#: Words of a file whose postings are intersected at a time.
STRETCH = 1 << 16


def _word_hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    return next(_text.chunks(pa.array([" ".join(words)]), _text.ALNUM_CASED, 1 << 30)).hashes(lower=True)


def _split(text: str) -> list[str]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return bytes(np.where(_text.ALNUM_CASED[raw], _text.LOWER[raw], 0x20).astype(np.uint8)).decode().split()


VOCABULARY = tuple(sorted({w for _, _, text in PASSAGES for w in _split(text)} | {w for phrase, _ in BASE for w in phrase.split()}))


@dataclass
class Index:
    """The passages and the postings of their words.

    ``hashes``, ``idf``: of the words, by number, in the order of their hashes; ``words[t]``: numbers of the words of passage ``t``;
    ``key[t]``: where its key phrase stands; ``post_at``: each word's slice of ``post_passage, post_place``.
    """

    labels: list[str]
    base: np.ndarray
    words: list[np.ndarray]
    key: list[tuple[int, int]]
    hashes: np.ndarray
    idf: np.ndarray
    post_at: np.ndarray
    post_passage: np.ndarray
    post_place: np.ndarray


def index(frequency: dict[str, int], n_docs: int) -> Index:
    """The positional index, with the IDF of the words in the corpus."""
    own = np.array(VOCABULARY)
    order = np.argsort(_word_hashes(list(VOCABULARY)))
    number = {w: k for k, w in enumerate(own[order].tolist())}
    idf = np.array([math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1e-6 for w in number])
    known = [(label, phrase, phrase, True) for phrase, label in BASE] + [(label, phrase, text, False) for label, phrase, text in PASSAGES]
    words, keys = [], []
    for _, phrase, text, _ in known:
        body, key = _split(text), phrase.split()
        at = next(i for i in range(len(body)) if body[i : i + len(key)] == key)
        words.append(np.array([number[w] for w in body], np.int32))
        keys.append((at, at + len(key)))
    passage = np.repeat(np.arange(len(words)), [len(w) for w in words])
    place = np.concatenate([np.arange(len(w)) for w in words])
    flat = np.concatenate(words)
    by = np.argsort(flat, kind="stable")
    post_at = np.searchsorted(flat[by], np.arange(len(number) + 1))
    return Index([k[0] for k in known], np.array([k[3] for k in known]), words, keys, _word_hashes(list(number)), idf, post_at, passage[by], place[by])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = _word_hashes(list(VOCABULARY))
    order = np.argsort(own)
    ordered = own[order]
    counts, n = np.zeros(len(own), np.int64), 0
    for batch in batches:
        n += batch.num_rows
        for part in _text.chunks(batch.column(0), _text.ALNUM_CASED):
            h = part.hashes(lower=True)
            at = np.minimum(np.searchsorted(ordered, h), len(own) - 1)
            has = np.zeros((part.hi - part.lo, len(own)), bool)
            row = np.repeat(np.arange(part.hi - part.lo), part.last - part.first)
            hit = ordered[at] == h
            has[row[hit], at[hit]] = True
            counts += has.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([*order.tolist(), -1], pa.int32()), pa.array([*counts.tolist(), n], pa.int64())], ["word", "n"])


def license_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """Document frequency over all rows of each passage word, and the number of rows."""
    found = docs.select(F.col(text_col)).mapInArrow(_frequencies, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by = {r["word"]: r["n"] for r in found}
    return {w: by.get(i, 0) for i, w in enumerate(VOCABULARY)}, by.get(-1, 0)


def looked_up(present: np.ndarray, suspects: list[int], ix: Index) -> np.ndarray:
    """The numbers of the words that a file with the words ``present`` looks up.

    They are the ``LOOKUPS`` of highest IDF, and as many more by IDF as it takes to have two words of
    the key phrase of every suspect: a passage whose key phrase's words the file has.  So no place goes
    unseen, whatever other licences the file has.
    """
    ranked = np.sort(ix.idf[present])[::-1]
    cut = ranked[min(LOOKUPS, len(ranked)) - 1] if len(ranked) else 0.0
    for t in suspects:
        a, b = ix.key[t]
        key = np.sort(ix.idf[np.unique(ix.words[t][a:b])])[::-1]
        cut = min(cut, key[min(1, len(key) - 1)])
    return present[ix.idf[present] >= cut]


def places(words: np.ndarray, suspects: list[int], ix: Index) -> list[tuple[int, int, float]]:
    """``passage, first word, coverage`` of each verified place in one file.

    ``words`` are the numbers of the file's words, -1 for those that no passage has.
    """
    known = np.flatnonzero(words >= 0)
    rare = np.zeros(len(ix.idf), bool)
    rare[looked_up(np.unique(words[known]), suspects, ix)] = True
    at = known[rare[words[known]]]
    longest = max(len(ix.words[t]) for t in suspects)
    wanted = np.zeros(len(ix.words), bool)
    wanted[suspects] = True
    out = []
    for lo in range(-longest, len(words), STRETCH):
        # all that votes for a begin in lo .. lo + STRETCH - 1
        own = at[np.searchsorted(at, lo) : np.searchsorted(at, lo + STRETCH + longest)]
        begin, end = ix.post_at[words[own]], ix.post_at[words[own] + 1]
        n = end - begin
        post = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        passage, start = ix.post_passage[post], np.repeat(own, n) - ix.post_place[post]
        keep = wanted[passage] & (start >= lo) & (start < lo + STRETCH)
        vote, votes = np.unique((passage[keep].astype(np.int64) << 40) + start[keep] + longest, return_counts=True)
        for v in vote[votes >= 2].tolist():
            t, d = v >> 40, (v & ((1 << 40) - 1)) - longest
            body, (a, b) = ix.words[t], ix.key[t]
            if d + a < 0 or d + b > len(words) or not np.array_equal(words[d + a : d + b], body[a:b]):
                continue
            first, last = max(0, -d), min(len(body), len(words) - d)
            same = words[d + first : d + last] == body[first:last]
            share = float(ix.idf[body[first:last]][same].sum() / ix.idf[body].sum())
            if share >= MIN_COVERAGE:
                out.append((t, max(d, 0), min(1.0, share)))
    return sorted(out)


def _scan(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = broadcast.value
        needs = [np.unique(w[a:b]) for w, (a, b) in zip(ix.words, ix.key, strict=True)]
        place = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("coverage", pa.float64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), place]
        for batch in batches:
            for part in _text.chunks(batch.column(1), _text.ALNUM_CASED):
                h = part.hashes(lower=True)
                rows, n_words = part.hi - part.lo, part.last - part.first
                at = np.minimum(np.searchsorted(ix.hashes, h), len(ix.hashes) - 1)
                words = np.where(ix.hashes[at] == h, at, -1)
                has = np.zeros((rows, len(ix.hashes)), bool)
                row = np.repeat(np.arange(rows), n_words)
                has[row[words >= 0], words[words >= 0]] = True
                suspects: dict[int, list[int]] = {}
                for t, need in enumerate(needs):
                    for r in np.flatnonzero(has[:, need].all(axis=1)).tolist():
                        suspects.setdefault(r, []).append(t)
                out: list[list] = [[] for _ in kinds]
                for r in range(rows):
                    found = places(words[part.first[r] : part.last[r]], suspects[r], ix) if r in suspects else []
                    own = [(d, ix.labels[t]) for t, d, _ in found if ix.base[t]]
                    more = [(ix.labels[t], d, len(ix.words[t]), share) for t, d, share in found if not ix.base[t]]
                    first, labels = [d for d, _ in own], {x for _, x in own}
                    value = (len(first), min(first, default=None), max(first, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {m[0] for m in more})), max((m[3] for m in more), default=0.0))
                    for col, x in zip(out, (*value, [dict(zip(("label", "first_word", "n_words", "coverage"), m, strict=True)) for m in more]), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.lo, rows), pa.array(n_words, pa.int64()), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))],
                    ["lf_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"],
                )

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, places`` per row.

    ``places`` lists each verified place of a licence passage with its first word, length and coverage;
    ``score`` is the largest coverage, 0 where there is none.  Null or empty text: no words, empty
    labels, null places of words.  Ids may be null or repeat; each row has its own result.  Words of
    equal IDF are looked up together.  On an empty table the result is empty.  Other columns are not read.
    """
    ix = index(*license_frequencies(small_batches(docs), text_col))
    rows = docs.select(F.col(id_col).alias("lf_id"), F.col(text_col).alias("lf_text"))
    schema = f"lf_id {dict(rows.dtypes)['lf_id']}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, places array<struct<label:string,first_word:bigint,n_words:bigint,coverage:double>>"
    return rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(ix)), schema).withColumnRenamed("lf_id", id_col)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("places")
