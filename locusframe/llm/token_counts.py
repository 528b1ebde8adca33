"""Token counts: map-side two-tier lookup of pre-token lengths.

Tier one is a compact hash table, broadcast once: the vocabulary's own entries that are whole
pre-tokens, which are by construction the frequent ones, with the lengths the tokenizer gives them.
Its size is bounded by the vocabulary.  Pre-tokens it lacks are encoded by the tokenizer and kept in
a bounded cache per worker.  Nothing is shuffled.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches

#: Fixed value: the public pre-token pattern of byte-level BPE vocabularies of this family.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _unsettled() -> str:
    """A pattern of the characters that Unicode versions may class differently.

    These are the BMP's code points that this Python has as unassigned, and everything above the BMP.
    """
    spans: list[list[int]] = []
    for c in range(0x80, 0x10000):
        if unicodedata.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans) + f"\U00010000-{chr(sys.maxunicode)}]"


CACHE_ENTRIES = 1 << 18
#: Longer pre-tokens are encoded each time, so that the cache's bytes are bounded too.
CACHE_CHARS = 64


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable bytes as they are, the rest from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def frequent_lengths(tokenizer_path: str) -> tuple[dict[str, int], list[str]]:
    """Lengths of the vocabulary entries that are whole pre-tokens, and the special strings.

    Bounded by the vocabulary (about 50,000 entries, under 2 MB).
    """
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    letters, pattern = _byte_letters(), regex.compile(PRE_TOKEN)
    words = []
    for entry in spec["model"]["vocab"]:
        if entry in special or not all(c in letters for c in entry):
            continue
        try:
            word = bytes(letters[c] for c in entry).decode()
        except UnicodeDecodeError:
            continue
        if pattern.fullmatch(word):
            words.append(word)
    counts = [len(e.ids) for e in tokenizer.encode_batch(words, add_special_tokens=False)]
    return dict(zip(words, counts, strict=True)), special


def settled(text: str, unsettled: re.Pattern) -> Iterator[tuple[str, bool]]:
    """``text`` in pieces, those with an unsettled character marked.

    A marked piece is the run without plain white space around the character, with all white space
    before it.  A pre-token has white space at its begin only, so none crosses the ends of a piece.
    """
    at = 0
    while m := unsettled.search(text, at):
        begin, end = m.start(), m.end()
        while begin > at and text[begin - 1] not in " \n\r\t":
            begin -= 1
        while begin > at and text[begin - 1].isspace():
            begin -= 1
        while end < len(text) and text[end] not in " \n\r\t":
            end += 1
        yield text[at:begin], False
        yield text[begin:end], True
        at = end
    yield text[at:], False


@lru_cache(maxsize=4)
def _worker(tokenizer_path: str):
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    return tokenizer, regex.compile(PRE_TOKEN), re.compile(_unsettled()), {}


class _Lengths(dict):
    """Tier two: encodes what it lacks, and starts anew once it holds ``CACHE_ENTRIES``."""

    def __init__(self, frequent: dict[str, int], encode):
        super().__init__(frequent)
        self.frequent, self.encode = frequent, encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word, add_special_tokens=False).ids)
        if len(word) <= CACHE_CHARS:
            if len(self) >= len(self.frequent) + CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


def _count(tokenizer_path: str, table, special: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        tokenizer, pattern, unsettled, kept = _worker(tokenizer_path)
        if "lengths" not in kept:
            kept["lengths"] = _Lengths(table.value, tokenizer.encode)
        lengths = kept["lengths"]
        get, words = lengths.__getitem__, pattern.findall
        cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        for batch in batches:
            out = []
            for value in batch.column(batch.num_columns - 1):
                text, n = value.as_py() or "", 0
                if cut is not None and cut.search(text):
                    parts = cut.split(text)
                    n = len(parts) - 1
                else:
                    parts = (text,)
                for part in parts:
                    if part.isascii():
                        n += sum(map(get, words(part)))
                        continue
                    for piece, odd in settled(part, unsettled):
                        n += len(tokenizer.encode(piece, add_special_tokens=False).ids) if odd else sum(map(get, words(piece)))
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``n_tokens`` equals the tokenizer's count without begin and end tokens; the special strings of
    the vocabulary count as one token each, as the library does by default.  Words with characters that
    Unicode versions may class differently are encoded by the library, the rest of their text by
    look-up.  Null or empty text: 0 bytes, 0 tokens.  An empty table gives an empty result.  Null or repeated ids and repeated rows: one result per row.  Other columns are
    not read.  ``tokenizer_path`` must exist on every executor.
    """
    frequent, special = frequent_lengths(tokenizer_path)
    table = docs.sparkSession.sparkContext.broadcast(frequent)
    rows = small_batches(docs).select(F.col(id_col).alias("lf_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("lf_text"))
    schema = f"lf_id {dict(docs.dtypes)[id_col]}, n_bytes bigint, n_tokens bigint"
    counted = rows.mapInArrow(_count(tokenizer_path, table, special), schema)
    return counted.select(F.col("lf_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts by the public 50k byte-level vocabulary for every document."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
