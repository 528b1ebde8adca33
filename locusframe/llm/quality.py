"""Quality rules, line first: each line is judged, failing lines are removed, and documents that lose
too much of their text are rejected.

Everything is per row, so nothing is shuffled.  Within a task one numpy pass judges the lines of
a quarter of a megabyte of texts at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import small_batches

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Marks that end sentences in any script (a Unicode property), and some that divide them.
SENTENCE_MARKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if regex.match(r"\p{Sentence_Terminal}", c)) + ":;…"
#: Scripts that are written without such marks: Thai, Lao and Tibetan.
UNMARKED_SCRIPTS = (0x0E00, 0x0FFF)
#: Separators of navigation bars.
SEPARATORS = "|>»·•›→"
#: Phrases of boilerplate in four languages, in lower case.
BOILERPLATE = (
    # English
    "accept all cookies", "accept cookies", "all rights reserved", "cookie policy", "cookie settings", "enable javascript", "lorem ipsum", "powered by", "privacy policy", "read more", "share this", "sign up for", "skip to content", "subscribe to our", "terms of service", "terms of use",
    # German
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "impressum", "javascript aktivieren", "mehr lesen", "newsletter abonnieren", "nutzungsbedingungen", "zum inhalt springen",
    # French
    "abonnez-vous", "accepter les cookies", "activer javascript", "aller au contenu", "conditions d'utilisation", "lire la suite", "mentions légales", "politique de confidentialité", "tous droits réservés",
    # Spanish
    "aceptar cookies", "aceptar las cookies", "aviso legal", "habilitar javascript", "ir al contenido", "leer más", "política de privacidad", "suscríbete", "todos los derechos reservados", "términos de uso",
)


@dataclass(frozen=True)
class Rules:
    """Limits and phrases of the line rules.  Lines without words never fail; repeats of earlier lines always do."""

    #: Symbols beyond this share of a line's word characters.
    max_symbol_percent: int = 10
    #: So many exclamation and question marks, and over one for so many words.
    min_shouts: int = 3
    words_a_shout: int = 2
    #: So many words without a mark that ends or divides sentences, except in scripts that have none.
    min_unmarked_words: int = 20
    sentence_marks: str = SENTENCE_MARKS
    #: Navigation: so many separators, and one for each so many words.
    separators: str = SEPARATORS
    min_separators: int = 3
    words_a_separator: int = 5
    #: Upper case: so many letters A-Z, and this share of the letters A-Z and a-z.
    min_upper: int = 20
    upper_percent: int = 70
    #: One of these phrases (A-Z in lower case) in a line of so many words at most.
    boilerplate: tuple[str, ...] = BOILERPLATE
    max_boilerplate_words: int = 20
    #: A document is rejected if its failing lines hold more than this share of its word characters.
    max_lost_percent: int = 50


RULES = Rules()

_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LETTER = _UPPER | np.array([0x61 <= b <= 0x7A for b in range(256)])
_SYMBOL = np.array([b in SYMBOLS for b in range(256)])
_SCHEMA = "lf_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lost_chars bigint, failed_lines array<int>"


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _points(characters: str) -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, bool)
    out[[ord(c) for c in characters]] = True
    return out


def _marks(buf: np.ndarray, *tables: np.ndarray) -> list[np.ndarray]:
    """For each table of code points, whether one of its characters starts at a byte."""
    wide = np.flatnonzero(buf >= 0xC0)
    lead = buf[wide].astype(np.int32)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    point = lead & (0xFF >> (size + 1))
    for k in range(1, 4):
        more = size > k
        point[more] = (point[more] << 6) | (buf[np.minimum(wide[more] + k, len(buf) - 1)] & 0x3F)
    out = []
    for table in tables:
        own = table[:256][buf] & (buf < 0x80)
        own[wide] = table[np.minimum(point, sys.maxunicode)]
        out.append(own)
    return out


def _with_phrase(phrases: tuple[str, ...], text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Lines that hold one of the phrases; lines come in order."""
    out = np.zeros(len(start), bool)
    for phrase in phrases:
        raw = phrase.encode()
        at = text.find(raw)
        while at >= 0:
            line = int(np.searchsorted(start, at, "right")) - 1
            out[line] |= at + len(raw) <= end[line]
            at = text.find(raw, at + 1)
    return out


def _in_repeats(part: _text.Words, hashes: np.ndarray, row_of_word: np.ndarray) -> np.ndarray:
    """Words inside windows of five that occur twice or more in their row."""
    n = len(hashes)
    if n < WINDOW:
        return np.zeros(n, bool)
    size = n - WINDOW + 1
    key = np.zeros(size, np.uint64)
    for k in range(WINDOW):
        key = _text.mix(key + hashes[k : k + size])
    key = _text.mix(key ^ _text.mix(row_of_word[:size].astype(np.uint64) + np.uint64(1)))
    whole = row_of_word[:size] == row_of_word[WINDOW - 1 :]
    order = np.argsort(key[whole], kind="stable")
    at, sorted_key = np.flatnonzero(whole)[order], key[whole][order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = sorted_key[1:] == sorted_key[:-1]
    twice = at[same[1:] | same[:-1]]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + WINDOW, -1)
    return np.cumsum(step)[:n] > 0


def _judged(part: _text.Words, rules: Rules, tables: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    buf, rows = part.buf, part.hi - part.lo
    n_words = part.last - part.first
    row_of_word = np.repeat(np.arange(rows), n_words)
    inside = _sums(_text.NOT_SPACE[buf] & ((buf & 0xC0) != 0x80))
    symbols = _sums(_SYMBOL[buf])
    hashes = part.hashes(lower=False)
    repeated = np.bincount(row_of_word, _in_repeats(part, hashes, row_of_word), rows).astype(np.int64)

    # lines: each row's start and whatever follows a line feed
    feeds = np.flatnonzero(buf == 0x0A)
    start = np.concatenate([part.row_start, feeds + 1])
    row = np.concatenate([np.arange(rows), np.searchsorted(part.row_start, feeds, "right") - 1])
    # an empty row shares its start with the next one: take the row that holds the feed
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.empty_like(start)
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    end[:-1] = start[1:] - 1
    end[last] = part.row_end[row[last]]
    words = np.searchsorted(part.start, end) - np.searchsorted(part.start, start)
    chars, marks = inside[end] - inside[start], symbols[end] - symbols[start]
    upper, letters = _sums(_UPPER[buf]), _sums(_LETTER[buf])
    n_upper, n_letters = upper[end] - upper[start], letters[end] - letters[start]
    n_separators, n_shouts, n_ends, n_unmarked = (sums[end] - sums[start] for sums in map(_sums, _marks(buf, *tables)))

    up, down = _text._power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_text._BYTE[buf] * up[: len(buf)], out=sums[1:])
    line_hash = _text.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    line_hash = _text.mix(line_hash ^ _text.mix(row.astype(np.uint64) + np.uint64(1)))
    dup = np.zeros(len(row), bool)
    has = np.flatnonzero(words > 0)
    _, first = np.unique(line_hash[has], return_index=True)
    dup[has] = True
    dup[has[first]] = False

    bad = (100 * marks > rules.max_symbol_percent * chars) | ((n_shouts >= rules.min_shouts) & (rules.words_a_shout * n_shouts > words))
    bad |= (words >= rules.min_unmarked_words) & (n_ends == 0) & (n_unmarked == 0)
    bad |= (n_separators >= rules.min_separators) & (rules.words_a_separator * n_separators >= words)
    bad |= (n_upper >= rules.min_upper) & (100 * n_upper > rules.upper_percent * n_letters)
    bad |= dup
    bad |= (words <= rules.max_boilerplate_words) & _with_phrase(rules.boilerplate, _text.LOWER[buf].tobytes(), start, end)
    bad &= words > 0
    number = np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row]
    failed = [number[bad & (row == r)] for r in range(rows)] if bad.any() and rows < 64 else np.split(number[bad], np.searchsorted(row[bad], np.arange(1, rows)))
    whole = lambda weight: np.bincount(row, weight, rows).astype(np.int64)
    return n_words, whole(chars), symbols[part.row_end] - symbols[part.row_start], whole(dup), repeated, whole(chars * bad), failed


def _measure(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unmarked = np.zeros(sys.maxunicode + 1, bool)
        unmarked[UNMARKED_SCRIPTS[0] : UNMARKED_SCRIPTS[1] + 1] = True
        tables = [_points(rules.separators), _points("!?"), _points(rules.sentence_marks), unmarked]
        for batch in batches:
            for part in _text.chunks(batch.column(1), _text.NOT_SPACE):
                *numbers, failed = _judged(part, rules, tables)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.lo, part.hi - part.lo), *(pa.array(x, pa.int64()) for x in numbers), pa.array([x.tolist() for x in failed], pa.list_(pa.int32()))],
                    ["lf_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "failed_lines"],
                )

    return run


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = RULES) -> DataFrame:
    """Measures and verdict for every row: ``id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, lost_chars, failed_lines, base_failed, kept``.

    ``failed_lines`` are the numbers, from 0, of the lines that a rule removes; ``lost_chars`` their
    word characters.  Null or empty text has no words and so fails the base rule.  Ids may be null or
    repeated; each row has its own result.  Other columns are not read.
    """
    rows = small_batches(docs).select(F.col(id_col).alias("lf_id"), F.col(text_col).alias("lf_text"))
    measured = rows.mapInArrow(_measure(rules), _SCHEMA.format(kind=dict(rows.dtypes)["lf_id"]))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = 100 * F.col("lost_chars") > rules.max_lost_percent * F.col("word_chars")
    return measured.withColumnRenamed("lf_id", id_col).withColumns({"base_failed": base, "kept": ~base & ~lost})


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = RULES) -> DataFrame:
    """Rows that :func:`quality` keeps, without their failing lines; all columns stay.

    Rows are matched by id and text, so repeated ids with other texts keep their own verdicts.
    """
    key = F.xxhash64(text_col)
    verdict = quality(docs.withColumn("lf_key", F.struct(F.col(id_col).alias("i"), key.alias("k"))), "lf_key", text_col, rules)
    verdict = verdict.where("kept").select(F.col("lf_key.i").alias("lf_i"), F.col("lf_key.k").alias("lf_k"), F.col("failed_lines").alias("lf_gone")).dropDuplicates(["lf_i", "lf_k"])
    keyed = docs.withColumns({"lf_i": F.col(id_col), "lf_k": key})
    joined = keyed.join(verdict, keyed.lf_i.eqNullSafe(verdict.lf_i) & (keyed.lf_k == verdict.lf_k)).drop(keyed.lf_i, keyed.lf_k, verdict.lf_i, verdict.lf_k)
    left = F.transform(F.array(F.split(text_col, "\n", -1)), lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("lf_gone")), lambda i: F.get(p, i)), "\n"))[0]
    return joined.withColumn(text_col, left).select(*docs.columns)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")


OP3_SQL = rf"""
with lines as (
  select doc_id, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as w
  from (select doc_id, generate_subscripts(l, 1) as pos, unnest(l) as line
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))
), judged as (
  select *, len(w) as words, coalesce(length(array_to_string(w, '')), 0)::bigint as chars,
    len(regexp_extract_all(line, '[#*$%&|<>]')) as marks, len(regexp_extract_all(line, '[{SEPARATORS}]')) as separators, len(regexp_extract_all(line, '[!?]')) as shouts, len(regexp_extract_all(line, '[{SENTENCE_MARKS}]')) as ends, regexp_matches(line, '[{chr(UNMARKED_SCRIPTS[0])}-{chr(UNMARKED_SCRIPTS[1])}]') as unmarked,
    len(regexp_extract_all(line, '[A-Z]')) as uppers, len(regexp_extract_all(line, '[A-Za-z]')) as letters,
    row_number() over (partition by doc_id, line order by pos) > 1 and len(w) > 0 as dup,
    regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(BOILERPLATE).replace("'", "''")}') as phrase
  from lines
), failed as (
  select *, words > 0 and (100 * marks > {RULES.max_symbol_percent} * chars or (separators >= {RULES.min_separators} and {RULES.words_a_separator} * separators >= words)
    or (shouts >= {RULES.min_shouts} and {RULES.words_a_shout} * shouts > words) or (words >= {RULES.min_unmarked_words} and ends = 0 and not unmarked)
    or (uppers >= {RULES.min_upper} and 100 * uppers > {RULES.upper_percent} * letters) or dup or (phrase and words <= {RULES.max_boilerplate_words})) as bad from judged
), by_line as (
  select doc_id, coalesce(sum(chars), 0)::bigint as word_chars, sum(marks)::bigint as n_symbols, count(*) filter (where dup) as n_dup_lines,
    coalesce(sum(chars) filter (where bad), 0)::bigint as lost_chars
  from failed group by doc_id
), words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), grams as (
  select doc_id, i, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from words)
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n > 1
), repeats as (
  select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as p from twice) group by doc_id
), whole as (
  select doc_id, len(w) as n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, lost_chars
  from words join by_line using (doc_id) left join repeats using (doc_id)
)
select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and 100 * lost_chars <= {RULES.max_lost_percent} * word_chars as kept
from whole
"""
