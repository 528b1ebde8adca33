"""Line dedup: lines that several documents share stay only in the first of them.

Lines are exploded and normalised, hashed to 128 bits, the distinct documents of each hash counted,
and lines over the threshold dropped; texts are put together again by position.  Two shuffles carry
hashes only, the third brings each text together with the positions it loses.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches, written

#: Fixed values of the contract: white space stripped from both ends of a line.
STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"
_LINES = "doc_id bigint, row_key bigint, h1 bigint, h2 bigint, pos int"


def _keyed_lines(min_chars: int, distinct: bool):
    import numpy as np
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            rows, at, digests = [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.large_binary())):
                raw = text.as_py()
                if raw:
                    seen = set()
                    for pos, line in enumerate(raw.split(b"\n")):
                        key = line.strip(STRIP).lower()
                        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
                            continue
                        digest = xxhash.xxh3_128_digest(key)
                        if distinct:
                            if digest in seen:
                                continue
                            seen.add(digest)
                        rows.append(i)
                        at.append(pos)
                        digests.append(digest)
                if len(rows) >= 200_000 or i + 1 == len(batch):
                    pairs = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                    own = np.array(rows, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[own] if len(own) else [], pa.int64()), pa.array(keys[own] if len(own) else [], pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(at, pa.int32())],
                        ["doc_id", "row_key", "h1", "h2", "pos"],
                    )
                    rows, at, digests = [], [], []

    return run


def shared_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Line hashes held by at least ``min_docs`` documents, with the smallest ``doc_id`` of each."""
    keyed = _rows(docs).mapInArrow(_keyed_lines(min_chars, True), _LINES)
    found = keyed.groupBy("h1", "h2")
    if min_docs == 2:
        return found.agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("far")).where("home < far").drop("far")
    return found.agg(F.min("doc_id").alias("home"), F.countDistinct("doc_id").alias("n_docs")).where(F.col("n_docs") >= min_docs).drop("n_docs")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_key"), "text")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Every row of ``docs`` with the columns ``lf_kept`` (text left), ``lf_n_lines``, ``lf_n_dropped``.

    A line's key is the line stripped of ASCII white space, A-Z in lower case.  Keys of at least
    ``min_chars`` code points found in ``min_docs`` documents lose all their lines except those in
    the smallest ``doc_id`` that holds them (repeats inside that document stay).

    Null or empty text: one empty line, kept.  Null ``doc_id``: the row is returned whole and counts
    for no key.  Repeated rows of a ``doc_id`` are one document and each is cleaned.  Other columns,
    whatever their names, pass through; only the three ``lf_`` columns are replaced.
    """
    # as a table, so that the join's hot lines can be split over tasks
    shared = written(shared_lines(small_batches(docs), min_chars, min_docs), "shared-lines")
    lines = _rows(docs).mapInArrow(_keyed_lines(min_chars, False), _LINES)
    # names that no column of docs has
    doc, key, gone = (f"lf_{x}_{uuid.uuid4().hex}" for x in ("doc", "key", "gone"))
    drops = lines.join(shared, ["h1", "h2"]).where("doc_id <> home").groupBy(F.col("doc_id").alias(doc), F.col("row_key").alias(key)).agg(F.collect_set("pos").alias(gone))
    out = docs.drop("lf_kept", "lf_n_lines", "lf_n_dropped")
    left = out.withColumns({doc: F.col("doc_id").cast("long"), key: F.xxhash64("text")})
    text = F.coalesce("text", F.lit(""))
    parts = F.split(text, "\n", -1)
    # the lines are bound to a variable of their own, else they would be split again for each line kept
    kept = F.transform(F.array(parts), lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(gone)), lambda i: F.get(p, i)), "\n"))[0]
    new = {
        "lf_kept": F.when(F.col(gone).isNull(), text).otherwise(kept),
        "lf_n_lines": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.lit(1).cast("long"),
        "lf_n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
    }
    return left.join(drops, [doc, key], "left").select(*[F.col(f"`{c}`") for c in out.columns], *[c.alias(name) for name, c in new.items()])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("lf_n_lines").alias("n_lines"), F.col("lf_n_dropped").alias("n_dropped"), F.sha2("lf_kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
with lines as (
  select doc_id, generate_subscripts(l, 1) as pos, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), shared as (
  select k, min(doc_id) as home from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2
), marked as (
  select keyed.*, shared.home is not null and shared.home <> doc_id as gone
  from keyed left join shared using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
