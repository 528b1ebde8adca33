"""WARC archives as a Spark data source with a splittable reader.

``df.write.format("warc")`` writes a gzip member per record.  ``spark.read.format("warc")`` cuts the
files into byte ranges: a task scans its range for gzip magic, takes as members those candidates
whose decoded start is a WARC header, and owns the records that start inside the range, reading past
its end to finish the last one.  Files are reached through Arrow's file systems, so any store that
Arrow knows will do, and executors share nothing but that store.

The reader takes any record type and id, header names in any case, folded header lines, texts that
aren't UTF-8 (undecodable bytes become U+FFFD), and records without digests.  Of a repeated field the first
counts.  A member that begins as a record but is cut off or damaged gives a row of type ``damaged``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ._store import shared_dir, written

#: Payloads shorter than this are never written as revisits.
MIN_REVISIT_BYTES = 1000
SPLIT_BYTES = 16 << 20
PAGE_URN = "urn:page:"
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 18
_BATCH_BYTES, _BATCH_ROWS = 8 << 20, 2000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary, digest_ok boolean"
_ARROW = pa.schema(
    [("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("digest_ok", pa.bool_())]
)
_HEAD = re.compile(rb"WARC/\d\.\d[ \t]*\r?\n")
_END = re.compile(rb"\r?\n\r?\n")
#: Characters of a URL that a header line can't hold or that a reader may strip; the writer percent-encodes them and
#: adds the URL as it was in a field of its own, in base 64.
_UNSAFE = re.compile("[\x00-\x20\x7f-\xa0<>\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_ORIGINAL = "X-Original-Target-URI"
DAMAGED = "damaged"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_bytes(row: dict) -> bytes:
    """One record as a gzip member; a revisit has the HTTP header of its response and no payload."""
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + (row["payload"] or b"")
    encoded = lambda text: _UNSAFE.sub(lambda c: quote(c[0]), text or "")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{encoded(row['record_id'])}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["url"] is not None:
        safe = encoded(row["url"])
        lines.append(f"WARC-Target-URI: {safe}")
        if safe != row["url"]:
            lines.append(f"{_ORIGINAL}: {base64.b64encode(row['url'].encode()).decode()}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{encoded(row['refers_to'])}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def header_fields(head: bytes) -> dict[str, str]:
    """Fields of header lines, names in lower case; a line that begins with white space goes on with the last one.

    Lines end at line feeds alone: other characters that some take for line ends are part of values.
    """
    out: dict[str, str] = {}
    name, first = "", False
    for line in re.split(rb"\r?\n", head)[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t"):
            if first:
                out[name] += " " + text.strip(" \t")
        elif ":" in text:
            name, value = text.split(":", 1)
            name = name.strip(" \t").lower()
            first = name not in out
            out.setdefault(name, value.strip(" \t"))
        else:
            first = False
    return out


def _original(code: str) -> str | None:
    try:
        return base64.b64decode(code, validate=True).decode()
    except ValueError:
        return None


def digest_hex(value: str | None) -> str | None:
    """The hexadecimal SHA-1 of a digest field in base 32 or base 16; None for other kinds and forms."""
    kind, _, code = (value or "").partition(":")
    if kind.strip().lower() not in ("sha1", "sha-1"):
        return None
    code = code.strip()
    if re.fullmatch(r"[0-9A-Fa-f]{40}", code):
        return code.lower()
    return base64.b32decode(code.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", code) else None


def parse_record(raw: bytes | None) -> dict:
    """The columns of one decoded record; None stands for a damaged one.

    The payload is the block, without its HTTP header where it is an HTTP message; a revisit has none,
    and its ``payload_bytes`` are those that its HTTP header says, if any.  Without a SHA-1 in the record
    ``payload_digest`` is computed from the payload (null for a revisit).  ``digest_ok`` tells whether the
    record's digest is that of its payload, null if there is nothing to compare.
    """
    if raw is None:
        return dict.fromkeys(_ARROW.names) | {"record_type": DAMAGED}
    end = _END.search(raw)
    head, rest = (raw[: end.start()], raw[end.end() :]) if end else (raw, b"")
    fields = header_fields(head)
    size = fields.get("content-length", "")
    block = rest[: int(size)] if size.isdigit() else rest
    kind = fields.get("warc-type", "").lower()
    http, payload = b"", block
    if "application/http" in fields.get("content-type", "").lower() and (cut := _END.search(block)):
        http, payload = block[: cut.start()], block[cut.end() :]
    revisit = kind == "revisit"
    said = digest_hex(fields.get("warc-payload-digest"))
    own = None if revisit else hashlib.sha1(payload).hexdigest()
    length = header_fields(http).get("content-length", "") if revisit else ""
    plain = lambda key: x.removeprefix("<").removesuffix(">") or None if (x := fields.get(key)) is not None else None
    url = fields.get("warc-target-uri")
    if url is not None:
        # older archives write URLs in angle brackets
        url = url[1:-1] if url[:1] == "<" and url[-1:] == ">" else url
        original = _original(fields[_ORIGINAL.lower()]) if _ORIGINAL.lower() in fields else None
        url = url if original is None else original
    return {
        "record_id": plain("warc-record-id"),
        "url": url,
        "record_type": kind,
        "refers_to": plain("warc-refers-to"),
        "payload_bytes": int(length) if length.isdigit() else None if revisit else len(payload),
        "payload_digest": said or own,
        "payload": None if revisit else payload,
        "digest_ok": said == own if said and own else None,
    }


def _member(f, at: int) -> tuple[bytes | None, int] | None:
    """The decoded member that starts at ``at`` and the offset after it; None if no record starts there.

    A member that begins as a record but can't be decoded to its end is None, followed by the next byte.
    """
    f.seek(at)
    decoder, out, taken, checked = zlib.decompressobj(31), bytearray(), 0, False
    try:
        while not decoder.eof:
            data = f.read(_READ)
            if not data:
                break
            out += decoder.decompress(data)
            taken += len(data)
            if not checked and (len(out) >= 4096 or decoder.eof):
                if not _HEAD.match(out):
                    return None
                checked = True
    except zlib.error:
        # what was decoded before the damage isn't handed out: decode a little again
        checked = checked or _begins(f, at)
    if decoder.eof:
        return bytes(out), at + taken - len(decoder.unused_data)
    return (None, at + 1) if checked or _HEAD.match(out) else None


def _begins(f, at: int) -> bool:
    """Whether what can be decoded from ``at`` on begins as a record."""
    f.seek(at)
    decoder, out = zlib.decompressobj(31), bytearray()
    try:
        for byte in f.read(4096):
            out += decoder.decompress(bytes([byte]))
    except zlib.error:
        pass
    return bool(_HEAD.match(out))


def records_from(f, start: int, end: int) -> Iterator[bytes | None]:
    """Decoded records whose members start in ``[start, end)`` of the open file ``f``; None for a damaged one."""
    at, exact = start, False
    while at < end:
        if exact and (found := _member(f, at)):
            yield found[0]
            at, exact = found[1], found[0] is not None
            continue
        exact = False
        f.seek(at)
        window = f.read(min(_READ, end - at) + len(_MAGIC) - 1)
        hit = window.find(_MAGIC)
        if hit < 0 or at + hit >= end:
            at += max(1, min(_READ, end - at))
            continue
        at += hit
        if found := _member(f, at):
            yield found[0]
            at, exact = found[1], found[0] is not None
        else:
            at += 1


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _store(self.path)
        files = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".warc.gz"))
        return [_Range(p, a, min(size, a + self.split)) for p, size in files for a in range(0, size, self.split)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = _store(self.path)
        rows, size = [], 0
        with store.open_input_file(partition.path) as f:
            for raw in records_from(f, partition.start, partition.end):
                rows.append(parse_record(raw))
                size += len(raw or b"")
                if size >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceArrowWriter):
    """Tasks write under names of their own; the commit renames the files of the attempts that count."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _store(self.path)
        store.create_dir(f"{root}/_attempts", recursive=True)
        name = f"{root}/_attempts/{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(name, compression=None) as f:
            for batch in iterator:
                for i in range(batch.num_rows):
                    f.write(record_bytes(batch.slice(i, 1).to_pylist()[0]))
        return _Written(name)

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        for k, m in enumerate(m for m in messages if m is not None):
            store.move(m.path, f"{root}/part-{k:06d}.warc.gz")
        store.delete_dir(f"{root}/_attempts")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(f"{root}/_attempts").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_attempts")


class WarcDataSource(DataSource):
    """``format("warc")``: options ``path`` and, for reading, ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def deduplicated(pages: DataFrame) -> DataFrame:
    """``pages`` as records: of equal payloads of ``MIN_REVISIT_BYTES`` or more, the largest ``page_id`` is the response.

    Records are named ``urn:page:`` and the ``page_id``.  Null html is an empty payload.  Repeated rows of
    the response are responses too.  A null ``page_id`` is a revisit if its payload has a response
    with an id, else a response.  Null urls are left out of the record.  Other columns aren't read.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    newest = rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("newest")).where("newest is not null")
    # as a table, so that the join's hot digests can be split over tasks
    newest = written(newest, "warc-newest")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return rows.join(newest, "payload_digest", "left").select(
        F.concat(F.lit(PAGE_URN), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        "url",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.concat(F.lit(PAGE_URN), F.col("newest").cast("string"))).alias("refers_to"),
        "payload_bytes",
        "payload_digest",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.lit(None).cast("boolean").alias("digest_ok"),
    )


def page_number(name: str) -> Column:
    """The ``page_id`` that a record's name stands for; null for names that aren't of a page."""
    return F.regexp_extract(name, f"^{PAGE_URN}(-?[0-9]+)$", 1).try_cast("long")


def write_archives(records: DataFrame, path: str) -> None:
    """Write records (columns of ``SCHEMA``) as ``.warc.gz`` files under ``path``, a new folder."""
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the ``.warc.gz`` files right under ``path``."""
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("splitBytes", split_bytes).load(path)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Archives all pages, then returns what the archives say of each."""
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(deduplicated(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    found = read_archives(spark, path)
    return found.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))


OP8_SQL = f"""
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), newest as (
  select payload_digest, max(page_id) as newest from p where payload_bytes >= {MIN_REVISIT_BYTES} group by payload_digest
)
select page_id, payload_bytes, payload_digest, case when newest <> page_id then 'revisit' else 'response' end as record_type,
  case when newest <> page_id then newest end as refers_to
from p left join newest using (payload_digest)
"""
