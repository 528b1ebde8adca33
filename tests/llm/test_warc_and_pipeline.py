import gzip
import hashlib
import io
import random
import zlib

import corpus_pipeline
from locusframe.llm import warc
from locusframe.llm.queries import QUERIES, SQL

from .helpers import TO_LOWER, jaccard_components, words_of
from .test_text_operators import brute_contamination


def pages_frame(spark):
    rng = random.Random(6)
    long = "<p>" + words_of(rng, 400) + "é</p>"
    rows = [(1, "http://a", long), (2, "http://b\r\nx", long), (9, None, long), (9, None, long), (3, "http://c", "tiny"), (4, "http://d", "tiny"), (5, "http://e", None), (6, "http://f", ""), (None, "http://g", long)]
    rows += [(20 + i, f"http://h/{i}", words_of(rng, rng.randrange(1, 3000))) for i in range(60)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, payload int"), rows


def test_round_trip_in_splits_of_any_size(spark, tmp_path):
    pages, rows = pages_frame(spark)
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.deduplicated(pages.repartition(3)), path)
    number = lambda x: int(x.removeprefix("urn:page:") or -1)
    want = sorted((i if i is not None else -1, hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h in rows)
    for split in (500, 7_001, 1 << 24):
        got = warc.read_archives(spark, path, split).collect()
        assert sorted((number(r.record_id), r.payload_digest, r.payload_bytes) for r in got) == want
        assert {r.digest_ok for r in got if r.record_type == "response"} == {True}
    kinds = {(number(r.record_id), r.record_type, r.refers_to and number(r.refers_to)) for r in got if number(r.record_id) < 10}
    assert kinds == {(1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (-1, "revisit", 9), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None)}
    texts = {number(r.record_id): r.payload.decode() for r in got if r.record_type == "response"}
    assert all(texts[i] == (h or "") for i, _, h in rows if i is not None and i not in (1, 2))
    assert {r.url for r in got if number(r.record_id) == 2} == {"http://b\r\nx"}


def test_payloads_beyond_one_read_and_one_batch(spark, tmp_path):
    pages = [(i, random.Random(i).randbytes(400_000 + 1_500_000 * i).hex()) for i in range(4)] + [(10, "z" * 3_000_000)]
    path = f"file://{tmp_path}/large"
    warc.write_archives(warc.deduplicated(spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id bigint, url string, html string").coalesce(1)), path)
    for split in (1_000_000, 1 << 24):
        got = warc.read_archives(spark, path, split).collect()
        assert {(int(r.record_id[9:]), hashlib.sha1(r.payload).hexdigest(), r.payload_bytes, r.digest_ok) for r in got} == {(i, hashlib.sha1(h.encode()).hexdigest(), len(h), True) for i, h in pages}


def test_reader_rejects_magic_that_starts_no_record():
    row = {"record_id": "urn:page:1", "url": "u", "record_type": "response", "refers_to": None, "payload_bytes": 3, "payload": b"abc", "payload_digest": hashlib.sha1(b"abc").hexdigest()}
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = packer.compress(b"not a record " * 50) + packer.flush()
    raw = b"\x1f\x8b\x08junk" + warc.record_bytes(row) + other + warc.record_bytes(row | {"record_id": "urn:page:2"}) + b"\x1f\x8b\x08"
    read = lambda a, b: [int(warc.parse_record(x)["record_id"][-1]) for x in warc.records_from(io.BytesIO(raw), a, b)]
    assert read(0, len(raw)) == [1, 2]
    for cut in range(0, len(raw), 13):
        assert read(0, cut) + read(cut, len(raw)) == [1, 2]


def test_archives_of_others(spark, tmp_path):
    """Records as crawlers write them: other types and ids, no digests, other forms of digests, folded and oddly cased headers."""
    sha1 = hashlib.sha1(b"<html>\xff</html>").hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-type:text/html\r\n\r\n<html>\xff</html>"

    def record(*lines, block=b"", feed=b"\r\n"):
        head = [b"WARC/1.0", *(x.encode("latin-1") for x in lines), b"content-LENGTH:" + str(len(block)).encode()]
        return feed.join(head) + feed * 2 + block + feed * 2

    records = [
        record("WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:0001>", "Content-Type: application/warc-fields", block=b"software: x\r\nformat: WARC\r\n"),
        record("WARC-Type: request", "WARC-Record-ID: <urn:uuid:0002>", "WARC-Target-URI: <http://a/>", "Content-Type: application/http; msgtype=request", block=b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        record("warc-type:response", "WARC-RECORD-ID:<urn:uuid:0003>", "WARC-Target-URI: http://a/", "X-Long: a", "  folded", "WARC-Payload-Digest: sha1:" + sha1.upper(), "Content-Type: application/http; msgtype=response", block=http),
        record("WARC-Type: response", "WARC-Record-ID: <urn:uuid:0004>", "WARC-Payload-Digest: sha1:AAAA", "X-Odd: \xe9\xff", "Content-Type: application/http", block=http),
        record("WARC-Type: response", "WARC-Record-ID: <urn:uuid:0005>", "WARC-Payload-Digest: sha1:" + "0" * 40, "Content-Type: application/http", block=http),
        record("WARC-Type: metadata", "WARC-Record-ID: <urn:uuid:0006>", "WARC-Refers-To: <urn:uuid:0003>", block=b"fetchTimeMs: 3", feed=b"\n"),
        record("WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:0007>", "WARC-Refers-To: <urn:uuid:0003>", "Content-Type: application/http"),
        record("WARC-Type: resource", "X-Pad: " + "p" * 9000, "WARC-Record-ID: <urn:uuid:0008>", "WARC-Payload-Digest: sha256:00", block=b"x" * 600_000),
    ]
    folder = tmp_path / "foreign"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    for split in (97, 1 << 24):
        got = {int(r.record_id[-1]): r for r in warc.read_archives(spark, f"file://{folder}", split).collect()}
        assert [got[k].record_type for k in range(1, 9)] == ["warcinfo", "request", "response", "response", "response", "metadata", "revisit", "resource"]
        assert [got[k].digest_ok for k in range(1, 9)] == [None, None, True, None, False, None, None, None]
        assert got[3].payload == got[4].payload == b"<html>\xff</html>" and got[3].payload_digest == got[4].payload_digest == sha1 and got[5].payload_digest == "0" * 40
        assert got[2].url == "http://a/" and got[2].payload == b"" and got[1].payload.startswith(b"software")
        assert got[6].refers_to == got[7].refers_to == "urn:uuid:0003" and got[7].payload is None and got[7].payload_bytes is None and got[8].payload_bytes == 600_000
    assert {r.n for r in warc.read_archives(spark, f"file://{folder}").select(warc.page_number("record_id").alias("n")).collect()} == {None}


def test_urls_come_back_as_they_went_in(spark, tmp_path):
    """Characters that end lines for some readers, and that header values lose at their ends."""
    odd = ["\u2028", "\u2029", "\x85", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\r", "\n", "\r\n", "\t", " ", "\xa0", "\x00", "\u3000", "<", ">", "%0A", "é", "\U0001f600"]
    urls = [f"http://a/{c}WARC-Record-ID: <urn:page:9>{c}WARC-Type: metadata" for c in odd] + [f"{c}http://a/{c}" for c in odd] + ["<http://a/>", "", " ", None, "http://a/?x=1&y=%20"]
    path = f"file://{tmp_path}/urls"
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    warc.write_archives(warc.deduplicated(pages.coalesce(1)), path)
    got = warc.read_archives(spark, path, 500).collect()
    assert sorted((int(r.record_id[9:]), r.url, r.record_type, r.payload.decode()) for r in got) == [(i, u, "response", f"page {i}") for i, u in enumerate(urls)]


def test_damaged_members_are_reported():
    row = {"url": "u", "record_type": "response", "refers_to": None, "payload_bytes": 9000, "payload_digest": "0" * 40}
    whole = [warc.record_bytes(row | {"record_id": f"urn:page:{i}", "payload": random.Random(i).randbytes(4500).hex().encode()}) for i in range(4)]
    broken = bytearray(whole[1])
    broken[len(broken) // 2 :] = bytes(len(broken) - len(broken) // 2)
    read = lambda raw: [(r["record_type"], r["record_id"]) for r in map(warc.parse_record, warc.records_from(io.BytesIO(raw), 0, len(raw)))]
    good = lambda i: ("response", f"urn:page:{i}")
    assert read(whole[0] + bytes(broken) + whole[2] + whole[3][:-9]) == [good(0), (warc.DAMAGED, None), good(2), (warc.DAMAGED, None)]
    assert read(whole[0][:200]) == [(warc.DAMAGED, None)] and read(whole[0][:12]) == []


def test_first_of_repeated_fields_counts():
    head = b"WARC/1.0\r\nWARC-Type: response\r\n x\r\nWARC-Type: metadata\r\n y\r\nno field\r\n z\r\nA: b:c"
    assert warc.header_fields(head) == {"warc-type": "response x", "a": "b:c"}


def test_empty_pages(spark, tmp_path):
    pages, _ = pages_frame(spark)
    path = f"file://{tmp_path}/none"
    warc.write_archives(warc.deduplicated(pages.limit(0)), path)
    assert warc.read_archives(spark, path).count() == 0


def write_corpus(spark, folder):
    rng = random.Random(8)
    item = words_of(rng, 20, 10**6)
    near = words_of(rng, 200, 10**6).split()
    line = "a line that many documents share with others"
    rows = [(i, "\n".join([words_of(rng, 40, 10**6), line if i % 3 == 0 else "own " + str(i), words_of(rng, 30, 10**6)])) for i in range(40)]
    rows += [(50, " ".join(near)), (51, " ".join([*near[:100], "x", *near[101:]])), (52, " ".join(near)), (60, "intro " + item + " outro"), (70, None), (71, "123 456"), (72, line)]
    docs = spark.createDataFrame([(i, t, None if t is None else "en", "s" + str(i % 3), None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, [(1, item)]


def brute_pipeline(rows, items):
    """The ids and texts that the first four stages leave, in plain Python."""
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    strip = " \t\n\x0b\x0c\r"
    home = {}
    for i, t in sorted(kept):
        for x in t.split("\n"):
            home.setdefault(x.strip(strip).translate(TO_LOWER), set()).add(i)
    lines = []
    for i, t in kept:
        own = [x for x in t.split("\n") if len(k := x.strip(strip).translate(TO_LOWER)) < 10 or len(home[k]) < 2 or min(home[k]) == i]
        if len(own) == len(t.split("\n")) or "\n".join(own).strip(strip):
            lines.append((i, "\n".join(own)))
    first = [(i, t) for i, t in lines if jaccard_components(lines)[i][1] == i]
    hits = brute_contamination(first, items)
    return {i: t for i, t in first if not hits[i][1]}


def test_pipeline_against_brute_force(spark, tmp_path):
    folder = f"{tmp_path}/in"
    rows, items = write_corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == columns and out.schema == docs.schema
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    want = brute_pipeline(rows, items)
    assert {r.doc_id: r.text for r in docs.collect()} == want
    assert {50, 0} <= set(want) and not {51, 52, 60, 70, 71, 72} & set(want)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(want)
    assert {i: sum(r.n_tokens for r in packed if r.doc_id == i) for i in want} == {i: len(t.split()) for i, t in want.items()}


def test_near_duplicates_at_five_words_and_80_percent(spark):
    rng = random.Random(8)
    rows = []
    for k in range(0, 400, 10):
        base = words_of(rng, 104, 10**6).split()
        rows += [(k, " ".join(base)), (k + 1, " ".join(base + words_of(rng, 20, 10**6).split())), (k + 2, " ".join(base[: rng.randrange(80, 104)]))]
        for j in range(3, 6):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            rows.append((k + j, " ".join(copy)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = {i for i, (_, first, _) in jaccard_components(rows, 5, 80).items() if first == i}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want
    assert not {1, 11, 21} & want and want != {i for i, (_, first, _) in jaccard_components(rows).items() if first == i}


def test_every_contract_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(SQL) <= set(QUERIES)


def test_stages_on_messy_and_empty_tables(spark, tmp_path):
    rng = random.Random(3)
    long, near = words_of(rng, 20_000, 10**6), words_of(rng, 120, 10**6)
    rows = [(1, near), (1, near), (1, "quite another text under the same number"), (2, near + " end"), (None, near), (None, None), (3, None), (4, ""), (5, long), (6, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` int, lf_key int")
    items = spark.createDataFrame([(1, words_of(rng, 20, 10**6))], "item_id bigint, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, (r.text or "")[:10]) for r in left.collect()) == sorted([(1, near[:10]), (1, "quite anot"), (0, near[:10]), (0, ""), (3, ""), (4, ""), (5, long[:10])])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns and (out.count() == 0) == (table is not docs)
    assert corpus_pipeline.pack(spark, docs, "").select("doc_id").distinct().count() == 7 and corpus_pipeline.pack(spark, docs.limit(0), "").count() == 0
