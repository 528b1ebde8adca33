"""Cases worked out by hand from the rules, where a query's SQL could share a mistake with its operator."""

import pytest

from locusframe import sources as S
from locusframe.operators import alignments, decode, evaluation, evidence, genes, sequences


def test_identity_counts_clipped_and_edited_bases(spark):
    rows = [(1, "50M50S", 100, 4, "A" * 100), (2, "100M", 100, 4, "=" * 90 + "A" * 10), (3, "40M5D60M", 100, None, "=" * 95 + "C" * 5), (4, "*", 0, 0, "")]
    sam = spark.createDataFrame(rows, "aid int, cigar string, seq_len int, edits int, seq string")
    assert {r.aid: r.identity for r in alignments.measured(sam).collect()} == {1: 46.0, 2: 96.0, 3: 100.0, 4: None}
    assert {r.aid: r.identity for r in alignments.measured(sam, equal_signs=True).collect()} == {1: 0.0, 2: 90.0, 3: 90.0, 4: None}
    assert alignments.measured(sam.limit(0)).count() == 0


@pytest.mark.parametrize("width", [64, 1 << 14])
def test_close_transcript_ends_exclude_each_other(spark, width):
    rows = [
        (1, "tts", 1000, 1000, "+"),
        (2, "tts", 1400, 1400, "+"),
        (3, "tts", 2000, 2000, "+"),
        (4, "tts", 2001, 2001, "+"),
        (5, "tts", 1400, 1400, "-"),
        (6, "tss", 1001, 1001, "+"),
        (7, "tss", 1002, 1003, "+"),
    ]
    hints = spark.createDataFrame([("c", *r) for r in rows], "seq string, hint_id bigint, type string, start bigint, end bigint, strand string")
    got = {(r.hint_id, r.hint_id_r) for r in evidence.hint_pairs(hints, None, width).where("hint_id < hint_id_r and not compatible").collect()}
    # middles at most 1000 apart on one strand; ends of transcripts on both strands, and starts that don't touch, may stand together
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    weak = evidence.hint_pairs(hints, None, width).where("hint_id <> hint_id_r and weaker").count()
    # 2 and 5 stand at one place; close ends are never weaker
    assert weak == 2


def test_exon_classes_without_overlap(spark):
    p = spark.createDataFrame([(1, "c", "+", 100, 110), (2, "c", "+", 200, 300), (3, "c", "+", 400, 500), (4, "c", "+", 600, 700), (5, "c", "-", 600, 700), (6, "d", "+", 1, 9)], "id int, seq string, strand string, start bigint, end bigint")
    a = spark.createDataFrame([("c", "+", 111, 121), ("c", "+", 200, 350), ("c", "+", 450, 560), ("c", "+", 600, 700), ("c", "+", 800, 900)], "seq string, strand string, start bigint, end bigint")
    assert {r.id: r["class"] for r in evaluation.exon_classes(p, a).collect()} == {1: 3, 2: 2, 3: 1, 4: 4, 5: 0, 6: 0}
    assert {r.start: r["class"] for r in evaluation.exon_classes(a, p.drop("id")).collect()} == {111: 3, 200: 2, 450: 1, 600: 4, 800: 0}


def test_incomplete_left_ends_reach_further(spark):
    rows = [(1, "c", 0, 1000, False), (2, "c", 900, 2000, False), (3, "c", 6999, 7500, True), (4, "c", 8000, 8100, False), (5, "c", 13100, 13200, True), (6, "d", 5, 9, True)]
    t = spark.createDataFrame(rows, "tid int, seq string, start bigint, end bigint, left_open boolean")
    of = lambda df: {r.tid: (r.seq, r.cluster) for r in df.collect()}
    # 6999 is under 2000 + 5000; 8000 is complete; 13100 isn't under 8100 + 5000
    assert of(genes.overlap_clusters(t)) == {1: ("c", 1), 2: ("c", 1), 3: ("c", 1), 4: ("c", 3), 5: ("c", 4), 6: ("d", 1)}
    assert of(genes.overlap_clusters(t, small=2))[3] == ("c", 2)
    assert of(genes.overlap_clusters(t.drop("left_open")))[3] == ("c", 2)


def test_fasta_headers_may_hold_the_mark(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_bytes(b">chr1 len>1000\nACGT\nAC\n>chr2\r\nTT\r\n>chr3 a>b>c\n")
    got = {r.seq: (r.header, r.bases) for r in S.read_fasta(spark, str(path)).collect()}
    assert got == {"chr1": ("chr1 len>1000", "ACGTAC"), "chr2": ("chr2", "TT"), "chr3": ("chr3 a>b>c", "")}


def test_peptides_at_each_place(spark):
    peptides = spark.createDataFrame([(1, "KK"), (1, ""), (1, "X"), (2, "MKKKKKKK")], "tid int, peptide string")
    proteins = spark.createDataFrame([(1, "KKKM"), (2, "MK")], "tid int, protein string")
    cds = spark.createDataFrame([(1, "c", 101, 112, "+", 0)], "tid int, seq string, start bigint, end bigint, strand string, offset bigint")
    assert sorted((r["at"], r.start, r.end) for r in alignments.peptide_hits(peptides, proteins, cds).collect()) == [(1, 101, 106), (2, 104, 109)]


def test_chunks_meet_regions_by_bins(spark):
    text = "".join("ACGT"[(i * 7 + i // 9) % 4] for i in range(5000))
    q = spark.createDataFrame([("c", text), ("e", "")], "seq string, bases string")
    spans = [(1, 1, 10), (2, 95, 105), (3, 1, 5000), (4, 4990, 6000), (5, 777, 3001)]
    regions = spark.createDataFrame([(i, "c", a, b) for i, a, b in spans], "rid int, seq string, start bigint, end bigint")
    for width in (64, 1 << 16):
        got = {r.rid: r.bases for r in sequences.fetch_chunks(sequences.chunked(q, 100), regions, width).collect()}
        assert got == {i: text[a - 1 : b] for i, a, b in spans}


def test_repeated_names_are_all_decoded(spark):
    from .test_operators import small_model

    model = small_model()
    two = spark.createDataFrame([("a", "ACGTACGTGG"), ("a", "GGGGGGGGAC")], "seq string, bases string")
    each = [decode.decoded(two.where(f"bases = '{b}'"), model).count() for b in ("ACGTACGTGG", "GGGGGGGGAC")]
    assert decode.decoded(two, model).count() == sum(each)
    assert decode.sampled_paths(two, model, 2).where("begin = 1").count() == 4
