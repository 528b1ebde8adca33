import pytest
from pyspark.sql import functions as F

from locusframe import sources as S
from locusframe.sources import readers as R


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_fasta_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">chr1 first one\nACgt\nNN\n>chr2\r\nTTT\r\n\n>empty\n")
    got = S.read_fasta(spark, path)
    assert sorted(map(tuple, got.collect())) == [("chr1", "chr1 first one", "ACgtNN"), ("chr2", "chr2", "TTT"), ("empty", "empty", "")]
    S.write_fasta(got.where("seq <> 'empty'"), str(tmp_path / "out"), 2)
    assert sorted((r.seq, r.bases) for r in S.read_fasta(spark, str(tmp_path / "out")).collect()) == [("chr1", "ACgtNN"), ("chr2", "TTT")]


def test_gff_attributes_and_round_trip(spark, tmp_path):
    lines = ["# comment", "c1\tb\tintron\t5\t9\t1.5\t+\t.\tmult=5;pri=4;src=E", "c1\tb\tep\t7\t8\t.\tx\t1\tgrp=g1;source=M2", "c1\tb\tnonsense\t1\t2\t.\t+\t.\tsrc=E", "c1\tb\tCDS\t9\t2\t.\t+\t.\tsrc=E", "c2\tb\tnep\t1\t1\t0\t-\t7\tgroup=a;grp=b;priority=2"]
    got = S.read_gff(spark, put(tmp_path, "h.gff", "\n".join(lines)))
    rows = {(r.seq, r.type): (r.start, r.end, r.score, r.strand, r.frame, r.grp, r.priority, r.mult, r.esource) for r in got.collect()}
    assert rows == {("c1", "intron"): (5, 9, 1.5, "+", ".", None, 4, 5, "E"), ("c1", "exonpart"): (7, 8, None, ".", "1", "g1", -1, 1, "M"), ("c2", "nonexonpart"): (1, 1, 0.0, "-", ".", "a", 2, 1, None)}
    S.write_gff(got, str(tmp_path / "out"))
    again = S.read_gff(spark, str(tmp_path / "out"))
    assert {(r.seq, r.type): (r.start, r.end, r.score, r.strand, r.frame, r.grp, r.priority, r.mult, r.esource) for r in again.collect()} == rows


def test_gff_of_several_species(spark, tmp_path):
    got = S.read_gff(spark, put(tmp_path, "m.gff", "hg19.chr21\tb\tintron\t5\t9\t.\t+\t.\tsrc=E\nmy.sp-c1\tb\texon\t5\t9\t.\t+\t.\tsrc=E"), multi_species=True)
    assert sorted((r.species, r.seq) for r in got.collect()) == [("hg19", "chr21"), ("my.sp", "c1")]


def test_gtf_and_gff3_ids(spark, tmp_path):
    text = 'c\ts\tgene\t1\t9\t.\t+\t.\tg1\nc\ts\ttranscript\t1\t9\t.\t+\t.\tg1.t1\nc\ts\tCDS\t1\t3\t.\t+\t0\ttranscript_id "g1.t1"; gene_id "g1";\nc\ts\tmRNA\t1\t9\t.\t+\t.\tID=m1;Parent=g2\nc\ts\texon\t1\t9\t.\t+\t.\tParent=m1'
    got = S.read_gtf(spark, put(tmp_path, "a.gtf", text), 3)
    assert sorted((r.type, r.gid, r.tid) for r in got.collect() if r.type != "exon") == [("CDS", "g1", "g1.t1"), ("gene", "g1", None), ("mRNA", "g2", "m1"), ("transcript", "g1", "g1.t1")]
    S.write_gtf(got.where("gid is not null"), str(tmp_path / "o"))
    assert sorted((r.type, r.gid, r.tid) for r in S.read_gtf(spark, str(tmp_path / "o")).collect()) == [("CDS", "g1", "g1.t1"), ("gene", "g1", None), ("mRNA", "g2", "m1"), ("transcript", "g1", "g1.t1")]


def test_psl_sam_and_blocks(spark, tmp_path):
    psl = "psLayout\n" + "\t".join("90 1 0 0 0 0 1 100 + q1 100 0 91 c1 1000 10 201 2 50,41, 0,50, 10,160,".split())
    got = S.read_psl(spark, put(tmp_path, "a.psl", psl))
    assert [(r.aid is not None, r.q, r.q_start, r.t, r.t_start, r.size) for r in R.psl_blocks(got).orderBy("q_start").collect()] == [(True, "q1", 0, "c1", 10, 50), (True, "q1", 50, "c1", 160, 41)]
    sam = "@SQ\tSN:c1\tLN:99\nr1/1\t0\tc1\t11\t9\t2S5M2I3M10N4M\t*\t0\t0\tACGTACGTACGTACGT\t*\tNM:i:2\tXS:A:+\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*"
    rows = S.read_sam(spark, put(tmp_path, "a.sam", sam))
    r = rows.where("qname = 'r1/1'").first()
    assert (r.edits, r.seq_len, r.tags["XS"]) == (2, 16, "+")
    blocks = [(b.start, b.end, b.q_start, b.q_end) for b in R.sam_blocks(rows).orderBy("start").collect()]
    assert blocks == [(11, 15, 3, 7), (16, 18, 10, 12), (29, 32, 13, 16)]


def test_wiggle_and_bedgraph(spark, tmp_path):
    text = "track type=wiggle_0\nfixedStep chrom=c1 start=11 step=10 span=2\n1\n2.5\nvariableStep chrom=c2\n7 3\n9 -1\n"
    got = sorted(map(tuple, S.read_wiggle(spark, put(tmp_path, "a.wig", text)).collect()))
    assert got == [("c1", 11, 1.0), ("c1", 12, 1.0), ("c1", 21, 2.5), ("c1", 22, 2.5), ("c2", 7, 3.0), ("c2", 9, -1.0)]
    spans = spark.createDataFrame([("c1", 1, 4, 2.0), ("c1", 5, 6, 3.0), ("c2", 9, 9, 1.0)], "seq string, start bigint, end bigint, value double")
    S.write_wiggle(spans, str(tmp_path / "w"))
    want = sorted((r.seq, p, r.value) for r in spans.collect() for p in range(r.start, r.end + 1))
    assert sorted(map(tuple, S.read_wiggle(spark, str(tmp_path / "w")).collect())) == want
    S.write_bedgraph(spans, str(tmp_path / "b"))
    assert sorted(map(tuple, S.read_bedgraph(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, spans.collect()))


def test_maf_fragments(spark, tmp_path):
    maf = "##maf\n\na score=1\ns hg.chr1 10 4 + 100 AC--GT\ns mm.c 3 5 - 50 -CCCGT\n\na score=2\ns hg.chr1 30 1 + 100 A\n"
    got = S.read_maf(spark, put(tmp_path, "a.maf", maf))
    assert got.count() == 3 and got.select("block").distinct().count() == 2
    f = sorted((r.species, r.chr_pos, r.ali_pos, r.len) for r in R.maf_fragments(got).collect())
    assert f == [("hg", 10, 0, 2), ("hg", 12, 4, 2), ("hg", 30, 0, 1), ("mm", 3, 1, 5)]


def test_genbank_round_trip(spark, tmp_path):
    sequences = spark.createDataFrame([("c1", "ACGT" * 50)], "seq string, bases string")
    genes = spark.createDataFrame([("g1", "c1", "-", [(21, 30), (41, 60)]), ("g2", "c1", "+", [(101, 103)])], "gid string, seq string, strand string, parts array<struct<start:bigint,end:bigint>>")
    S.write_genbank(genes, sequences, str(tmp_path / "gb"), 5)
    got = {r.seq: r for r in S.read_genbank(spark, str(tmp_path / "gb")).collect()}
    one = [f for f in got["c1_16_65"].features if f.kind == "CDS"][0]
    assert (one.strand, one.gene, [tuple(p) for p in one.parts]) == ("-", "g1", [(6, 15), (26, 45)])
    assert got["c1_16_65"].bases == ("acgt" * 50)[15:65] and got["c1_96_108"].length == 13


def test_newick_config_and_profile(spark, tmp_path):
    tree = S.read_newick(spark, put(tmp_path, "t.nwk", "((a:0.1,'b c':2)x:0.5,[note]c:1e-1);"))
    assert [(tree.name[i], tree.length[i], tree.name[p] if p >= 0 else None) for i, p in enumerate(tree.parent)] == [("", 0.0, None), ("x", 0.5, ""), ("a", 0.1, "x"), ("b c", 2.0, "x"), ("c", 0.1, "")]
    assert tree.edges(spark).count() == 5
    with pytest.raises(ValueError):
        R.parse_newick("((a,b);")
    rows = S.read_config(spark, put(tmp_path, "x.cfg", "[SOURCES]\nM E\n[GENERAL]\nintron 1 .34 M 1 1e+100 E 2 10 1.5 9 # c\nexonpart 1 .99 .98 M 1 5\n")).collect()
    assert [(r.type, r.malus, r.local_malus, r.source, r.bounds, r.quots) for r in rows] == [("intron", 0.34, None, "M", [], [1e100]), ("intron", 0.34, None, "E", [10.0], [1.5, 9.0]), ("exonpart", 0.99, 0.98, "M", [], [5.0])]
    columns = "\t".join(["0.05"] * 20)
    blocks, gaps = S.read_profile(spark, put(tmp_path, "p.prfl", f"[name]\nx\n[dist]\n3 *\n[block]\nname=b\n0\t{columns}\n1\t{columns}\n[dist]\n0 5\n"))
    assert blocks.count() == 40 and [tuple(r) for r in gaps.collect()] == [(0, 3, None), (1, 0, 5)]


def test_bed12(spark, tmp_path):
    s = spark.createDataFrame([("t", "c", "+", "UTR", 1, 5), ("t", "c", "+", "CDS", 6, 10), ("t", "c", "+", "CDS", 21, 30)], "tid string, seq string, strand string, type string, start bigint, end bigint")
    S.write_bed12(s, str(tmp_path / "b"))
    assert [r.value for r in spark.read.text(str(tmp_path / "b")).collect()] == ["c\t0\t30\tt\t0\t+\t5\t30\t0\t3\t5,5,10,\t0,5,20,"]
    assert F.col is not None


def test_genome_store(spark, tmp_path):
    from locusframe.sources.store import GenomeStore, dimension

    store = GenomeStore(spark, str(tmp_path / "store"))
    bases = "ACGTTGCA" * 30
    store.load_genome("fly", spark.createDataFrame([("c1", bases), ("c2", "AC")], "seq string, bases string"), 50)
    store.load_genome("man", spark.createDataFrame([("c1", "GG")], "seq string, bases string"), 50)
    hints = S.read_gff(spark, put(tmp_path, "s.gff", "c1\tb\tintron\t5\t90\t1\t+\t.\tsrc=E\nc1\tb\tintron\t5\t90\t1\t+\t.\tsrc=E\nc9\tb\texon\t1\t2\t1\t+\t.\tsrc=E"))
    store.load_hints("fly", hints)
    regions = spark.createDataFrame([(1, "c1", 45, 160), (2, "c2", 1, 2), (3, "c1", 100, 100)], "rid int, seq string, start bigint, end bigint")
    assert {r.rid: r.bases for r in store.bases("fly", regions).collect()} == {1: bases[44:160], 2: "AC", 3: bases[99]}
    assert [r.rid_r for r in store.hints("fly", regions).collect()] == [1]
    assert store.hints("fly", regions, "end_in_range").count() == 1
    assert [(r.species, r.seq) for r in store.orphan_sequences().collect()] == [("fly", "c9")]
    store.delete("man")
    assert store.species() == ["fly"]
    known = dimension(spark.createDataFrame([("b",), ("a",), ("b",)], "name string"), "name")
    more = dimension(spark.createDataFrame([("0",), ("a",)], "name string"), "name", known)
    assert sorted(map(tuple, more.collect())) == [("0", 3), ("a", 1), ("b", 2)]
