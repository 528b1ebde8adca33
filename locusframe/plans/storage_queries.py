"""Files and stores: whole tables are written in a format, read back and compared with the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_bam, readers, write_bam, writers
from ..operators.evidence import in_order
from ..sources.store import GenomeStore
from ..tables import shared_path
from .registry import query
from .views import IV, SEQ, SIGNAL, intervals, sequences, signal


def _path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _lines(spark: SparkSession, name: str, lines: DataFrame) -> str:
    path = _path(spark, name)
    lines.write.text(path)
    return path


@query(
    "fasta_round_trip",
    f"with {SEQ} select seq::varchar as seq, length(bases)::bigint as n_bases, md5(bases) as digest from sequences",
)
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence through FASTA of 60 letters a line."""
    path = _path(spark, "fasta")
    writers.write_fasta(sequences(spark, sf_dir), path)
    return readers.read_fasta(spark, path).select("seq", F.length("bases").cast("long").alias("n_bases"), F.md5("bases").alias("digest"))


def _hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = intervals(spark, sf_dir)
    return iv.select(_s("seq").alias("seq"), F.lit("stand-in").alias("source"), "type", "start", "end", F.lit(0.5).alias("score"), "strand", F.lit(".").alias("frame"), _s("id").alias("grp"), "mult", "priority", F.col("src").alias("esource"))


@query(
    "gff_round_trip",
    f"with {IV} select id::varchar as grp, seq::varchar as seq, type, s as start_pos, e as end_pos, strand, mult, priority, src as esource, 0.5::double as score from iv",
)
def gff_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hint and its attributes through GFF."""
    path = _path(spark, "gff")
    writers.write_gff(_hints(spark, sf_dir), path)
    got = readers.read_gff(spark, path)
    return got.select("grp", "seq", "type", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "strand", F.col("mult").cast("long").alias("mult"), F.col("priority").cast("long").alias("priority"), "esource", "score")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts by order and supplier, whose lines are exons."""
    gid = F.concat_ws("_", F.lit("g"), F.floor(F.col("id") / 10).cast("string"), _s("seq"), F.ascii("strand").cast("string"))
    return intervals(spark, sf_dir).select(_s("seq").alias("seq"), F.lit("stand-in").alias("source"), F.lit("exon").alias("type"), "start", "end", F.lit(1.5).alias("score"), "strand", F.lit(".").alias("frame"), gid.alias("gid"), F.concat(gid, F.lit(".t1")).alias("tid"))


SEGMENTS = f"""{IV}, segments as (
  select seq::varchar as seq, s, e, strand, concat_ws('_', 'g', (id // 10)::varchar, seq::varchar, ascii(strand)::varchar) as gid from iv)"""


@query("gtf_round_trip", f"with {SEGMENTS} select gid, gid || '.t1' as tid, seq, s as start_pos, e as end_pos, strand, 1.5::double as score from segments")
def gtf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exon through GTF."""
    path = _path(spark, "gtf")
    writers.write_gtf(_segments(spark, sf_dir), path)
    return readers.read_gtf(spark, path).select("gid", "tid", "seq", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "strand", "score")


@query("gff3_round_trip", f"with {SEGMENTS} select gid || '.t1' as tid, seq, s as start_pos, e as end_pos, strand, count(*) as n from segments group by all")
def gff3_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exon through GFF3, where it names its transcript."""
    path = _path(spark, "gff3")
    writers.write_gtf(_segments(spark, sf_dir), path, gff3=True)
    got = readers.read_gtf(spark, path)
    return got.groupBy("tid", "seq", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "strand").agg(F.count(F.lit(1)).alias("n"))


@query(
    "bed12_lines",
    f"""with {SEGMENTS}, exons as (select distinct gid, seq, strand, s, e from segments), ends as (select gid, seq, strand, min(s) as lo, max(e) as hi from exons group by all)
    select gid || '.t1' as name, seq, strand, (lo - 1)::bigint as chrom_start, any_value(hi)::bigint as chrom_end, count(*)::int as n_blocks,
      string_agg((e - s + 1)::varchar, ',' order by s, e) || ',' as sizes, string_agg((s - lo)::varchar, ',' order by s, e) || ',' as starts
    from exons join ends using (gid, seq, strand) group by gid, seq, strand, lo""",
)
def bed12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with their blocks through BED of 12 columns."""
    path = _path(spark, "bed")
    writers.write_bed12(_segments(spark, sf_dir), path)
    fields = "seq string, chrom_start bigint, chrom_end bigint, name string, score int, strand string, thick_start bigint, thick_end bigint, colour string, n_blocks int, sizes string, starts string"
    return spark.read.option("sep", "\t").schema(fields).csv(path).select("name", "seq", "strand", "chrom_start", "chrom_end", "n_blocks", "sizes", "starts")


@query("wiggle_round_trip", f"with {IV}, {SIGNAL} select seq::varchar as seq, pos, value::double as value from signal")
def wiggle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal through variable step tracks."""
    path = _path(spark, "wiggle")
    writers.write_wiggle(signal(spark, sf_dir).select(_s("seq").alias("seq"), F.col("pos").alias("start"), F.col("pos").alias("end"), "value"), path)
    return readers.read_wiggle(spark, path)


@query("bedgraph_round_trip", f"with {IV}, {SIGNAL} select seq::varchar as seq, pos as start_pos, pos as end_pos, value::double as value from signal")
def bedgraph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal through bedGraph."""
    path = _path(spark, "bedgraph")
    writers.write_bedgraph(signal(spark, sf_dir).select(_s("seq").alias("seq"), F.col("pos").alias("start"), F.col("pos").alias("end"), "value"), path)
    got = readers.read_bedgraph(spark, path)
    return got.select("seq", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "value")


@query(
    "psl_read_blocks",
    f"""with {IV}, blocks as (
      select id, seq, unnest([{{'q': 0, 't': s, 'n': e - s + 1}}, {{'q': e - s + 3, 't': e + 11, 'n': mult}}]) as b from iv)
    select id::varchar as q, b.q::bigint as q_start, seq::varchar as t, b.t::bigint as t_start, b.n::bigint as size, '+' as strand from blocks""",
)
def psl_read_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of alignments of two blocks each."""
    size, zero = F.col("end") - F.col("start") + 1, F.lit("0")
    two = lambda a, b: F.concat(_s(a), F.lit(","), _s(b), F.lit(","))
    line = F.concat_ws(
        "\t", _s(size), *[zero] * 7, F.lit("+"), _s("id"), F.lit("9999"), zero, _s(size + 2 + F.col("mult")), _s("seq"), F.lit("99999"), _s("start"), _s(F.col("end") + 11 + F.col("mult")), F.lit("2"),
        two(size, F.col("mult")), two(F.lit(0), size + 2), two(F.col("start"), F.col("end") + 11),
    )
    path = _lines(spark, "psl", intervals(spark, sf_dir).select(line.alias("value")))
    return readers.psl_blocks(readers.read_psl(spark, path)).drop("aid")


@query(
    "sam_read_blocks",
    f"""with {IV}, lines as (select seq, s + 1 as pos, e - s + 1 as m, mult as i, priority as clip from iv where strand <> '.'), blocks as (
      select seq, unnest([{{'t': pos, 'q': clip + 1, 'n': m}}, {{'t': pos + m, 'q': clip + m + i + 1, 'n': m}}, {{'t': pos + 2 * m + 10, 'q': clip + 2 * m + i + 1, 'n': 5}}]) as b from lines)
    select seq::varchar as seq, b.t::bigint as start_pos, (b.t + b.n - 1)::bigint as end_pos, b.q::bigint as q_start, (b.q + b.n - 1)::bigint as q_end from blocks""",
)
def sam_read_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of mapped lines with clips, insertions and deletions; lines without a strand are unmapped."""
    path = _lines(spark, "sam", _sam_lines(spark, sf_dir))
    got = readers.sam_blocks(readers.read_sam(spark, path))
    return got.select("seq", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "q_start", "q_end")


def _sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _s(F.col("end") - F.col("start") + 1)
    cigar = F.concat(_s("priority"), F.lit("S"), m, F.lit("M"), _s("mult"), F.lit("I"), m, F.lit("M10D5M"))
    flag = F.when(F.col("strand") == "+", "0").when(F.col("strand") == "-", "16").otherwise("4")
    line = F.concat_ws("\t", _s("id"), flag, _s("seq"), _s(F.col("start") + 1), F.lit("60"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("NM:i:1"))
    return intervals(spark, sf_dir).select(line.alias("value"))


def _through_bam(spark: SparkSession, sam: DataFrame) -> DataFrame:
    """Alignments written as binary files and read in ranges of 100 kB."""
    names = sam.select(F.col("rname").alias("seq")).where("seq <> '*'").distinct().withColumn("length", F.lit(1_000_000))
    # a full URI, as Arrow's file systems ask for one
    path = spark._jvm.org.apache.hadoop.fs.Path(_path(spark, "bam"))
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    write_bam(sam, path, names)
    return read_bam(spark, path, 100_000)


@query(
    "bam_read_blocks",
    f"""with {IV}, lines as (select id, seq, s + 1 as pos, e - s + 1 as m, mult as i, priority as clip from iv where strand <> '.'), blocks as (
      select id, seq, unnest([{{'t': pos, 'q': clip + 1, 'n': m}}, {{'t': pos + m, 'q': clip + m + i + 1, 'n': m}}, {{'t': pos + 2 * m + 10, 'q': clip + 2 * m + i + 1, 'n': 5}}]) as b from lines)
    select seq::varchar as seq, b.t::bigint as start_pos, (b.t + b.n - 1)::bigint as end_pos, b.q::bigint as q_start, (b.q + b.n - 1)::bigint as q_end from blocks""",
)
def bam_read_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of :func:`sam_read_blocks` through binary files."""
    text = _lines(spark, "sam", _sam_lines(spark, sf_dir))
    got = readers.sam_blocks(_through_bam(spark, readers.read_sam(spark, text)))
    return got.select("seq", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "q_start", "q_end")


@query(
    "paired_filter",
    f"""with {IV}, reads as (
      select id, id % 16 as flag, seq, id % 5 as away, e - s + 1 as m, mult as i, priority as clip, id % 4 as d, id % 9 as edits from iv
    ), measured as (
      select *, m + i + clip as q from reads
    ), judged as (
      select *, 100.0 * (q - edits - clip) / q as identity, 100.0 * (m + i) / q as cover from measured
    )
    select case when flag & 4 <> 0 then 'unmapped' when flag & 1 = 0 then 'not paired' when flag & 8 <> 0 then 'mate unmapped' when away not in (0, 1) then 'other target'
      when identity < 70 then 'identity' when cover < 85 then 'cover' when i + d > 4 then 'insert' else 'kept' end as reason,
      count(*) as n, sum(m)::bigint as matched, sum(i)::bigint as inserted, sum(d)::bigint as deleted, round(sum(identity), 3) as identity, round(sum(cover), 3) as cover
    from judged group by reason""",
)
def paired_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why alignments, read from binary files with their bases, fail the filters of pairs."""
    from ..operators.alignments import judged

    iv = intervals(spark, sf_dir)
    size = (F.col("end") - F.col("start") + 1 + F.col("mult") + F.col("priority")).cast("int")
    cigar = F.concat(_s("priority"), F.lit("S"), _s(F.col("end") - F.col("start")), F.lit("M"), _s("mult"), F.lit("I"), F.when(F.col("id") % 4 > 0, F.concat(_s(F.col("id") % 4), F.lit("D"))).otherwise(""), F.lit("1M"))
    away = F.col("id") % 5
    rnext = F.when(away == 0, "=").when(away == 1, _s("seq")).when(away == 2, "*").otherwise("elsewhere")
    sam = iv.select(
        _s("id").alias("qname"), (F.col("id") % 16).cast("int").alias("flag"), _s("seq").alias("rname"), (F.col("start") + 1).alias("pos"), F.lit(60).alias("mapq"), cigar.alias("cigar"), rnext.alias("rnext"), F.lit(1).cast("long").alias("pnext"),
        F.lit(0).alias("tlen"), F.repeat(F.lit("A"), size).alias("seq"), F.lit("*").alias("qual"), F.create_map(F.lit("NM"), _s(F.col("id") % 9)).alias("tags"),
    )
    out = judged(_through_bam(spark, sam), paired=True, no_introns=True, identity=70.0, cover=85.0, insert=4)
    sums = [F.sum(c).alias(c) for c in ("matched", "inserted", "deleted")] + [F.round(F.sum(c), 3).alias(c) for c in ("identity", "cover")]
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), *sums)


@query(
    "maf_read_fragments",
    f"""with {IV}, runs as (
      select seq, priority, unnest([{{'c': s, 'a': 0, 'n': (e - s) % 7 + 1}}, {{'c': s + (e - s) % 7 + 1, 'a': (e - s) % 7 + 1 + mult, 'n': priority}}]) as f from iv)
    select 'sp' || priority as species, 'c' || seq as seq, f.c::bigint as chr_pos, f.a::bigint as ali_pos, f.n::bigint as len from runs""",
)
def maf_read_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gapless fragments of aligned rows with one gap each."""
    first = ((F.col("end") - F.col("start")) % 7 + 1).cast("int")
    text = F.concat(F.repeat(F.lit("A"), first), F.repeat(F.lit("-"), F.col("mult").cast("int")), F.repeat(F.lit("C"), F.col("priority").cast("int")))
    row = F.concat_ws(" ", F.lit("s"), F.concat(F.lit("sp"), _s("priority"), F.lit(".c"), _s("seq")), _s("start"), _s(first + F.col("priority")), F.lit("+"), F.lit("99999"), text)
    path = _lines(spark, "maf", intervals(spark, sf_dir).select(F.concat(F.lit("a score=0\n"), row, F.lit("\n")).alias("value")))
    return readers.maf_fragments(readers.read_maf(spark, path)).select("species", "seq", "chr_pos", "ali_pos", "len")


@query(
    "store_bases",
    f"""with {SEQ} select seq as rid, 1 as half, md5(substr(bases, 1, (length(bases) // 2)::bigint)) as digest from sequences where length(bases) > 1
    union all select seq, 2, md5(substr(bases, (length(bases) // 2 + 1)::bigint)) from sequences where length(bases) > 0""",
)
def store_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of each sequence, from a store in chunks of 1000 bases; another species was deleted."""
    store, seqs = GenomeStore(spark, _path(spark, "store")), sequences(spark, sf_dir)
    for species in ("kept", "gone"):
        store.load_genome(species, seqs, size=1000)
    store.delete("gone")
    n = F.length("bases").cast("long")
    half = F.explode(F.array(F.struct(F.lit(1).alias("half"), F.lit(1).cast("long").alias("start"), F.floor(n / 2).alias("end")), F.struct(F.lit(2).alias("half"), (F.floor(n / 2) + 1).alias("start"), n.alias("end"))))
    regions = seqs.select("seq", half.alias("h")).where("h.start <= h.end").select((F.col("seq") * 2 + F.col("h.half") - 1).alias("rid"), "seq", "h.start", "h.end")
    return store.bases("kept", regions).select(F.floor(F.col("rid") / 2).alias("rid"), (F.col("rid") % 2 + 1).cast("int").alias("half"), F.md5("bases").alias("digest"))


@query(
    "store_hints",
    f"with {IV} select seq::varchar as seq, type, s as start_pos, e as end_pos, strand, priority, mult, count(*) as n from (select distinct seq, type, s, e, strand, priority, mult, src, id from iv) group by all",
)
def store_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints loaded twice over in one load: equal ones stay once."""
    store, hints = GenomeStore(spark, _path(spark, "store")), _hints(spark, sf_dir)
    store.load_hints("kept", hints.unionByName(hints))
    return store.table("hints").groupBy("seq", "type", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "strand", "priority", "mult").agg(F.count(F.lit(1)).alias("n"))


@query("hint_order", f"with {IV} select id, seq, row_number() over (partition by seq order by e, s, strand, mult, src, id) as place from iv")
def hint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each hint of a sequence by end, start, strand, frame (the stand-in has multiplicities) and source."""
    hints = intervals(spark, sf_dir).select("id", "seq", "end", "start", "strand", F.col("mult").alias("frame"), F.col("src").alias("source"))
    return in_order(hints, ("id",)).select("id", "seq", "place")


GENES = f"""{SEQ}, genes as (
  select seq, 'g' || seq || '.' || k as gid, k, k * 400 + 31 as s, k * 400 + 230 as e, case when k % 2 = 0 then '+' else '-' end as strand
    from (select seq, unnest(range(0, length(bases) // 400)) as k from sequences)
  union all select seq, 'h' || seq || '.' || k, k, k * 400 + 200, k * 400 + 260 + k % 7 * 20, '+' from (select seq, unnest(range(0, length(bases) // 400)) as k from sequences) where k % 3 = 0
), parts as (select seq, gid, strand, s as p, s + 49 as q from genes union all select seq, gid, strand, e - 9, e from genes)"""


@query(
    "genbank_round_trip",
    f"""with {GENES}, clusters as (
      select seq, k, min(s) as lo, max(e) as hi from genes group by seq, k
    ), loci as (
      select seq, k, greatest(1, lo - 120, coalesce((lag(hi) over w + lo) // 2 + 1, 1)) as lo, least(length(bases), hi + 120, coalesce((hi + lead(lo) over w) // 2, length(bases))) as hi, bases
      from clusters join sequences using (seq) window w as (partition by seq order by lo)
    )
    select g.gid, g.seq::varchar as seq, g.strand, x.p as start_pos, x.q as end_pos, (hi - lo + 1)::bigint as n_bases, md5(lower(substr(bases, lo::bigint, (hi - lo + 1)::bigint))) as digest
    from genes g join parts x using (seq, gid) join loci l on l.seq = g.seq and l.k = g.k""",
)
def genbank_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes of every sequence with their flanks through GenBank records, and back to the sequence's coordinates."""
    from ..operators.loci import flanked_loci, gene_parts, with_bases
    from ..operators.sequences import chunked

    seqs = sequences(spark, sf_dir).withColumn("seq", _s("seq"))
    n = F.floor(F.length("bases") / 400).cast("int")
    rows = seqs.where(n > 0).select("seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    at = F.col("k").cast("long") * 400
    genes = rows.select("seq", F.concat(F.lit("g"), "seq", F.lit("."), _s("k")).alias("gid"), (at + 31).alias("s"), (at + 230).alias("e"), F.when(F.col("k") % 2 == 0, "+").otherwise("-").alias("strand"))
    more = rows.where("k % 3 = 0").select("seq", F.concat(F.lit("h"), "seq", F.lit("."), _s("k")).alias("gid"), (at + 200).alias("s"), (at + 260 + F.col("k") % 7 * 20).alias("e"), F.lit("+").alias("strand"))
    part = F.explode(F.array(F.struct(F.col("s").alias("start"), (F.col("s") + 49).alias("end")), F.struct((F.col("e") - 9).alias("start"), F.col("e").alias("end"))))
    parts = genes.unionByName(more).select("gid", "seq", "strand", part.alias("p")).select("gid", "seq", "strand", "p.start", "p.end")
    lengths = seqs.select("seq", F.length("bases").cast("long").alias("length"))
    path = _path(spark, "genbank")
    writers.write_loci(with_bases(flanked_loci(parts, lengths, 120), chunked(seqs, 1000)), path)
    records = readers.read_genbank(spark, path)
    digest = records.select("seq", F.md5("bases").alias("digest"), "features", "length")
    found = gene_parts(digest.select(F.col("seq"), "length", F.transform("features", lambda f: f.withField("gene", F.concat_ws("|", f["gene"], F.col("digest")))).alias("features")))
    name = F.split("gid", "\\|")
    return found.select(F.get(name, F.lit(0)).alias("gid"), "seq", "strand", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.col("length").alias("n_bases"), F.get(name, F.lit(1)).alias("digest"))


@query(
    "genepred_round_trip",
    f"""with {SEGMENTS}, parts as (select distinct gid, seq, strand, s, e, case when s % 3 = 0 then 'CDS' else 'exon' end as type from segments where strand <> '.'), kinds as (
      select gid, seq, strand, list(distinct {{'s': s, 'e': e}}) filter (where type = 'exon') as x, list(distinct {{'s': s, 'e': e}}) filter (where type = 'CDS') as c from parts group by all
    )
    select gid || '.t1' as tid, seq, strand, list_min(list_transform(coalesce(x, c), lambda v: v.s)) as start_pos, list_max(list_transform(coalesce(x, c), lambda v: v.e)) as end_pos,
      list_min(list_transform(c, lambda v: v.s)) as cds_start, list_max(list_transform(c, lambda v: v.e)) as cds_end, len(coalesce(x, c))::int as n_exons, list_sum(list_transform(coalesce(x, c), lambda v: v.e - v.s + 1))::bigint as bases
    from kinds""",
)
def genepred_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with exons and coding parts through genePred."""
    path = _path(spark, "genepred")
    kind = F.when(F.col("start") % 3 == 0, "CDS").otherwise("exon")
    writers.write_genepred(_segments(spark, sf_dir).where("strand <> '.'").withColumn("type", kind), path)
    bases = F.aggregate("exons", F.lit(0).cast("long"), lambda got, x: got + x["end"] - x["start"] + 1)
    return readers.read_genepred(spark, path).select("tid", "seq", "strand", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "cds_start", "cds_end", F.size("exons").alias("n_exons"), bases.alias("bases"))


#: A configuration of weights in the usual sections.
CONFIG = """# weights of the stand-in's hints
[SOURCES]
F O   # two sources
[SOURCE-PARAMETERS]
O 1group1gene individual_liability
[GENERAL]
exon 1.5 .9 F 1 1e+3 O 3 20000 60000 1 2 4.5
intron 1 .34 F 2 30000 1 10 O 1 1
CDSpart 1 .985 .97 F 1 1 O 2 40000 .5 2
"""


@query(
    "configured_hints",
    f"""with {IV}, weights as (
      select *, case type when 'exon' then 1.5 else 1.0 end as bonus, case type when 'exon' then .9 when 'intron' then .34 else .985 end as malus, case type when 'CDSpart' then .97 end as local_malus,
        case when type = 'exon' and src = 'O' then (score >= 20000)::int + (score >= 60000)::int when type = 'intron' and src = 'F' then (score >= 30000)::int when type = 'CDSpart' and src = 'O' then (score >= 40000)::int else 0 end as grade
      from iv where type in ('exon', 'intron', 'CDSpart')
    )
    select type, src as source, grade, count(*) as n, bonus::double as bonus, malus::double as malus, local_malus::double as local_malus,
      (case when type = 'exon' and src = 'F' then 1000 when type = 'exon' then [1, 2, 4.5][grade + 1] when type = 'intron' and src = 'F' then [1, 10][grade + 1] when type = 'CDSpart' and src = 'O' then [.5, 2][grade + 1] else 1 end)::double as quotient,
      case src when 'O' then '1group1gene individual_liability' else '' end as parameters
    from weights group by all""",
)
def configured_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints by type, source and grade with the weights and parameters of a configuration that was written and read."""
    from ..operators.evidence import configured

    path = _lines(spark, "config", spark.createDataFrame([(CONFIG,)], "value string"))
    iv = intervals(spark, sf_dir).withColumnRenamed("src", "source")
    sections = readers.read_sections(spark, path)
    told = sections.where("section = 'SOURCE-PARAMETERS'").select(F.col("name").alias("source"), F.array_join("values", " ").alias("parameters"))
    known = sections.where("section = 'SOURCES'").select(F.col("name").alias("source")).join(told, "source", "left")
    rows = configured(iv, readers.read_config(spark, path)).join(known, "source")
    return rows.groupBy("type", "source", "grade", "bonus", "malus", "local_malus", "quotient", F.coalesce("parameters", F.lit("")).alias("parameters")).agg(F.count(F.lit(1)).alias("n"))
