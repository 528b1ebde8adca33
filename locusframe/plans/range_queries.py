"""Gene ranges, junctions, splice candidates and sampled sequences over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codon_classes as C
from ..operators import junctions as J
from ..operators import orthoexons as O
from ..operators import ranges as R
from ..operators import simulate as X
from .registry import query
from .views import IV, SEQ, intervals, sequences, table


def alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as alignments, their lines as species: ``ali, species, seq, strand, start, end, len``."""
    t = table(spark, sf_dir, "lineitem")
    start = F.col("l_orderkey") * 60 + F.col("l_suppkey") % 20
    rows = t.select(
        F.col("l_orderkey").cast("long").alias("ali"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("species"), F.concat(F.lit("c"), F.floor(F.col("l_orderkey") / 500).cast("string")).alias("seq"), F.when(F.col("l_partkey") % 11 == 0, "-").otherwise("+").alias("strand"),
        start.cast("long").alias("start"), (start + F.col("l_quantity").cast("long")).cast("long").alias("end"), (F.floor(F.col("l_quantity").cast("long") / 2) + 1).cast("long").alias("len"),
    )
    least = F.min(F.struct("start", "end", "seq", "strand", "len")).alias("r")
    return rows.groupBy("ali", "species").agg(least).select("ali", "species", "r.seq", "r.strand", "r.start", "r.end", "r.len")


ROWS = """ali_rows as (
  select ali, species, r.seq, r.strand, r.s, r.e, r.len from (select ali, species, min({'s': s, 'e': e, 'seq': seq, 'strand': strand, 'len': len}) as r from (
    select l_orderkey as ali, 's' || l_linenumber as species, 'c' || (l_orderkey // 500) as seq, case when l_partkey % 11 = 0 then '-' else '+' end as strand,
      l_orderkey * 60 + l_suppkey % 20 as s, l_orderkey * 60 + l_suppkey % 20 + l_quantity::bigint as e, l_quantity::bigint // 2 + 1 as len from lineitem) group by ali, species))"""


@query(
    "alignment_edges",
    f"""with {ROWS}, near as (
      select distinct u, v from (select ali as u, lead(ali) over (partition by species, seq, strand order by s, e, ali) as v from ali_rows) where v is not null and u <> v
    ), met as (
      select u, v, a.seq = b.seq and a.strand = b.strand and b.s - a.e - 1 between 0 and 400 as fits from near join ali_rows a on a.ali = u join ali_rows b on b.ali = v and a.species = b.species)
    select u, v from met group by u, v having count(*) filter (where not fits) <= floor(0.4 * count(*) + 1e-9)""",
)
def alignment_edges(spark, sf_dir):
    """Alignments that may follow each other, over all species."""
    return R.alignment_edges(alignment_rows(spark, sf_dir), 400, 0.6)


@query("gene_ranges")
def gene_ranges(spark, sf_dir):
    """Ranges of the heaviest paths under the signatures with the most bases, ends that better paths have cut off."""
    return R.gene_ranges(alignment_rows(spark, sf_dir), 400, 0.6, most=10, mean_bases=1 << 40)


@query("thinned_ranges")
def thinned_ranges(spark, sf_dir):
    """Orders' ranges at suppliers that are left when depths over three cost a fifth of an uncovered base."""
    iv = intervals(spark, sf_dir)
    rows = iv.select((F.floor(F.col("id") / 10) * 8 + F.floor(F.col("start") / 365)).alias("path"), F.concat("src", F.floor(F.col("start") / 365).cast("string")).alias("species"), F.col("seq").cast("string").alias("seq"), "start", "end")
    return R.thinned_ranges(rows, width=64)


@query("capped_alignments")
def capped_alignments(spark, sf_dir):
    """Alignments of a supplier's lines by year, a fragment a line, in pieces of 300 bases at most."""
    iv = intervals(spark, sf_dir).where("strand <> '.'").groupBy("seq", "strand", "start").agg(F.max("end").alias("end"))
    # a fragment ends where the next begins
    from pyspark.sql import Window

    by = Window.partitionBy("seq", "strand", F.floor(F.col("start") / 365)).orderBy("start")
    size = F.least(F.col("end") - F.col("start") + 1, F.coalesce(F.lead("start").over(by) - F.col("start"), F.lit(50)))
    rows = iv.withColumn("len", size).select((F.col("seq") * 10 + F.floor(F.col("start") / 365)).alias("ali"), F.col("strand").alias("species"), F.col("seq").cast("string").alias("seq"), "strand", (F.col("start") * 2).alias("chr_pos"), F.col("start").alias("ali_pos"), "len")
    return R.capped_alignments(rows, 300)


@query(
    "junction_to_genome",
    f"""with {IV}, reads as (
      select id, seq, priority as clip, e - s + 1 as a, mult as i, 10 as b, s % 60 + 1 as pos, 55 as flank, s * 3 + 1 as t_start, 100 + seq as intron from iv
    ), placed as (select *, flank - pos + 1 as before from reads)
    select id, seq::varchar as seq, t_start + pos - 1 as pos,
      clip || 'S' || case when before < a then before || 'M' || intron || 'N' || (a - before) || 'M' || i || 'I' || b || 'M'
        when before = a then a || 'M' || i || 'I' || intron || 'N' || b || 'M' else a || 'M' || i || 'I' || (before - a) || 'M' || intron || 'N' || (a + b - before) || 'M' end as cigar
    from placed where before > 0 and before < a + b""",
)
def junction_to_genome(spark, sf_dir):
    """Reads with a clip and an insertion, from junction fragments onto the genome."""
    iv = intervals(spark, sf_dir)
    s = lambda c: F.col(c).cast("string")
    # two matches beside each other, which come back as one
    cigar = F.concat(s("priority"), F.lit("S"), (F.col("end") - F.col("start") + 1).cast("string"), F.lit("M0D"), s("mult"), F.lit("I4M6M"))
    name = F.concat_ws(":", s("id"), s("seq"), s("start"))
    sam = iv.select("id", name.alias("rname"), (F.col("start") % 60 + 1).alias("pos"), cigar.alias("cigar"))
    fragments = iv.select(name.alias("junction"), s("seq").alias("seq"), (F.col("start") * 3 + 1).alias("start"), F.lit(55).cast("long").alias("flank"), (F.col("seq") + 100).alias("intron")).distinct()
    return J.junctions_on_genome(sam, fragments).select("id", F.col("rname").alias("seq"), "pos", "cigar")


@query(
    "splice_candidates",
    f"""with {SEQ}, n as (select seq, lower(bases) as bases, length(bases) as n from sequences),
    steps as (select seq, k, k * 150 + 1 as s, k * 150 + 150 as e, (seq * 7 + k * 3) % 5 + 1 as value, substr('+-.', ((seq + k) % 3 + 1)::int, 1) as strand from (select seq, unnest(range(0, n // 150)) as k from n)),
    jumps as (select a.seq, a.k, a.s, a.e, b.s as s2, a.strand as x, b.strand as y from steps a join steps b on a.seq = b.seq and b.k = a.k + 1
      where (b.value >= a.value * 2.0 or a.value / 2.0 < b.value) and (a.strand = b.strand or a.strand = '.' or b.strand = '.')),
    spots as (select seq, i, substr(bases, i::int, 2) as m from (select seq, bases, unnest(range(1, n)) as i from n)),
    m as (select seq, i as pos, true as opening, '+' as sign from spots where m = 'ct' union all select seq, i + 1, false, '+' from spots where m = 'ag'
      union all select seq, i + 1, true, '-' from spots where m = 'ag' union all select seq, i, false, '-' from spots where m = 'ct')
    select j.seq, j.k, o.sign, count(*) as n, min(o.pos) as first, max(c.pos) as last, min(case when x = y then x else '.' end) as strand
    from jumps j join m o on o.seq = j.seq and o.opening and o.pos between s - 10 and e + 10 and (o.sign in (x, y) or (x = '.' and y = '.'))
      join m c on c.seq = j.seq and not c.opening and c.sign = o.sign and c.pos between s2 - 10 and s2 + 10 and c.pos - o.pos between 0 and 120 group by j.seq, j.k, o.sign""",
)
def splice_candidates(spark, sf_dir):
    """Introns between motifs around neighbouring steps of coverage, counted by pair of steps and strand of the motifs."""
    from ..operators.signals import coverage_jumps

    seqs = sequences(spark, sf_dir).withColumn("n", F.length("bases"))
    steps = seqs.select("seq", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 150).cast("int"))).alias("k"), "n").where("k < floor(n / 150)")
    steps = steps.select("seq", "k", (F.col("k") * 150 + 1).cast("long").alias("start"), (F.col("k") * 150 + 150).cast("long").alias("end"), ((F.col("seq") * 7 + F.col("k") * 3) % 5 + 1).alias("value"))
    strand = lambda k: F.substring(F.lit("+-."), (F.col("seq") + k) % 3 + 1, F.lit(1))
    jumps = coverage_jumps(steps, 2.0, 200).withColumn("k", F.floor((F.col("start") - 1) / 150))
    jumps = jumps.withColumns({"spot": F.col("seq") * 100_000 + F.col("k"), "strand": strand(F.col("k")), "strand_next": strand(F.col("k") + 1)})
    # "ct" opens forward introns and closes reverse ones, "ag" the other way round; forward introns begin with the first base
    # of a motif and end with the last of the other
    places = J.motif_places(seqs.select("seq", F.lower("bases").alias("bases")), ("ct", "ag"))
    is_ct = F.col("motif") == 0
    at = F.when(is_ct, F.col("pos")).otherwise(F.col("pos") + 1)
    role = lambda sign: F.struct((is_ct == (F.lit(sign) == "+")).alias("opening"), F.lit(sign).alias("strand"))
    motifs = places.select("seq", at.alias("pos"), F.explode(F.array(role("+"), role("-"))).alias("r")).select("seq", "pos", "r.opening", "r.strand")
    found = J.splice_candidates(jumps, motifs, 10, 120, width=256)
    return found.groupBy("seq", (F.col("spot") % 100_000).alias("k"), "sign").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("end").alias("last"), F.min("strand").alias("strand"))


@query("sampled_cds")
def sampled_cds(spark, sf_dir):
    """A coding sequence for each part, from a model that the part's name and size don't change."""
    rng = np.random.default_rng(7)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 90 + 10).alias("n_codons"))
    return X.sampled_cds(rows, rng.dirichlet(np.ones(4), (3, 4**3)))


@query(
    "ortho_features",
    f"""with {IV}, exons as (
      select seq, s, e, case strand when '-' then '-' else '+' end as strand, mult % 3 as frame, score, 'cons=' || (id % 10) / 10.0 || ';n=' || priority || ';PMomega=' || (id % 7) / 4.0 || ';' as attributes, priority as n, (id % 10) / 10.0 as cons, (id % 7) / 4.0 as omega
      from iv where src = 'O'
    ), best as (
      select seq, s, e, strand, frame, min({{'n': -n, 'attributes': attributes, 'cons': cons, 'omega': omega}}) as b, count(*) as copies from exons group by all having true
    ), ref as (
      select distinct seq, s, e, case strand when '-' then '-' else '+' end as strand, mult % 3 as frame from iv where src = 'F'
    ), met as (
      select x.seq, x.s, x.e, x.strand, x.frame, r.s as rs, r.e as re,
        x.strand = r.strand and ((x.strand = '+' and (x.frame - r.frame + x.s - r.s) % 3 = 0) or (x.strand = '-' and (r.e - x.e + x.frame - r.frame) % 3 = 0)) as fits, r.frame as rf
      from best x join ref r on x.seq = r.seq and x.s <= r.e and r.s <= x.e
    ), found as (
      select seq, s, e, strand, frame, bool_or(fits and s = rs and e = re and frame = rf) as real, bool_or(fits) as half, max({{'same': fits and s = rs and e = re and frame = rf, 'rs': rs, 're': re}}) as ref from met group by seq, s, e, strand, frame
    )
    select seq, s as start_pos, e as end_pos, strand, frame, copies, e - s + 1 as length, (-b.n)::double as n, b.cons::double as cons, b.omega::double as omega, case when real then 1 when half then -1 else 0 end as class,
      case when ref is null then 0 when s = ref.rs then 1 when s < ref.rs then 2 else 3 end as left_code, case when ref is null then 0 when e = ref.re then 1 when e > ref.re then 2 else 3 end as right_code
    from best left join found using (seq, s, e, strand, frame)""".replace(" group by all having true", " group by seq, s, e, strand, frame"),
)
def ortho_features(spark, sf_dir):
    """Lines of open orders as exons with features, against those of filled ones."""
    iv = intervals(spark, sf_dir).withColumns({"strand": F.when(F.col("strand") == "-", "-").otherwise("+"), "frame": F.col("mult") % 3})
    text = lambda c: c.cast("string")
    attributes = F.concat(F.lit("cons="), text((F.col("id") % 10) / 10), F.lit(";n="), text(F.col("priority")), F.lit(";PMomega="), text((F.col("id") % 7) / 4), F.lit(";"))
    exons = iv.where("src = 'O'").select("seq", "start", "end", "strand", "frame", "score", attributes.alias("attributes"))
    rows = O.feature_table(exons, iv.where("src = 'F'"), width=64)
    return rows.select("seq", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "strand", "frame", "copies", "length", "n", "cons", F.col("PMomega").alias("omega"), "class", "left_code", "right_code")


@query("codon_class_ratios")
def codon_class_ratios(spark, sf_dir):
    """Log ratios of two fitted classes of codon columns, summed over each block; blocks of even numbers teach one class."""
    from ..tables import written
    from .model_queries import TREE, codon_columns

    columns = written(codon_columns(spark, sf_dir), "codon-columns")
    model = C.fitted_classes(columns.select("pattern", (F.col("exon") % 2 == 0).alias("coding")), TREE, omegas=(0.2, 1.0), paces=(1.0,))
    return C.exon_ratios(columns, TREE, model).select("exon", F.round("ratio", 4).alias("ratio"), "columns", "coding")
