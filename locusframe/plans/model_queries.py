"""Alignment columns, phylogeny, decoding and training over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import decode as D
from ..operators import msa as M
from ..operators import phylo as P
from ..operators import training as T
from ..operators.sequences import chunked
from ..sources.readers import parse_newick
from .registry import query
from .views import IV, SEQ, intervals, sequences, table

TREE = parse_newick("((a:0.2,b:0.3):0.1,(c:0.15,d:0.4):0.2);")


def alignment(spark, sf_dir):
    """Four documents are the rows of a block, padded to the longest; c's become gaps."""
    from pyspark.sql import Window

    wide = F.max(F.length("bases")).over(Window.partitionBy(F.floor(F.col("seq") / 4)))
    rows = sequences(spark, sf_dir).withColumn("wide", wide).where("wide > 0")
    return rows.select(
        F.floor(F.col("seq") / 4).alias("block"), F.element_at(F.array(*[F.lit(x) for x in "abcd"]), (F.col("seq") % 4 + 1).cast("int")).alias("species"), F.col("seq").cast("string").alias("seq"), (F.col("seq") * 10).alias("start"),
        F.lit(100).cast("long").alias("size"), F.when(F.col("seq") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(20000).cast("long").alias("src_size"), F.translate(F.expr("rpad(bases, wide, '-')"), "c", "-").alias("text"),
    )


ALN = f"{SEQ}, aln as (select seq // 4 as block, (array['a','b','c','d'])[seq % 4 + 1] as species, translate(rpad(bases, wide::int, '-'), 'c', '-') as text, seq, seq * 10 as start, case seq % 2 when 0 then '+' else '-' end as strand from (select *, max(length(bases)) over (partition by seq // 4) as wide from sequences) where wide > 0), cells as (select block, species, i - 1 as i, substring(text, i::int, 1) as c from (select *, unnest(range(1, length(text) + 1)) as i from aln))"


@query("column_conservation", f"""with {ALN}, c as (select block, i, upper(c) as c, count(*) as n from cells where upper(c) in ('A', 'C', 'G', 'T') group by all), t as (select block, i, sum(n) as t, sum(n * log2(n)) as s from c group by block, i)
select block, i::int as i, round((1 - (log2(t) - s / t) / 2) * t / 4, 9) as score from t""")
def column_conservation(spark, sf_dir):
    return M.conservation(alignment(spark, sf_dir), 4).withColumn("score", F.round("score", 9))


@query("gap_columns_removed", f"""with {ALN}, keep as (select distinct block, i from cells where c <> '-')
select a.block, a.species, string_agg(c, '' order by i) as text from cells a join keep using (block, i) group by all""")
def gap_columns_removed(spark, sf_dir):
    return M.without_gap_columns(alignment(spark, sf_dir)).select("block", "species", "text")


@query("alignment_filter", f"""with {ALN}, sub as (select *, case strand when '-' then 20000 - start - 100 else start end as lo from aln where species in ('a', 'b', 'd')), big as (select block from sub group by block having count(*) >= 3),
hit as (select distinct block from sub where species = 'a' and lo < 6000 and 1000 < lo + 100 and seq % 8 = 0)
select block, species from sub where block in (select block from big) and block in (select block from hit)""")
def alignment_filter(spark, sf_dir):
    aln = alignment(spark, sf_dir)
    regions = aln.where("species = 'a' and cast(seq as bigint) % 8 = 0").select("species", "seq", F.lit(1000).cast("long").alias("lo"), F.lit(6000).cast("long").alias("hi"))
    return M.filtered(aln, ["a", "b", "d"], 3, regions).select("block", "species")


@query("ortho_tuples", f"""with {IV}, c as (select seq % 4 as species, s * 100 + (e - s) as akey, id as cid from iv), k as (select akey, count(distinct species) as n, count(*) as a from c group by akey)
select akey, n from k where n >= 2 and n = a""")
def ortho_tuples(spark, sf_dir):
    c = intervals(spark, sf_dir).select((F.col("seq") % 4).alias("species"), (F.col("start") * 100 + F.col("end") - F.col("start")).alias("akey"), F.col("id").alias("cid"))
    return M.ortho_tuples(c).select("akey", "n")


def codon_columns(spark, sf_dir):
    """``exon, pattern``: codons of the four rows at each third column."""
    rows = alignment(spark, sf_dir).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("species", F.upper(F.translate("text", "-", "A"))))).alias("m"))
    # rows meet as texts, and are cut into columns where they are
    codons = [F.coalesce(F.regexp_extract_all(F.try_element_at("m", F.lit(x)), F.lit(".{3}"), F.lit(0)), F.array().cast("array<string>")).alias(x) for x in "abcd"]
    columns = rows.select(F.col("block").alias("exon"), F.posexplode(F.arrays_zip(*codons)).alias("i", "c"))
    pattern = F.concat_ws(",", *(F.coalesce(F.col(f"c.{x}"), F.lit("---")) for x in "abcd"))
    return columns.select("exon", "i", pattern.alias("pattern"))


@query("codon_omega")
def codon_omega(spark, sf_dir):
    return P.omega(codon_columns(spark, sf_dir), TREE).select("exon", F.round("omega", 4).alias("omega"), "columns", "changes")


MODEL = D.Model(["igenic", "gene"], np.log([0.9, 0.1]), np.array([[-np.inf, 0.0], [0.0, -np.inf]]), np.log([[0.25, 0.25, 0.25, 0.24, 0.01], [0.15, 0.35, 0.35, 0.14, 0.01]]), [float(np.log(0.99)), float(np.log(0.95))])


@query("decoded_segments")
def decoded_segments(spark, sf_dir):
    """Whole sequences in pieces of 4000 bases, so that no task holds more than a piece."""
    s = sequences(spark, sf_dir).select(F.col("seq").cast("string").alias("seq"), "bases")
    return D.decoded_in_pieces(chunked(s, 4000, 400), MODEL, 400, "igenic")


@query("accurate_paths")
def accurate_paths(spark, sf_dir):
    s = intervals(spark, sf_dir).select(F.concat("seq", "strand").alias("seq"), "start", "end", ((F.col("id") % 97 + 1) / 100.0).alias("posterior"))
    return D.accurate_paths(s)


@query("exon_candidates", f"""with {SEQ}, cod as (select seq, i, upper(substring(bases, i::int, 3)) as c from (select seq, bases, unnest(range(1, length(bases) - 1)) as i from sequences)),
o as (select seq, i + 2 as a from cod where c = 'AGA'), cl as (select seq, i - 1 as b from cod where c = 'GTA'), st as (select seq, i as p from cod where c in ('TAA', 'TAG', 'TGA')),
x as (select seq, a, b, f from o join cl using (seq), (values (0), (1), (2)) v(f) where b - a + 1 between 30 and 60)
select seq, a as start, b as "end", f as frame from x where not exists (select 1 from st where st.seq = x.seq and p >= a and p + 2 <= b and (p - a - f + 3) % 3 = 0)""")
def exon_candidates(spark, sf_dir):
    from ..functions.sequence import kmers

    c = sequences(spark, sf_dir).select("seq", F.posexplode(kmers(F.upper("bases"), 3)).alias("p", "c")).withColumn("p", F.col("p").cast("long") + 1)
    signals = c.where("c in ('AGA', 'GTA')").select("seq", F.when(F.col("c") == "AGA", F.col("p") + 2).otherwise(F.col("p") - 1).alias("pos"), F.when(F.col("c") == "AGA", "open").otherwise("close").alias("kind"), F.col("c").alias("name"), F.lit(1.0).alias("score"))
    stops = c.where("c in ('TAA', 'TAG', 'TGA')").select("seq", F.col("p").alias("pos"))
    return D.exon_candidates(signals, stops, 30, 60, 64).select("seq", "start", "end", "frame").distinct()


@query("fold_means")
def fold_means(spark, sf_dir):
    o = T.folds(table(spark, sf_dir, "orders"), 5, "o_orderkey", 3)
    scores = o.groupBy("o_orderpriority", "fold").agg(F.avg("o_totalprice").alias("score"))
    return T.best_parameters(scores, "o_orderpriority").select(F.col("o_orderpriority").alias("parameters"), "folds", F.round("mean", 6).alias("mean"))
