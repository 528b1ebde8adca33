"""Gene structures and their evaluation over the driver's tables: orders are transcripts, lines their segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequence import translate
from ..operators import evaluation as V
from ..operators import genes as G
from ..operators.graphs import connected
from .registry import query
from .views import CHUNK, IV, WIDTH, intervals, sequences, table


def segments(spark, sf_dir):
    """``tid, seq, strand, type, start, end, frame, prob``."""
    iv = intervals(spark, sf_dir)
    return iv.select((F.col("id") / 10).cast("long").alias("tid"), "seq", "strand", F.when(F.col("priority") % 3 == 0, "UTR").otherwise("CDS").alias("type"), "start", "end", (F.col("start") % 3).cast("int").alias("frame"), ((F.col("id") % 97 + 1) / 100.0).alias("prob"), "mult", "id")


SEGS = f"{IV}, segs as (select id // 10 as tid, seq, strand, case when priority % 3 = 0 then 'UTR' else 'CDS' end as type, s, e, (s % 3)::int as frame, (id % 97 + 1) / 100.0 as prob, mult, id from iv)"
#: Truth and prediction: exons of even and odd orders, the odd ones' starts moved a little.
EXONS = f"{SEGS}, truth as (select seq, strand, s, e from segs where tid % 2 = 0), pred as (select id, seq, strand, s, e from segs where tid % 2 = 1)"


def truth_and_prediction(spark, sf_dir):
    s = segments(spark, sf_dir)
    return s.where("tid % 2 = 0").select("seq", "strand", "start", "end"), s.where("tid % 2 = 1").select("id", "seq", "strand", "start", "end")


@query("exon_class_eval", f"""with {EXONS}, best as (select p.seq, p.strand, p.s, p.e, max(case when t.s = p.s and t.e = p.e then 4 when abs(t.s - p.s) <= 20 and abs(t.e - p.e) <= 20 then 3 when t.s = p.s or t.e = p.e then 2 when p.s <= t.e and t.s <= p.e then 1 else 0 end) as class
  from pred p join truth t on p.seq = t.seq and p.strand = t.strand group by all)
select coalesce(class, 0) as class, count(*) as n from pred left join best using (seq, strand, s, e) group by 1""")
def exon_class_eval(spark, sf_dir):
    truth, pred = truth_and_prediction(spark, sf_dir)
    return V.exon_classes(pred, truth, width=WIDTH).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("exon_class_missed", f"""with {EXONS}, best as (select t.seq, t.strand, t.s, t.e, max(case when t.s = p.s and t.e = p.e then 4 when abs(t.s - p.s) <= 20 and abs(t.e - p.e) <= 20 then 3 when t.s = p.s or t.e = p.e then 2 when p.s <= t.e and t.s <= p.e then 1 else 0 end) as class
  from truth t join pred p on p.seq = t.seq and p.strand = t.strand group by all)
select coalesce(class, 0) as class, count(*) as n from truth left join best using (seq, strand, s, e) group by 1""")
def exon_class_missed(spark, sf_dir):
    """The annotated side: classes below 4 are false negatives."""
    truth, pred = truth_and_prediction(spark, sf_dir)
    return V.exon_classes(truth, pred, width=WIDTH).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("nucleotide_eval", f"""with {EXONS}, p as (select distinct seq, strand, unnest(range(s, e + 1)) as pos from pred), t as (select distinct seq, strand, unnest(range(s, e + 1)) as pos from truth)
select seq, strand, count(*) filter (where p.pos is not null and t.pos is not null) as tp, count(*) filter (where t.pos is null) as fp, count(*) filter (where p.pos is null) as fn
from p full join t using (seq, strand, pos) group by seq, strand""")
def nucleotide_eval(spark, sf_dir):
    truth, pred = truth_and_prediction(spark, sf_dir)
    return V.base_counts(pred, truth, WIDTH, CHUNK)


@query("exon_eval", f"""with {EXONS}, p as (select distinct seq, strand, s, e, 1 as a from pred), t as (select distinct seq, strand, s, e, 1 as b from truth), c as (
  select count(*) filter (where a = 1 and b = 1) as tp, count(*) filter (where b is null) as fp, count(*) filter (where a is null) as fn from p full join t using (seq, strand, s, e))
select tp, fp, fn, round(tp / (tp + fn)::double, 9) as sensitivity, round(tp / (tp + fp)::double, 9) as specificity, round(2.0 * tp / (2 * tp + fp + fn), 9) as f_score from c""")
def exon_eval(spark, sf_dir):
    truth, pred = truth_and_prediction(spark, sf_dir)
    got = V.rates(V.exon_counts(pred, truth))
    return got.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("sensitivity", "specificity", "f_score")])


_CHAINS = f"{SEGS}, chains as (select tid, seq::varchar || '|' || strand || '|' || string_agg(s || '-' || e, ',' order by s, e) as chain from segs where type = 'CDS' group by tid, seq, strand)"


@query("chain_eval", f"""with {_CHAINS}, p as (select chain, bool_or(tid % 5 <> 0) as complete from chains where tid % 2 = 1 group by chain), t as (select distinct chain, 1 as a from chains where tid % 2 = 0)
select count(*) filter (where complete and a = 1) as tp, count(*) filter (where complete is not null) as predicted, count(*) filter (where a = 1) as annotated from p full join t using (chain)""")
def chain_eval(spark, sf_dir):
    chains = G.chain(segments(spark, sf_dir))
    return V.chain_counts(chains.where("tid % 2 = 1").withColumn("complete", F.col("tid") % 5 != 0), chains.where("tid % 2 = 0"))


@query("transcript_chains", f"with {_CHAINS} select tid, chain from chains")
def transcript_chains(spark, sf_dir):
    return G.chain(segments(spark, sf_dir))


@query("capped_median_distance", f"""with {IV}, d as (select src, least(abs(e - s) * priority, 60) as d from iv), c as (select src, d, count(*) as c from d group by src, d),
r as (select *, sum(c) over (partition by src order by d) as cum, sum(c) over (partition by src) as n from c)
select src, max(n)::bigint as n, round(sum(c * d) / max(n)::double, 9) as mean, min(d) filter (where 2 * cum >= n) as median from r group by src""")
def capped_median_distance(spark, sf_dir):
    iv = intervals(spark, sf_dir).withColumn("distance", F.abs(F.col("end") - F.col("start")) * F.col("priority"))
    return V.capped_distances(iv, ["src"], 60).withColumn("mean", F.round("mean", 9))


@query("boundary_distances", f"""with {IV}, b as (select id, seq, strand, s as cds_end, e as utr_end from iv) select p.id, abs(p.utr_end - a.utr_end) as distance from b p join b a on p.seq = a.seq and p.strand = a.strand and p.cds_end = a.cds_end where p.id % 2 = 1 and a.id % 2 = 0""")
def boundary_distances(spark, sf_dir):
    b = intervals(spark, sf_dir).select("id", "seq", "strand", F.col("start").alias("cds_end"), F.col("end").alias("utr_end"))
    return V.boundary_distances(b.where("id % 2 = 1"), b.where("id % 2 = 0").drop("id")).select("id", "distance")


@query("segment_posterior", f"""with {SEGS}, x as (select seq, tid % 10 as sample, strand, type, s, e from segs), n as (select seq, count(distinct sample) as n from x group by seq)
select seq, strand, type, s as start, e as "end", count(distinct sample) as count, round(count(distinct sample) / max(n)::double, 9) as posterior from x join n using (seq) group by seq, strand, type, s, e""")
def segment_posterior(spark, sf_dir):
    x = segments(spark, sf_dir).withColumn("sample", F.col("tid") % 10)
    return G.segment_posteriors(x).withColumn("posterior", F.round("posterior", 9))


@query("transcript_posterior", f"""with {_CHAINS}, x as (select split_part(chain, '|', 1) as seq, chain, tid % 10 as sample from chains), n as (select seq, count(distinct sample) as n from x group by seq)
select seq, chain, count(distinct sample) as count, round(count(distinct sample) / max(n)::double, 9) as posterior from x join n using (seq) group by seq, chain""")
def transcript_posterior(spark, sf_dir):
    x = G.chain(segments(spark, sf_dir)).withColumns({"seq": F.split("chain", r"\|")[0], "sample": F.col("tid") % 10})
    return G.transcript_posteriors(x).withColumn("posterior", F.round("posterior", 9))


@query("geo_mean_prob", f"with {SEGS} select tid, round(exp(avg(ln(prob))), 9) as mean_prob from segs group by tid")
def geo_mean_prob(spark, sf_dir):
    return G.mean_probability(segments(spark, sf_dir)).withColumn("mean_prob", F.round("mean_prob", 9))


_TX = f"{SEGS}, tx as (select tid * 10000 + seq as tid, seq * 10 + min(s) // 400 as gid, seq, max(strand) as strand, min(s) as s, max(e) as e, sum(mult)::bigint as supported, round(avg(prob), 6) as mean_post, min(prob) as least_post, sum(e - s + 1)::bigint as coding_len from segs group by tid, seq)"


def transcripts(spark, sf_dir):
    s = segments(spark, sf_dir)
    return s.groupBy("tid", "seq").agg(F.max("strand").alias("strand"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("mult").cast("long").alias("supported"), F.round(F.avg("prob"), 6).alias("mean_post"), F.min("prob").alias("least_post"), F.sum(F.col("end") - F.col("start") + 1).cast("long").alias("coding_len")).withColumns({"gid": F.col("seq") * 10 + F.floor(F.col("start") / 400), "tid": F.col("tid") * 10000 + F.col("seq")})


@query("topk_by_support", f"with {_TX} select gid, tid, rank from (select *, row_number() over (partition by gid order by supported desc, mean_post desc, tid) as rank from tx) where rank <= 3")
def topk_by_support(spark, sf_dir):
    return G.top_transcripts(transcripts(spark, sf_dir), 3).select("gid", "tid", F.col("rank").cast("long").alias("rank"))


@query("kept_transcripts", f"with {_TX} select tid, coding_len from tx where coding_len >= 40 and coding_len % 11 <> 0 and ((mean_post >= 0.4 and least_post >= 0.1) or tid % 7 = 0)")
def kept_transcripts(spark, sf_dir):
    t = transcripts(spark, sf_dir).withColumns({"inframe_stop": F.col("coding_len") % 11 == 0, "decoded": F.col("tid") % 7 == 0})
    return G.kept_transcripts(t, 40, 0.4, 0.1).select("tid", "coding_len")


@query("undominated", f"""with {_TX}, t as (select *, (s % 50)::varchar as chain from tx)
select tid, gid from t a where not exists (select 1 from t b where a.gid = b.gid and a.tid <> b.tid and (a.supported < 0.94 * b.supported or (a.chain = b.chain and (b.supported > a.supported or (b.supported = a.supported and (b.mean_post > a.mean_post or (b.mean_post = a.mean_post and b.tid < a.tid)))))))""")
def undominated(spark, sf_dir):
    t = transcripts(spark, sf_dir).withColumn("chain", (F.col("start") % 50).cast("string"))
    return G.undominated(t).select("tid", "gid")


@query("set_compare", f"""with {SEGS}, t as (select id, seq, strand, s, e, seq || '|' || strand || '|' || s || '-' || e as chain from segs), l as (select * from t where id % 2 = 0), r as (select * from t where id % 2 = 1),
c as (select 'left' as side, case when exists (select 1 from r where r.chain = l.chain) then 'equal' when exists (select 1 from r where r.seq = l.seq and r.strand = l.strand and r.s <= l.e and l.s <= r.e) then 'alternative' else 'unequal' end as class from l
  union all select 'right', case when exists (select 1 from l where r.chain = l.chain) then 'equal' when exists (select 1 from l where r.seq = l.seq and r.strand = l.strand and r.s <= l.e and l.s <= r.e) then 'alternative' else 'unequal' end from r)
select side, class, count(*) as n from c group by side, class""")
def set_compare(spark, sf_dir):
    s = segments(spark, sf_dir)
    t = s.select("id", F.concat_ws("|", *[F.col(c).cast("string") for c in ("id", "seq", "strand", "start", "end")]).alias("tid"), "seq", "strand", "start", "end", F.concat_ws("|", F.col("seq").cast("string"), "strand", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))).alias("chain"))
    return G.set_compare(t.where("id % 2 = 0"), t.where("id % 2 = 1"), WIDTH).groupBy("side", "class").agg(F.count(F.lit(1)).alias("n"))


@query("quality_rank", f"""with {_TX} select tid, row_number() over (partition by seq, strand, gid order by (tid % 3 > 0)::int + (tid % 2)::int desc, (tid % 5 = 0)::int, supported desc, mean_post desc, tid) as quality_rank from tx""")
def quality_rank(spark, sf_dir):
    t = transcripts(spark, sf_dir).select("tid", "seq", "strand", F.col("gid").alias("cluster"), (F.col("tid") % 3 > 0).alias("start_complete"), (F.col("tid") % 2 == 1).alias("end_complete"), (F.col("tid") % 5 == 0).alias("boundary_problem"), F.col("supported").alias("priority"), F.col("mean_post").alias("score"))
    return G.quality_ranked(t).select("tid", F.col("quality_rank").cast("long").alias("quality_rank"))


@query("geneset_clusters", f"""with {_TX}, flagged as (select *, case when s < max(e) over (partition by seq order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from tx),
numbered as (select *, sum(fresh) over (partition by seq order by s, e, fresh desc rows unbounded preceding) as cluster from flagged)
select seq, cluster::bigint as cluster, count(*) as n from numbered group by seq, cluster""")
def geneset_clusters(spark, sf_dir):
    return G.overlap_clusters(transcripts(spark, sf_dir), CHUNK).groupBy("seq", F.col("cluster").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("geneset_slack_clusters", f"""with recursive {_TX}, flagged as (select *, tid % 3 = 0 as open, case when s < max(e) over (partition by seq order by s, e, (tid % 3 <> 0)::int, tid rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from tx),
numbered as (select *, sum(fresh) over (partition by seq order by s, e, (not open)::int, tid rows unbounded preceding) as unit from flagged),
units as (select seq, unit, min(s) as s, max(e) as e, count(*) as n, arg_min(open, (s, e, (not open)::int)) as open from numbered group by seq, unit),
linked as (select *, coalesce(open and s < lag(e) over (partition by seq order by unit) + 40, false) as link from units),
walk as (
  select seq, unit, unit as cluster, n as size, n from linked where unit = 1
  union all
  select l.seq, l.unit, case when l.link and w.size < 8 then w.cluster else l.unit end, case when l.link and w.size < 8 then w.size + l.n else l.n end, l.n from walk w join linked l on l.seq = w.seq and l.unit = w.unit + 1
)
select seq, cluster::bigint as cluster, sum(n)::bigint as n from walk group by seq, cluster""")
def geneset_slack_clusters(spark, sf_dir):
    """Clusters in which an incomplete left end reaches further, sparse sequences first of all."""
    t = transcripts(spark, sf_dir).withColumn("left_open", F.col("tid") % 3 == 0)
    return G.overlap_clusters(t, CHUNK, slack=40, small=8).groupBy("seq", F.col("cluster").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("gene_clusters")
def gene_clusters(spark, sf_dir):
    s = segments(spark, sf_dir).where("type = 'CDS'").select("tid", "seq", "strand", "start", "end", "frame")
    return G.gene_clusters(s, CHUNK)


@query("components")
def components(spark, sf_dir):
    """Customers linked by a rule over all orders; the recursive SQL takes too long on whole tables."""
    o = table(spark, sf_dir, "orders")
    other = (F.col("o_custkey") * 7 + F.col("o_orderkey") % 3) % 100000
    return connected(o.select(F.col("o_custkey").alias("u"), other.alias("v")).distinct(), o.select(F.col("o_custkey").alias("node")).union(o.select(other.alias("node"))))


@query("limited_tracks")
def limited_tracks(spark, sf_dir):
    t = transcripts(spark, sf_dir).select("tid", "seq", "start", "end", F.col("mean_post").alias("post"))
    return G.limited_tracks(t, 2)


@query("geneset_selection")
def geneset_selection(spark, sf_dir):
    """Transcripts chosen from overlap clusters, which hold several genes; equal chains are those of one place."""
    t = G.overlap_clusters(transcripts(spark, sf_dir), CHUNK)
    t = t.select("tid", "seq", "strand", "start", "end", "cluster", "gid", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")).alias("chain"), (F.col("tid") % 3 > 0).alias("start_complete"), (F.col("tid") % 2 == 1).alias("end_complete"), (F.col("tid") % 5 == 0).alias("boundary_problem"), F.col("supported").alias("priority"), F.col("mean_post").alias("score"))
    return G.selected(t).select("tid", "quality_rank")


@query("combined_transcripts", f"""with {SEGS}, p as (select id as tid, seq, strand, s, e, id % 3 > 0 as l, id % 2 = 1 as r from segs), a as (select * from p where l and not r), b as (select * from p where r and not l)
select a.tid as left_tid, b.tid as right_tid, a.s as start, b.e as "end" from a join b on a.seq = b.seq and a.strand = b.strand and a.s = b.s and a.e = b.e""")
def combined_transcripts(spark, sf_dir):
    s = segments(spark, sf_dir)
    p = s.select(F.col("id").alias("tid"), "seq", "strand", "start", "end", (F.col("id") % 3 > 0).alias("left_complete"), (F.col("id") % 2 == 1).alias("right_complete"), F.concat_ws("|", F.col("seq").cast("string"), "strand", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))).alias("chain"))
    return G.combined_transcripts(p).select("left_tid", "right_tid", "start", "end")


@query("sanity_checks", f"""with {SEGS}, g as (select *, s - lag(e) over (partition by tid, type order by s, e) - 1 as gap from segs)
select tid, min(gap) < 0 as overlapping_exons, count(distinct strand) > 1 as mixed_strand, count(distinct seq) > 1 as mixed_seq, sum(case when type = 'CDS' then e - s + 1 else 0 end) % 3 <> 0 as coding_not_3n, min(gap) filter (where gap >= 0) < 4 as tiny_gap from g group by tid""")
def sanity_checks(spark, sf_dir):
    return G.sanity(segments(spark, sf_dir))


@query("single_exon", f"with {SEGS} select tid from segs where type = 'CDS' group by tid having count(*) = 1")
def single_exon(spark, sf_dir):
    return G.single_exon(segments(spark, sf_dir))


@query("flank_value", f"with {SEGS}, l as (select max(e) - min(s) + 1 as len from segs group by tid) select round(avg(len), 9) as avg_len, least(floor(avg(len) / 2), 10000)::bigint as flank from l")
def flank_value(spark, sf_dir):
    return G.flank(segments(spark, sf_dir)).withColumn("avg_len", F.round("avg_len", 9))


@query("segment_support", f"""with {SEGS}, h as (select seq, strand, type || 'part' as type, s + 1 as s, e - 1 as e, mult from segs where tid % 3 = 0 and e - s >= 2), one as (select distinct seq, strand, type, s, e from segs where tid % 3 > 0),
sums as (select o.seq, o.strand, o.type, o.s, o.e, sum(mult)::bigint as support from one o join h on h.seq = o.seq and (h.strand = '.' or h.strand = o.strand) and h.type = o.type || 'part' and h.s >= o.s and h.e <= o.e group by all)
select tid, sum(coalesce(support, 0))::bigint as support from segs left join sums using (seq, strand, type, s, e) where tid % 3 > 0 group by tid""")
def segment_support(spark, sf_dir):
    s = segments(spark, sf_dir)
    hints = s.where("tid % 3 = 0 and end - start >= 2").select("seq", "strand", F.concat("type", F.lit("part")).alias("type"), (F.col("start") + 1).alias("start"), (F.col("end") - 1).alias("end"), "mult")
    return G.support(s.where("tid % 3 > 0"), hints, WIDTH).groupBy("tid").agg(F.sum("support").cast("long").alias("support"))


@query("pair_cooccurrence", "select a.l_suppkey as a, b.l_suppkey as b, count(distinct a.l_orderkey) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey group by 1, 2 having count(distinct a.l_orderkey) >= 20")
def pair_cooccurrence(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_suppkey").alias("item"))
    return G.cooccurrence(t, 20)


@query("capped_union")
def capped_union(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("item"))
    return G.capped_union(G.cooccurrence(t), 20)


@query("majority_vote", "with best as (select o_custkey, max(struct_pack(p := o_totalprice, c := o_orderpriority)) as b from orders group by o_custkey) select b.c as choice, count(*) as votes from best group by 1 order by votes desc, choice limit 1")
def majority_vote(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderpriority").alias("choice"), F.col("o_totalprice").alias("score"))
    return G.majority(o)


@query("source_accuracy", f"""with {SEGS}, f as (select distinct seq, type, s, e from segs where tid % 2 = 0)
select h.strand as esource, h.type, count(*) filter (where f.seq is not null) as correct, count(*) filter (where f.seq is null) as wrong from (select * from segs where tid % 2 = 1) h left join f using (seq, type, s, e) group by all""")
def source_accuracy(spark, sf_dir):
    s = segments(spark, sf_dir)
    return V.source_accuracy(s.where("tid % 2 = 1").withColumn("esource", F.col("strand")), s.where("tid % 2 = 0"))


@query("cluster_chunks", "with c as (select l_suppkey as cluster, count(*) as n from lineitem group by 1) select cluster, n, ((sum(n) over (order by cluster) - n) // 5000)::bigint as chunk from c")
def cluster_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return G.packed_chunks(c, 5000)


@query("identity_dedup")
def identity_dedup(spark, sf_dir):
    """Translated sequences that no later one is like, at 90 % identity of the shorter."""
    from ..operators.proteins import nonredundant

    # one file may be one task, and translation is what costs
    proteins = sequences(spark, sf_dir).repartition("seq").select(F.col("seq").alias("id"), translate(F.upper("bases")).alias("seq"))
    return nonredundant(proteins, 0.9).select("id", F.length("seq").alias("length"))


@query("complete_in_region", f"""with {_TX}, r as (select s_suppkey as seq, 800 as lo, 2400 as hi from supplier) select tid from tx where exists (select 1 from r where r.seq = tx.seq and lo <= s and e <= hi)""")
def complete_in_region(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.lit(800).cast("long").alias("start"), F.lit(2400).cast("long").alias("end"))
    return G.within(transcripts(spark, sf_dir), r).select("tid")


@query("outside_regions", f"""with {_TX}, r as (select s_suppkey as seq, 800 as lo, 2400 as hi from supplier) select tid from tx where not exists (select 1 from r where r.seq = tx.seq and lo <= e and s <= hi)""")
def outside_regions(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.lit(800).cast("long").alias("start"), F.lit(2400).cast("long").alias("end"))
    return G.within(transcripts(spark, sf_dir), r, False).select("tid")


@query("unique_peptides", """with p as (select o_custkey::varchar as peptide, o_orderpriority as header, o_orderkey as ord from orders), f as (select peptide, arg_min(header, ord) as header from p group by peptide)
select peptide, header, count(*) as mult from p join f using (peptide, header) group by all""")
def unique_peptides(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return G.unique_peptides(o.select(F.col("o_custkey").cast("string").alias("peptide"), F.col("o_orderpriority").alias("header"), F.col("o_orderkey").alias("ord")))
