"""Interval algebra and signals over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import signals as G
from .registry import query
from .views import CHUNK, IV, REGIONS, SIGNAL, WIDTH, intervals, regions, signal

_SIGNED = "sum(mult)::bigint"


def _by_region(met):
    return met.groupBy("rid").agg(F.count(F.lit(1)).alias("hits"), F.sum("mult").cast("long").alias("mult"))


def _regions_right(spark, sf_dir):
    return regions(spark, sf_dir)


def _region_query(name: str, join, where: str) -> None:
    sql = f"with {IV}, {REGIONS} select rid, count(*) as hits, {_SIGNED} as mult from iv join regions using (seq) where {where} group by rid"

    @query(name, sql)
    def run(spark, sf_dir):
        return _by_region(join(intervals(spark, sf_dir), regions(spark, sf_dir), ("seq",), WIDTH).withColumnRenamed("rid_r", "rid"))


_region_query("region_overlap", I.overlap_join, "s <= re and rs <= e")
_region_query("region_contained", I.contained_join, "rs <= s and e <= re")
_region_query("region_end_in_range", I.ends_in, "e between rs and re and s <= re")
_region_query("region_start_in_range", I.starts_in, "s between rs and re")


@query("features_at_point", f"with {IV}, points as (select distinct seq, s as pos from iv where src = 'O') select p.seq, pos, count(*) as n from points p join iv on iv.seq = p.seq and pos between s and e group by p.seq, pos")
def features_at_point(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    points = iv.where("src = 'O'").select("seq", F.col("start").alias("pos")).distinct()
    return I.containing_points(points, iv, width=WIDTH).groupBy("seq", "pos").agg(F.count(F.lit(1)).alias("n"))


_MERGED = f"""with {IV}, flagged as (
  select seq, s, e, case when s <= max(e) over (partition by seq order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from iv
), numbered as (select *, sum(fresh) over (partition by seq order by s, e, fresh desc rows unbounded preceding) as island from flagged),
merged as (select seq, min(s) as s, max(e) as e, count(*) as n from numbered group by seq, island)"""


@query("interval_merge", f'{_MERGED} select seq, s as start, e as "end", n from merged')
def interval_merge(spark, sf_dir):
    return I.merged(intervals(spark, sf_dir), chunk=CHUNK)


@query("interval_merge_legacy", f"""with {IV}, one as (select distinct seq, s, e from iv), flagged as (
  select seq, s, e, case when max(e) over w is null or s >= max(e) over w or s <= max(s) over w then 1 else 0 end as fresh from one
  window w as (partition by seq order by s, e rows between unbounded preceding and 1 preceding)
), numbered as (select *, sum(fresh) over (partition by seq order by s, e rows unbounded preceding) as island from flagged)
select seq, min(s) as start, max(e) as "end" from numbered group by seq, island""")
def interval_merge_legacy(spark, sf_dir):
    return I.legacy_merge_pieces(intervals(spark, sf_dir), chunk=CHUNK)


@query("interval_gaps", f'{_MERGED} select * from (select seq, e + 1 as start, lead(s) over (partition by seq order by s) - 1 as "end" from merged) where "end" is not null and "end" >= start')
def interval_gaps(spark, sf_dir):
    return I.gaps(intervals(spark, sf_dir), chunk=CHUNK)


@query("interval_complement", f"""{_MERGED}, cut as (select seq, greatest(s, 0) as s, least(e, 4000) as e from merged where e >= 0 and s <= 4000
  union all select distinct seq, -1, -1 from iv union all select distinct seq, 4001, 4001 from iv)
select * from (select seq, e + 1 as start, lead(s) over (partition by seq order by s) - 1 as "end" from cut) where "end" >= start""")
def interval_complement(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    bounds = iv.select("seq").distinct().select("seq", F.lit(0).cast("long").alias("lo"), F.lit(4000).cast("long").alias("hi"))
    return I.complement(iv, bounds, chunk=CHUNK)


@query("overlap_cluster", f"""with {IV}, flagged as (
  select *, case when s <= max(e) over (partition by seq order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from iv
), numbered as (select *, sum(fresh) over (partition by seq order by s, e, fresh desc rows unbounded preceding) as cluster from flagged)
select seq, cluster::bigint as cluster, count(*) as n, max(e) - min(s) + 1 as span from numbered group by seq, cluster""")
def overlap_cluster(spark, sf_dir):
    got = I.clustered(intervals(spark, sf_dir), chunk=CHUNK)
    return got.groupBy("seq", F.col("cluster").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), (F.max("end") - F.min("start") + 1).alias("span"))


@query("coverage_steps", f"""with {IV}, events as (select seq, pos, sum(d) as d from (select seq, s as pos, 1 as d from iv union all select seq, e + 1, -1 from iv) group by seq, pos having sum(d) <> 0),
levels as (select seq, pos, sum(d) over (partition by seq order by pos) as cov, lead(pos) over (partition by seq order by pos) as nxt from events)
select seq, pos as start, nxt - 1 as "end", cov::bigint as cov from levels where cov > 0""")
def coverage_steps(spark, sf_dir):
    return I.coverage(intervals(spark, sf_dir), chunk=CHUNK)


@query("base_coverage", f"with {IV} select seq, pos, count(*) as cov from (select seq, unnest(range(s, e + 1)) as pos from iv) group by seq, pos")
def base_coverage(spark, sf_dir):
    return G.spread(I.coverage(intervals(spark, sf_dir), chunk=CHUNK).withColumnRenamed("cov", "value")).select("seq", "pos", F.col("value").alias("cov"))


@query("uncovered_bases", f"""{_MERGED}, {REGIONS}, sums as (select rid, sum(least(e, re) - greatest(s, rs) + 1)::bigint as covered from regions r join merged m on m.seq = r.seq and s <= re and rs <= e group by rid)
select rid, coalesce(covered, 0) as covered, re - rs + 1 - coalesce(covered, 0) as uncovered from regions left join sums using (rid)""")
def uncovered_bases(spark, sf_dir):
    return I.covered_bases(intervals(spark, sf_dir), regions(spark, sf_dir), width=WIDTH, chunk=CHUNK).select("rid", "covered", "uncovered")


@query("nested_removal", f"""with {IV}, one as (select distinct seq, strand, s, e from iv)
select seq, strand, s as start, e as "end" from one a where not exists (select 1 from one b where b.seq = a.seq and b.strand = a.strand and b.s <= a.s and a.e <= b.e and (b.s < a.s or a.e < b.e))""")
def nested_removal(spark, sf_dir):
    return I.without_nested(intervals(spark, sf_dir), chunk=CHUNK).select("seq", "strand", "start", "end")


@query("semi_overlap", f"with {IV}, a as (select * from iv where strand <> '-'), b as (select * from iv where strand <> '+') select id from a where exists (select 1 from b where a.seq = b.seq and a.s <= b.e and b.s <= a.e)")
def semi_overlap(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    return I.overlap_semi(iv.where("strand <> '-'"), iv.where("strand <> '+'"), width=WIDTH).select("id")


@query("anti_overlap", f"with {IV}, a as (select * from iv where strand <> '-'), b as (select * from iv where strand <> '+') select id from a where not exists (select 1 from b where a.seq = b.seq and a.s <= b.e and b.s <= a.e)")
def anti_overlap(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    return I.overlap_anti(iv.where("strand <> '-'"), iv.where("strand <> '+'"), width=WIDTH).select("id")


@query("asof_next_boundary", f"with {IV}, marks as (select distinct seq, e as mark from iv where src = 'O') select id, (select min(mark) from marks m where m.seq = iv.seq and mark > iv.s) as next_mark from iv")
def asof_next_boundary(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    points = iv.select("id", "seq", F.col("start").alias("pos"))
    return I.nearest_after(points, iv.where("src = 'O'").select("seq", F.col("end").alias("mark")), chunk=CHUNK).select("id", "next_mark")


@query("signal_window", f"with {IV}, {SIGNAL} select seq, pos, (sum(value) over (partition by seq order by pos range between 20 preceding and 20 following))::bigint as total from signal")
def signal_window(spark, sf_dir):
    return G.sliding_sum(signal(spark, sf_dir), 20, 20, out="total", block=CHUNK).select("seq", "pos", F.col("total").cast("long").alias("total"))


@query("window_identity", f"""with {IV}, cols as (select seq, s as col, case when s % 7 = 0 then null else s end as pos, (count(*) % 4)::bigint as same from iv group by seq, s)
select seq, pos, round(same_sum / (3.0 * 41), 9) as identity from (select *, sum(same) over (partition by seq order by col range between 20 preceding and 20 following) as same_sum from cols) where pos is not null""")
def window_identity(spark, sf_dir):
    cols = signal(spark, sf_dir).select("seq", F.col("pos").alias("col"), F.when(F.col("pos") % 7 != 0, F.col("pos")).alias("pos"), (F.col("value") % 4).alias("same"))
    return G.window_identity(cols, 4).select("seq", "pos", F.round("identity", 9).alias("identity"))


_ISLANDS = f"""with {IV}, {SIGNAL}, high as (select * from signal where value >= 2), flagged as (
  select *, case when pos <= lag(pos) over (partition by seq order by pos) + 11 then 0 else 1 end as fresh from high
), numbered as (select *, sum(fresh) over (partition by seq order by pos) as island from flagged),
islands as (select seq, min(pos) as s, max(pos) as e, count(*) as n, sum(value)::bigint as total from numbered group by seq, island)"""


@query("signal_islands", f'{_ISLANDS} select seq, s as start, e as "end", n, total from islands')
def signal_islands(spark, sf_dir):
    return G.islands(signal(spark, sf_dir), 2, 10, CHUNK).withColumn("total", F.col("total").cast("long"))


@query("best_island", f'{_ISLANDS} select seq, s as start, e as "end", total from (select *, row_number() over (partition by seq order by total desc, s) as r from islands) where r = 1')
def best_island(spark, sf_dir):
    return G.best_island(signal(spark, sf_dir), 2, 10).withColumn("total", F.col("total").cast("long"))


@query("run_lengths", f"""with {IV}, {SIGNAL}, flagged as (select *, case when pos = lag(pos) over (partition by seq, value order by pos) + 1 then 0 else 1 end as fresh from signal),
numbered as (select *, sum(fresh) over (partition by seq, value order by pos) as run from flagged)
select seq, min(pos) as start, max(pos) as "end", value from numbered group by seq, value, run""")
def run_lengths(spark, sf_dir):
    return G.run_lengths(signal(spark, sf_dir), CHUNK)


@query("island_hints", f"""with {IV}, dense as (select seq, pos, count(*)::bigint as value from (select seq, unnest(range(s, e + 1)) as pos from iv) group by seq, pos),
flagged as (select *, case when pos = lag(pos) over (partition by seq order by pos) + 1 then 0 else 1 end as fresh from dense where value >= 3),
numbered as (select *, sum(fresh) over (partition by seq order by pos) as island from flagged),
islands as (select seq, min(pos) + 5 as s, max(pos) - 5 as e from numbered group by seq, island having min(pos) + 5 <= max(pos) - 5),
cut as (select seq, s, e, greatest((e - s + 1) // 10, 1) as n from islands),
pieces as (select seq, (s + floor(i * ((e - s + 1) / n::double)))::bigint as a, (s + floor((i + 1) * ((e - s + 1) / n::double)) - 1)::bigint as b from (select *, unnest(range(n)) as i from cut))
select p.seq, a as start, b as "end", round(sum(value) / (b - a + 1)::double, 9) as score from pieces p join dense d on d.seq = p.seq and pos between a and b group by p.seq, a, b having sum(value) / (b - a + 1)::double > 3.5""")
def island_hints(spark, sf_dir):
    steps = I.coverage(intervals(spark, sf_dir), chunk=CHUNK).withColumnRenamed("cov", "value")
    return G.island_hints(steps, 3, 5, 10, 3.5, WIDTH).withColumn("score", F.round("score", 9))


@query("coverage_jumps", f"""with {IV}, events as (select seq, pos, sum(d) as d from (select seq, s as pos, 1 as d from iv union all select seq, e + 1, -1 from iv) group by seq, pos having sum(d) <> 0),
levels as (select seq, pos, sum(d) over (partition by seq order by pos) as value, lead(pos) over (partition by seq order by pos) as nxt from events),
steps as (select seq, pos as a, nxt - 1 as b, value from levels where value > 0),
pairs as (select *, lead(a) over w as a2, lead(b) over w as b2, lead(value) over w as v2 from steps window w as (partition by seq order by a))
select seq, a as start, b as "end", value::bigint as value, v2::bigint as value_next from pairs where a2 = b + 1 and b - a < 30 and b2 - a2 < 30 and (v2 >= value * 2.0 or value / 2.0 < v2)""")
def coverage_jumps(spark, sf_dir):
    steps = I.coverage(intervals(spark, sf_dir), chunk=CHUNK).withColumnRenamed("cov", "value")
    return G.coverage_jumps(steps, 2.0, 30, CHUNK).select("seq", "start", "end", "value", "value_next")


@query("steepest_decline", f"""with {IV}, {SIGNAL}, c as (select seq, pos, sum(value) over (partition by seq order by pos) as c from signal),
d as (select seq, pos, (lead(c, 5) over w + lag(c, 5) over w - 2 * c) / 25.0 as dr from c window w as (partition by seq order by pos))
select seq as tid, pos as at, round(dr, 9) as "drop" from (select *, row_number() over (partition by seq order by dr, pos) as r from d where dr is not null) where r = 1""")
def steepest_decline(spark, sf_dir):
    return G.steepest_decline(signal(spark, sf_dir).withColumnRenamed("seq", "tid"), 5).withColumn("drop", F.round("drop", 9))


@query("prefix_counts", f"with {IV}, {SIGNAL} select seq, pos, (sum(value) over (partition by seq order by pos))::bigint as total from signal")
def prefix_counts(spark, sf_dir):
    return G.prefix_counts(signal(spark, sf_dir), CHUNK).select("seq", "pos", F.col("total").cast("long").alias("total"))
