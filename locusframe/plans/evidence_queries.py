"""Evidence hints over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import evidence as E
from ..operators.intervals import overlap_join
from .registry import query
from .views import IV, REGIONS, WIDTH, intervals, regions, table


def hints(spark, sf_dir):
    """Intervals as hints: source letter, group by order, frame by day."""
    iv = intervals(spark, sf_dir)
    return iv.select(
        F.col("id").alias("hint_id"), "seq", "type", "start", "end", "strand", (F.col("start") % 3).cast("string").alias("frame"), "score", "mult", "priority", F.col("src").alias("esource"), F.concat(F.lit("db"), "src").alias("source"), F.concat(F.lit("o"), (F.col("id") / 10).cast("long").cast("string")).alias("grp")
    )


HINTS = f"{IV}, hints as (select id as hint_id, seq, type, s, e, strand, (s % 3)::varchar as frame, score, mult, priority, src as esource, 'db' || src as source, 'o' || (id // 10)::varchar as grp from iv)"


@query("hint_collapse", f'with {HINTS} select seq, type, s as start, e as "end", strand, frame, esource[1:1] as src1, sum(mult)::bigint as mult, count(*) as n, round(case when count(*) > 1 then sum(mult)::double else max(score) end, 6) as score from hints group by seq, type, s, e, strand, frame, esource[1:1]')
def hint_collapse(spark, sf_dir):
    return E.collapsed(hints(spark, sf_dir)).drop("source").withColumn("score", F.round("score", 6))


@query("hint_union_distinct", f"""with {HINTS}, stacked as (select *, 0 as file from hints where hint_id % 2 = 0 union all select *, 1 from hints where hint_id % 2 = 1 or hint_id % 3 = 0)
select seq, type, s as start, e as "end", strand, min(file * 1000000000 + hint_id)::bigint as hint_id from stacked group by seq, type, s, e, strand""")
def hint_union_distinct(spark, sf_dir):
    h = hints(spark, sf_dir)
    key = ["seq", "type", "start", "end", "strand"]
    two = [h.where("hint_id % 2 = 0").select(*key, "hint_id"), h.where("hint_id % 2 = 1 or hint_id % 3 = 0").select(*key, (F.col("hint_id") + 1000000000).alias("hint_id"))]
    return E.union_distinct(two, key)


@query("hint_bonus", f"""with {HINTS}, graded as (select *, (score >= 10000)::int + (score >= 30000)::int + (score >= 60000)::int as grade from hints)
select hint_id, grade, round(case when grade > 0 and mult > 1 then least(pow(b, mult), b * mult) else b end, 9) as bonus from (select *, 1.2 * (array[1.0, 1.1, 1.3, 1.7])[grade + 1] as b from graded)""")
def hint_bonus(spark, sf_dir):
    bounds, quots = F.array(*[F.lit(x) for x in (10000.0, 30000.0, 60000.0)]), F.array(*[F.lit(x) for x in (1.0, 1.1, 1.3, 1.7)])
    h = hints(spark, sf_dir).withColumn("grade", scores.grade_class("score", bounds).cast("long"))
    bonus = scores.hint_bonus(F.lit(1.2), F.element_at(quots, (F.col("grade") + 1).cast("int")), "mult", F.col("grade") > 0)
    return h.select("hint_id", F.col("grade").cast("int").alias("grade"), F.round(bonus, 9).alias("bonus"))


@query("hint_attributes", """with a as (select l_orderkey * 10 + l_linenumber as hint_id, case l_linenumber when 1 then 'grp=g' || l_orderkey || ';pri=4;src=E' when 2 then 'source=Manual;mult=' || l_partkey else 'src=M2;group=x;grp=y' end as attr from lineitem)
select hint_id, nullif(coalesce(nullif(regexp_extract(attr, 'group=([^;]*)', 1), ''), regexp_extract(attr, 'grp=([^;]*)', 1)), '') as grp,
  coalesce(try_cast(nullif(regexp_extract(attr, 'pri=(-?[0-9]+)', 1), '') as int), -1) as priority, coalesce(try_cast(nullif(regexp_extract(attr, 'mult=([0-9]+)', 1), '') as int), 1) as mult,
  coalesce(nullif(regexp_extract(attr, 'source=([A-Za-z]+)', 1), ''), nullif(regexp_extract(attr, 'src=([A-Za-z]+)', 1), '')) as esource from a""")
def hint_attributes(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber")
    attr = F.when(line == 1, F.concat(F.lit("grp=g"), F.col("l_orderkey").cast("string"), F.lit(";pri=4;src=E"))).when(line == 2, F.concat(F.lit("source=Manual;mult="), F.col("l_partkey").cast("string"))).otherwise("src=M2;group=x;grp=y")
    rows = t.select((F.col("l_orderkey") * 10 + line).alias("hint_id"), attr.alias("attributes"), F.lit("ep").alias("type"))
    return E.parsed(rows).select("hint_id", "grp", "priority", "mult", "esource")


def typed_hints(spark, sf_dir):
    """:func:`hints` with all 17 types dealt over them."""
    return hints(spark, sf_dir).withColumn("type", F.element_at(F.array(*[F.lit(t) for t in E.TYPES]), (F.col("hint_id") % len(E.TYPES) + 1).cast("int")))


_TYPES = "array['start','stop','ass','dss','tss','tts','exonpart','exon','intronpart','intron','irpart','CDS','CDSpart','UTR','UTRpart','nonexonpart','nonirpart']"
TYPED = f"{HINTS}, typed as (select * replace (({_TYPES})[hint_id % 17 + 1] as type) from hints)"
_SIGNAL = "in ('start', 'stop', 'ass', 'dss', 'tss', 'tts')"
_ORDER = f"list_position({_TYPES}, {{}}.type)"


def _rule(p: str, q: str) -> str:
    """Whether overlapping hints of two types on one strand agree: ``p`` has the smaller type, ``a`` asks."""
    within = f"{p}.s >= {q}.s and {p}.e <= {q}.e"
    covers = f"{p}.s <= {q}.s and {p}.e >= {q}.e"

    def wrong(left: str, right: str, margin: int = 0) -> str:
        """A signal away from the end of ``q`` that it belongs to."""
        late, early = f"{p}.s > {q}.s + {margin}", f"{p}.e < {q}.e - {margin}"
        return f"""({late} and {early})
      or (a.strand = '+' and (({p}.type = '{left}' and {late}) or ({p}.type = '{right}' and {early})))
      or (a.strand = '-' and (({p}.type = '{left}' and {early}) or ({p}.type = '{right}' and {late})))"""

    return f"""case
  when {p}.type in ('start', 'stop') then case
    when {q}.type in ('intronpart', 'intron', 'irpart', 'nonexonpart', 'UTR', 'UTRpart') then not ({within})
    when {q}.type = 'CDSpart' then not ({wrong("start", "stop")})
    when {q}.type = 'CDS' then not ({wrong("start", "stop")} or {p}.e < {q}.s + 2 or {p}.s > {q}.e - 2)
    else true end
  when {p}.type in ('ass', 'dss') then case
    when {q}.type in ('irpart', 'UTR', 'UTRpart', 'exonpart', 'exon', 'CDS', 'CDSpart') then not ({within})
    when {q}.type in ('intron', 'intronpart') then not ({wrong("dss", "ass")})
    else true end
  when {p}.type in ('tss', 'tts') then case
    when {q}.type in ('irpart', 'intron', 'intronpart', 'nonexonpart', 'CDS', 'CDSpart') then not ({within})
    when {q}.type in ('UTR', 'UTRpart', 'exon', 'exonpart') then not ({wrong("tss", "tts", 50)})
    else true end
  when {p}.type = 'exonpart' then case
    when {q}.type in ('intronpart', 'intron', 'irpart', 'nonexonpart') then false
    when {q}.type = 'exon' then {within}
    when {q}.type = 'UTR' then not ({p}.s < {q}.s and {p}.e > {q}.e)
    else true end
  when {p}.type = 'exon' then case
    when {q}.type in ('intronpart', 'intron', 'irpart', 'nonexonpart') then false
    when {q}.type in ('CDS', 'CDSpart', 'UTRpart') then {covers}
    when {q}.type = 'UTR' then ({p}.s = {q}.s and {p}.e >= {q}.e) or ({p}.e = {q}.e and {p}.s <= {q}.e)
    else true end
  when {p}.type = 'intronpart' and {q}.type = 'intron' then {within}
  when {p}.type in ('intronpart', 'intron') then {q}.type not in ('irpart', 'CDS', 'CDSpart', 'UTR', 'UTRpart')
  when {p}.type = 'irpart' then {q}.type = 'nonexonpart'
  when {p}.type = 'CDS' then {q}.type = 'CDSpart' and {covers}
  when {p}.type = 'UTR' then {q}.type = 'UTRpart' and {covers}
  else false end"""


_CLOSE = "(a.type = b.type and a.strand = b.strand and a.type in ('tss', 'tts') and abs(a.s + a.e - b.s - b.e) // 2 <= case a.type when 'tts' then 1000 else 0 end)"
_MEET = f"a.seq = b.seq and ((a.s <= b.e and b.s <= a.e) or {_CLOSE})"
_FITS = f"""case
  when a.s > b.e or a.e < b.s then not {_CLOSE}
  when a.strand <> b.strand and a.strand <> '.' and b.strand <> '.' then
    (a.type {_SIGNAL} and b.type {_SIGNAL}) or (a.type {_SIGNAL} and (a.s < b.s or a.e > b.e)) or (b.type {_SIGNAL} and (a.s > b.s or a.e < b.e))
  when a.type = b.type then (a.s = b.s and a.e = b.e) or a.type not in ('exon', 'intron', 'CDS', 'UTR')
  when {_ORDER.format("a")} < {_ORDER.format("b")} then {_rule("a", "b")}
  else {_rule("b", "a")} end"""


@query("overlap_self_compat", f"""with {TYPED}, pairs as (select case when x <= y then ta else tb end as t1, case when x <= y then tb else ta end as t2, fits from (
  select a.type as ta, b.type as tb, {_ORDER.format("a")} as x, {_ORDER.format("b")} as y, {_FITS} as fits
  from typed a join typed b on a.hint_id < b.hint_id and {_MEET}))
select t1, t2, count(*) filter (where fits) as compatible, count(*) filter (where not fits) as incompatible from pairs group by t1, t2""")
def overlap_self_compat(spark, sf_dir):
    h = typed_hints(spark, sf_dir).select("hint_id", "seq", "type", "start", "end", "strand")
    p = E.hint_pairs(h, None, WIDTH).where("hint_id < hint_id_r")
    first = E.type_id(F.col("type")) <= E.type_id(F.col("type_r"))
    t1, t2 = F.when(first, F.col("type")).otherwise(F.col("type_r")), F.when(first, F.col("type_r")).otherwise(F.col("type"))
    n = lambda c: F.sum(c.cast("long")).alias
    return p.groupBy(t1.alias("t1"), t2.alias("t2")).agg(n(F.col("compatible"))("compatible"), n(~F.col("compatible"))("incompatible"))


_WEAK = f"""(a.s <= b.e and b.s <= a.e and ((a.type = b.type and a.s = b.s and a.e = b.e)
  or (a.type = b.type and a.type {_SIGNAL} and a.s <= b.s and a.e >= b.e)
  or (a.s >= b.s and a.e <= b.e and ((a.type = 'exonpart' and b.type in ('exon', 'exonpart')) or (a.type = 'intronpart' and b.type in ('intron', 'intronpart')) or (a.type = 'irpart' and b.type = 'irpart')
    or (a.type = 'CDSpart' and b.type in ('CDS', 'CDSpart')) or (a.type = 'UTRpart' and b.type in ('UTR', 'UTRpart')) or (a.type = 'nonexonpart' and b.type = 'nonexonpart') or (a.type = 'nonirpart' and b.type <> 'irpart')))))"""


@query("hint_dominance", f"with {TYPED} select a.hint_id, count(*) as stronger, count(*) filter (where a.s <> b.s or a.e <> b.e) as strictly from typed a join typed b on a.seq = b.seq and a.hint_id <> b.hint_id and {_WEAK} group by a.hint_id")
def hint_dominance(spark, sf_dir):
    h = typed_hints(spark, sf_dir).select("hint_id", "seq", "type", "start", "end", "strand")
    p = E.hint_pairs(h, None, WIDTH).where("hint_id <> hint_id_r and weaker")
    return p.groupBy("hint_id").agg(F.count(F.lit(1)).alias("stronger"), F.sum(F.col("strict").cast("long")).alias("strictly"))


@query("group_ranges", f'with {HINTS} select seq, \'g:\' || grp as gid, min(s) as start, max(e) as "end", count(*) as n, sum(mult)::bigint as mult, max(priority) as priority from hints group by seq, grp')
def group_ranges(spark, sf_dir):
    return E.group_ranges(E.grouped(hints(spark, sf_dir)))


@query("genic_gaps", f"""with {HINTS}, seen as (select *, max(e) over (partition by seq, grp order by s, e rows between unbounded preceding and 1 preceding) as reach from hints)
select seq, 'g:' || grp as gid, reach + 1 as start, s - 1 as "end" from seen where s - reach - 1 between 1 and 500000""")
def genic_gaps(spark, sf_dir):
    return E.genic_gaps(E.grouped(hints(spark, sf_dir)))


@query("group_relations", f"""with {TYPED}, ranges as (select seq, 'g:' || grp as gid, min(s) as s, max(e) as e, count(*) as n from typed group by seq, grp),
pairs as (select a.seq, a.gid, b.gid as gid_r, a.n, b.s < a.s or b.e > a.e as beyond from ranges a join ranges b on a.seq = b.seq and a.gid <> b.gid and a.s <= b.e and b.s <= a.e),
met as (select a.seq, 'g:' || a.grp as gid, 'g:' || b.grp as gid_r, a.hint_id,
    {_FITS} as fits, {_WEAK} as weak, a.s <> b.s or a.e <> b.e as strict
  from typed a join typed b on a.grp <> b.grp and {_MEET}),
by_hint as (select seq, gid, gid_r, hint_id, bool_and(fits) as fits, bool_or(weak) as under, bool_or(weak and strict) as strictly from met group by all),
by_group as (select seq, gid, gid_r, bool_and(fits) as fits, count(*) filter (where under) as under, bool_or(strictly) as strictly from by_hint group by all)
select coalesce(fits, true) as compatible, coalesce(under = n and (strictly or beyond), false) as weaker, count(*) as n from pairs left join by_group using (seq, gid, gid_r) group by 1, 2""")
def group_relations(spark, sf_dir):
    return E.group_relations(E.grouped(typed_hints(spark, sf_dir)), width=WIDTH).groupBy("compatible", "weaker").agg(F.count(F.lit(1)).alias("n"))


@query("conformance", f"""with {TYPED}, met as (select a.hint_id, b.grp as gr, {_WEAK} as weak,
    not ({_FITS}) and not (b.priority < a.priority) as bad,
    case when a.type = 'intron' and b.type like '%part' then least(b.e - b.s + 1, a.e - a.s + 1) / (a.e - a.s + 1)::double else 1.0 end as share
  from typed a join typed b on a.grp <> b.grp and {_MEET}),
by_group as (select hint_id, gr, max(weak::int) as supports, max(case when bad then share else 0.0 end) as against from met group by hint_id, gr)
select hint_id, sum(supports)::bigint as support, round(sum(against), 6) as contradict from by_group group by hint_id""")
def conformance(spark, sf_dir):
    got = E.conformance_counts(E.grouped(typed_hints(spark, sf_dir)), width=WIDTH)
    return got.withColumn("contradict", F.round("contradict", 6))


@query("equal_groups", f"""with {HINTS}, own as (select seq, 'g:' || grp as gid, string_agg(s || ':' || e || ':' || type || ':' || strand || ':' || frame, ',' order by s, e, type, strand, frame) as o from hints group by seq, grp)
select seq, min(gid) as gid, count(*) as copies from own group by seq, o""")
def equal_groups(spark, sf_dir):
    return E.equal_groups(E.grouped(hints(spark, sf_dir)))


@query("can_alternate", f"with {HINTS} select distinct seq, 'g:' || grp as gid from hints where type in ('intron', 'CDS')")
def can_alternate(spark, sf_dir):
    return E.can_alternate(E.grouped(hints(spark, sf_dir)), ["intron", "CDS"])


@query("trashy_groups", f"""with {HINTS}, c as (select *, hint_id % 5 as support, hint_id % 37 as contradict from hints)
select seq, 'g:' || grp as gid, round(max(contradict / (support + 1.0)), 9) as ratio from c group by seq, grp having max(contradict / (support + 1.0)) >= 9""")
def trashy_groups(spark, sf_dir):
    h = E.grouped(hints(spark, sf_dir)).withColumns({"support": F.col("hint_id") % 5, "contradict": F.col("hint_id") % 37})
    return E.trashy_groups(h).withColumn("ratio", F.round("ratio", 9))


@query("region_frame_hints", f"""with {HINTS}, {REGIONS} select rid, count(*) as hits from hints join regions using (seq) where rs <= s and e <= re
  and case strand when '-' then (e - frame::int - rs) % 3 = 0 else (s + frame::int - rs) % 3 = 0 end group by rid""")
def region_frame_hints(spark, sf_dir):
    met = E.in_region(hints(spark, sf_dir), regions(spark, sf_dir), "overlap", WIDTH).where("start_r <= start and end <= end_r")
    met = met.where(E.frame_congruent(F.col("start"), F.col("end"), F.col("frame"), F.col("strand"), F.col("start_r")))
    return met.groupBy(F.col("rid_r").alias("rid")).agg(F.count(F.lit(1)).alias("hits"))


@query("evidence_by_region", f"""with {HINTS}, {REGIONS}, collapsed as (select seq, type, s, e, strand, frame, esource[1:1] as src1, sum(mult)::bigint as mult from hints group by all),
weighted as (select *, case when mult > 1 then least(pow(1.2, mult), 1.2 * mult) else 1.2 end as bonus from collapsed)
select rid, type, count(*) as hints, sum(mult)::bigint as mult, round(max(bonus), 9) as best from weighted w join regions r on w.seq = r.seq and s <= re and rs <= e group by rid, type""")
def evidence_by_region(spark, sf_dir):
    """The flagship: hints collapsed, weighted by multiplicity, and gathered by region."""
    h = E.collapsed(hints(spark, sf_dir))
    h = h.withColumn("bonus", scores.hint_bonus(F.lit(1.2), F.lit(1.0), "mult", F.lit(True)))
    met = overlap_join(h.select("seq", "type", "start", "end", "mult", "bonus"), regions(spark, sf_dir), ("seq",), WIDTH)
    return met.groupBy(F.col("rid_r").alias("rid"), "type").agg(F.count(F.lit(1)).alias("hints"), F.sum("mult").cast("long").alias("mult"), F.round(F.max("bonus"), 9).alias("best"))


@query("conformed_bonus", f"with {HINTS} select hint_id, round(exp(ln(1.7) * 2 * (5.0 + hint_id % 7) / (10.0 + hint_id % 7 + hint_id % 11)), 9) as bonus from hints")
def conformed_bonus(spark, sf_dir):
    return hints(spark, sf_dir).select("hint_id", F.round(scores.conformed_bonus(F.lit(1.7), F.col("hint_id") % 7, F.col("hint_id") % 11), 9).alias("bonus"))


@query("attach_hints", f"""with {HINTS}, f as (select hint_id as feature_id, seq, type, s, e, strand from hints where hint_id % 4 = 0),
best as (select seq, type, s, e, strand, sum(mult)::bigint as mult, string_agg(distinct esource, ',' order by esource) as sources from hints where hint_id % 4 <> 0 group by all)
select has_feature, mult is not null as has_hint, coalesce(sources, '') as sources, count(*) as n from (select f.feature_id is not null as has_feature, mult, sources from f full join best using (seq, type, s, e, strand)) group by all""")
def attach_hints(spark, sf_dir):
    h = hints(spark, sf_dir)
    features = h.where("hint_id % 4 = 0").select(F.col("hint_id").alias("feature_id"), "seq", "type", "start", "end", "strand")
    got = E.attach_hints(features, h.where("hint_id % 4 <> 0"))
    return got.groupBy("has_feature", F.col("mult").isNotNull().alias("has_hint"), F.coalesce("sources", F.lit("")).alias("sources")).agg(F.count(F.lit(1)).alias("n"))


@query("hint_type_join", f"with {HINTS} select t.name, count(*) as n from (values (0, 'CDS'), (1, 'exon'), (2, 'intron')) t(id, name) join hints h on h.type = t.name join (select distinct s_suppkey from supplier) q on q.s_suppkey = h.seq group by t.name")
def hint_type_join(spark, sf_dir):
    """Hints by a list of types and a list of sequences: tables are named in the text, and no views are left behind."""
    names = table(spark, sf_dir, "supplier").select("s_suppkey")
    text = "select t.name, count(*) as n from (values (0, 'CDS'), (1, 'exon'), (2, 'intron')) t(id, name) join {h} h on h.type = t.name join {q} q on q.s_suppkey = h.seq group by t.name"
    return spark.sql(text, h=hints(spark, sf_dir), q=names)


@query("anti_names", "select distinct l_suppkey as seq from lineitem where not exists (select 1 from supplier where s_suppkey = l_suppkey and s_suppkey % 2 = 0)")
def anti_names(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("seq"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("seq")).distinct().join(names, "seq", "left_anti")


@query("full_key_distinct", f'with {HINTS} select seq, type, s as start, e as "end", strand, count(*) as n from (select distinct seq, type, s, e, strand, frame, mult from hints) group by all')
def full_key_distinct(spark, sf_dir):
    one = hints(spark, sf_dir).dropDuplicates(["seq", "type", "start", "end", "strand", "frame", "mult"])
    return one.groupBy("seq", "type", "start", "end", "strand").agg(F.count(F.lit(1)).alias("n"))


@query("hinted_splice_sites", f"""with {HINTS}, i as (select * from hints where type = 'intron' and strand in ('+', '-')),
x as (select seq, strand, mult, case strand when '-' then 'ass' else 'dss' end as type, s - 1 as p from i union all select seq, strand, mult, case strand when '-' then 'dss' else 'ass' end, e + 1 from i)
select seq, type, p as start, p as "end", strand, sum(mult)::bigint as mult from x group by all""")
def hinted_splice_sites(spark, sf_dir):
    return E.hinted_splice_sites(hints(spark, sf_dir).where("type = 'intron'"))


@query("signal_consistency", """with s as (select doc_id as seq, translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'acgtacgtacgtacgtacgtacgtacACGTACGTACGTACGTACGTACGTAC') as bases from documents),
h as (select seq, p as s, case p % 3 when 0 then 'start' when 1 then 'stop' else 'intron' end as type, case p % 2 when 0 then '+' else '-' end as strand, bases from (select *, unnest(range(1, length(bases) - 29, 7)) as p from s)),
m as (select *, upper(case type when 'intron' then substring(bases, s, 2) || substring(bases, s + 29, 2) else substring(bases, s, 3) end) as f from h), r as (select *, case strand when '+' then f else reverse(translate(f, 'ACGT', 'TGCA')) end as x from m)
select type, strand, case type when 'start' then x = 'ATG' when 'stop' then x in ('TAA', 'TAG', 'TGA') else x in ('GTAG', 'GCAG', 'ATAC') end as consistent, count(*) as n from r group by all""")
def signal_consistency(spark, sf_dir):
    from .views import sequences

    s = sequences(spark, sf_dir)
    p = F.explode(F.sequence(F.lit(1), F.length("bases") - 30, F.lit(7)))
    h = s.where("length(bases) > 30").select("seq", p.alias("start")).select("seq", F.col("start").cast("long").alias("start"), F.when(F.col("start") % 3 == 0, "start").when(F.col("start") % 3 == 1, "stop").otherwise("intron").alias("type"), F.when(F.col("start") % 2 == 0, "+").otherwise("-").alias("strand"))
    h = h.withColumn("end", F.col("start") + F.when(F.col("type") == "intron", 30).otherwise(2))
    return E.consistent_with_sequence(h, s).groupBy("type", "strand", "consistent").agg(F.count(F.lit(1)).alias("n"))


@query("dimension_keys", "select c_mktsegment as name, row_number() over (order by c_mktsegment) as key from (select distinct c_mktsegment from customer)")
def dimension_keys(spark, sf_dir):
    from ..sources.store import dimension

    return dimension(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")), "name")
