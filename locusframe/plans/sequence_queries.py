"""Sequence functions and statistics over the driver's documents as DNA."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, sequence as S
from ..operators import sequences as Q
from .registry import query
from .views import IV, SEQ, intervals, sequences, table

_RC = "reverse(translate(bases, 'ACGTacgt', 'TGCAtgca'))"


@query("reverse_complement", f"with {SEQ} select seq, md5({_RC}) as digest from sequences")
def reverse_complement(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq", F.md5(S.reverse_complement("bases")).alias("digest"))


@query("base_composition", f"""with {SEQ} select seq, {", ".join(f"(length(bases) - length(translate(bases, '{x.upper()}{x}', '')))::bigint as {x}" for x in "acgtn")}, length(bases) as total, 0::bigint as rest from sequences""")
def base_composition(spark, sf_dir):
    return Q.composition(sequences(spark, sf_dir))


@query("gc_windows", f"""with {SEQ}, w as (select seq, a + 1 as start, substring(bases, a + 1, 200) as b from (select seq, bases, unnest(range(0, length(bases), 200)) as a from sequences where length(bases) > 0))
select seq, start, round((length(b) - length(translate(b, 'GCgc', ''))) / length(b)::double, 9) as gc from w""")
def gc_windows(spark, sf_dir):
    return Q.windowed_gc(sequences(spark, sf_dir), 200).withColumn("gc", F.round("gc", 9))


@query("gc_class", f"""with {SEQ}, g as (select seq, (length(bases) - length(translate(bases, 'GCgc', ''))) / length(bases)::double as gc from sequences where length(bases) > 0)
select seq, (case when abs(gc - 0.45) <= abs(gc - 0.5) and abs(gc - 0.45) <= abs(gc - 0.55) then 0 when abs(gc - 0.5) <= abs(gc - 0.55) then 1 else 2 end)::int as class from g""")
def gc_class(spark, sf_dir):
    g = sequences(spark, sf_dir).where("length(bases) > 0").select("seq", S.gc_content("bases").alias("gc"))
    return Q.gc_class(g, [0.45, 0.5, 0.55]).select("seq", "class")


@query("kmer_counts", f"with {SEQ} select kmer, count(*) as n from (select upper(substring(bases, i, 5)) as kmer from (select bases, unnest(range(1, length(bases) - 3)) as i from sequences)) group by kmer")
def kmer_counts(spark, sf_dir):
    return Q.kmer_counts(sequences(spark, sf_dir), 5)


@query("framed_kmer_counts", f"with {SEQ} select frame, kmer, count(*) as n from (select ((i + 2) % 3)::int as frame, upper(substring(bases, i::int + 1, 3)) as kmer from (select bases, unnest(range(0, length(bases) - 2)) as i from sequences)) group by frame, kmer")
def framed_kmer_counts(spark, sf_dir):
    return Q.framed_kmer_counts(sequences(spark, sf_dir), 3)


@query("codon_usage", f"with {SEQ} select codon, count(*) as n from (select upper(substring(bases, i::int + 1, 3)) as codon from (select bases, unnest(range(0, length(bases) // 3 * 3, 3)) as i from sequences)) group by codon")
def codon_usage(spark, sf_dir):
    return Q.codon_usage(sequences(spark, sf_dir))


_CODE = S.codon_table()
_CODONS = f"{SEQ}, codons as (select seq, i // 3 as k, upper(substring(bases, i::int + 1, 3)) as codon, length(bases) // 3 as n from (select seq, bases, unnest(range(0, length(bases) // 3 * 3, 3)) as i from sequences)), code as (select unnest({list(_CODE)}) as codon, unnest({list(_CODE.values())}) as aa)"


@query("translate_cds", f"with {_CODONS}, p as (select seq, string_agg(aa, '' order by k) as protein from codons join code using (codon) group by seq) select seq, md5(coalesce(protein, '')) as digest from sequences left join p using (seq)")
def translate_cds(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq", F.md5(S.translate("bases")).alias("digest"))


@query("inframe_stops", f"with {_CODONS} select seq, coalesce(bool_or(codon in ('TAA', 'TAG', 'TGA') and k < n - 1), false) as has_stop from sequences left join codons using (seq) group by seq")
def inframe_stops(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq", S.has_inframe_stop("bases").alias("has_stop"))


_STOPS = f"""{SEQ}, frames as (select seq, f as frame, bases, (length(bases) - f) // 3 as n from sequences, (values (0), (1), (2)) v(f)),
stops as (select seq, frame, i, upper(substring(bases, (frame + i * 3 + 1)::int, 3)) in ('TAA', 'TAG', 'TGA') as stop from (select *, unnest(range(0, n)) as i from frames)),
edges as (select seq, frame, i from stops where stop union all select seq, frame, -1 from frames union all select seq, frame, n from frames),
stretch as (select seq, frame, i as a, lead(i) over (partition by seq, frame order by i) as b from edges)"""


@query("orf_stretches", f'with {_STOPS} select seq, frame, (a + 1) * 3 + frame + 1 as start, b * 3 + frame as "end" from stretch where b is not null and (a + 1) * 3 + frame + 1 <= b * 3 + frame')
def orf_stretches(spark, sf_dir):
    return Q.orf_begins(sequences(spark, sf_dir))


@query("longest_orf", f"with {_STOPS}, s as (select seq, frame, (a + 1) * 3 + frame + 1 as start, b - a - 1 as codons from stretch where b - a - 1 > 0) select seq, frame, start, codons from (select *, row_number() over (partition by seq order by codons desc, frame, start) as r from s) where r = 1")
def longest_orf(spark, sf_dir):
    o = S.longest_orf("bases")
    return sequences(spark, sf_dir).select("seq", o.alias("o")).where("o.codons > 0").select("seq", "o.frame", F.col("o.start").cast("long").alias("start"), F.col("o.codons").cast("long").alias("codons"))


_SITES = f"{SEQ}, sites as (select seq * 1000000 + k as id, substring(bases, (k * 8 + 1)::int, 8) as b from (select seq, bases, unnest(range(length(bases) // 8)) as k from sequences)), cells as (select id, i - 1 as pos, upper(substring(b, i::int, 1)) as letter from (select *, unnest(range(1, 9)) as i from sites)), c as (select pos, letter, count(*) as n from cells group by all), t as (select pos, sum(n) as total from c group by pos)"


def sites(spark, sf_dir):
    """``id, bases``: the sequences cut into sites of eight bases."""
    rows = sequences(spark, sf_dir).select("seq", F.posexplode(S.pieces("bases", 8)).alias("k", "bases")).where("length(bases) = 8")
    return rows.select((F.col("seq") * 1000000 + F.col("k")).alias("id"), "bases")


@query("kmer_numbers", f"with {_SITES} select id, sum((strpos('ACGT', letter) - 1) * pow(4, 7 - pos))::bigint as code from cells group by id")
def kmer_numbers(spark, sf_dir):
    return sites(spark, sf_dir).select("id", S.kmer_number("bases").alias("code"))


@query("repetitive_kmers", f"""with {SEQ}, s as (select * from sequences), km as (select seq, k, substring(bases, i::int + 1, k::int) as kmer from (select seq, bases, k, unnest(range(0, length(bases) - k + 1)) as i from s, (select unnest(range(3, 9)) as k))),
c as (select seq, k, kmer, count(*) as n from km group by all), sh as (select seq, k, sum(case when n > 2 then n else 0 end) / sum(n)::double as share from c group by seq, k)
select seq, k::int as k, round(share, 9) as share from (select *, row_number() over (partition by seq order by k desc) as r from sh where share >= case when k > 5 then 0.5 else 0.75 end) where r = 1""")
def repetitive_kmers(spark, sf_dir):
    return Q.repetitive(sequences(spark, sf_dir), 8, 3, 2).withColumn("share", F.round("share", 9))


_LETTERS = "select seq, i, substring(bases, i::int, 1) as c from (select seq, bases, unnest(range(1, length(bases) + 1)) as i from masked)"
_MASKED = f"{SEQ}, masked as (select seq, regexp_replace(bases, '[Tt][Gg]', 'NN', 'g') as bases from sequences)"


@query("mask_runs", f"""with {_MASKED}, letters as ({_LETTERS}), low as (select seq, i, i - row_number() over (partition by seq order by i) as g from letters where c between 'a' and 'z')
select seq, min(i) as start, max(i) as "end" from low group by seq, g""")
def mask_runs(spark, sf_dir):
    masked = sequences(spark, sf_dir).withColumn("bases", F.regexp_replace("bases", "[Tt][Gg]", "NN"))
    return Q.mask_runs(masked)


@query("gap_runs", f"""with {_MASKED}, letters as ({_LETTERS}), low as (select seq, i, i - row_number() over (partition by seq order by i) as g from letters where c = 'N')
select seq, min(i) as start, max(i) as "end" from low group by seq, g""")
def gap_runs(spark, sf_dir):
    masked = sequences(spark, sf_dir).withColumn("bases", F.regexp_replace("bases", "[Tt][Gg]", "NN"))
    return Q.mask_runs(masked, "[Nn]+")


_TWO = f"{SEQ}, two as (select seq, regexp_replace(bases, '[ac]', 'A', 'g') as a, regexp_replace(bases, '[cg]', 'C', 'g') as b from sequences), p as (select seq, substring(a, i::int, 1) as x, substring(b, i::int, 1) as y from (select *, unnest(range(1, length(a) + 1)) as i from two))"


@query("mask_compare", f"""with {_TWO}, n as (select seq, count(*) filter (where x between 'a' and 'z' and y between 'a' and 'z') as both_, count(*) filter (where x between 'a' and 'z' and y not between 'a' and 'z') as f, count(*) filter (where y between 'a' and 'z' and x not between 'a' and 'z') as s from p group by seq)
select seq, coalesce(both_, 0) as "both", coalesce(f, 0) as only_first, coalesce(s, 0) as only_second from sequences left join n using (seq)""")
def mask_compare(spark, sf_dir):
    s = sequences(spark, sf_dir).select("seq", F.regexp_replace("bases", "[ac]", "A").alias("a"), F.regexp_replace("bases", "[cg]", "C").alias("b"))
    return Q.mask_compare(s, "a", "b")


@query("length_distribution", f"with {IV}, c as (select e - s + 1 as len, count(*) as n from iv group by 1) select len, n, round(n / sum(n) over ()::double, 9) as prob from c")
def length_distribution(spark, sf_dir):
    lengths = intervals(spark, sf_dir).select((F.col("end") - F.col("start") + 1).alias("len"))
    return Q.length_distribution(lengths).withColumn("prob", F.round("prob", 9))


@query("smoothed_lengths", f"""with {IV}, c as (select e - s + 1 as len, count(*) as n from iv group by 1), h as (select *, greatest(floor(len * 0.1), 1)::bigint as h from c),
w as (select len + d as len, n * (h + 1 - abs(d)) / ((h + 1) * (h + 1))::double as w from (select *, unnest(range(-h, h + 1)) as d from h)), g as (select len, sum(w) as n from w where len > 0 group by len)
select len, round(n, 6) as n, round(n / sum(n) over (), 9) as prob from g""")
def smoothed_lengths(spark, sf_dir):
    lengths = intervals(spark, sf_dir).select((F.col("end") - F.col("start") + 1).alias("len"))
    return Q.length_distribution(lengths, bandwidth=0.1).select("len", F.round("n", 6).alias("n"), F.round("prob", 9).alias("prob"))


#: Ten regions a sequence, spread over all of it.
_REGION = "r as (select seq, seq * 10 + k as rid, greatest(1, length(bases) * k // 10 + 1)::bigint as s, greatest(1, length(bases) * k // 10 + 1)::bigint + 60 + seq % 90 as e, case (seq + k) % 2 when 0 then '+' else '-' end as strand from sequences, (select unnest(range(10)) as k))"


def spread_regions(sequences):
    start = F.greatest(F.lit(1), F.floor(F.length("bases") * F.col("k") / 10) + 1).cast("long")
    r = sequences.select("seq", "bases", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select("seq", "k", start.alias("start"))
    return r.select((F.col("seq") * 10 + F.col("k")).alias("rid"), "seq", "start", (F.col("start") + 60 + F.col("seq") % 90).alias("end"), F.when((F.col("seq") + F.col("k")) % 2 == 0, "+").otherwise("-").alias("strand"))


@query("region_extract", f"with {SEQ}, {_REGION}, c as (select rid, strand, substring(bases, s, e - s + 1) as bases from r join sequences using (seq)) select rid, case strand when '-' then {_RC} else bases end as bases from c")
def region_extract(spark, sf_dir):
    q = sequences(spark, sf_dir)
    return Q.region(q, spread_regions(q)).select("rid", "bases")


@query("chunked_fetch", f"with {SEQ}, {_REGION} select rid, substring(bases, s, e + 200 - s + 1) as bases from r join sequences using (seq) where length(bases) >= s")
def chunked_fetch(spark, sf_dir):
    q = sequences(spark, sf_dir)
    return Q.fetch_chunks(Q.chunked(q, 100), spread_regions(q).withColumn("end", F.col("end") + 200).drop("strand"), 512)


@query("position_weights", f"""with {_SITES}
select pos::int as pos, l.letter, round(ln((coalesce(n, 0) + 1.0) / (total + 4.0)), 9) as logp from t cross join (values ('A'), ('C'), ('G'), ('T')) l(letter) left join c using (pos, letter)""")
def position_weights(spark, sf_dir):
    return Q.position_weights(sites(spark, sf_dir)).withColumn("logp", F.round("logp", 9))


@query("weight_scores", f"with {_SITES} select id, round(sum(ln((n + 1.0) / (total + 4.0))), 6) as score from cells join c using (pos, letter) join t using (pos) group by id")
def weight_scores(spark, sf_dir):
    s = sites(spark, sf_dir)
    return Q.weight_scores(s, Q.position_weights(s)).withColumn("score", F.round("score", 6))


@query("markov_scores", f"""with {SEQ}, k as (select seq, upper(substring(bases, i::int, 4)) as kmer from (select seq, bases, unnest(range(1, length(bases) - 2)) as i from sequences)), c as (select kmer, count(*) as n from k group by kmer), t as (select kmer[1:3] as context, sum(n) as total from c group by 1)
select seq, round(sum(ln((n + 1.0) / (total + 4.0))), 4) as score from k join c using (kmer) join t on t.context = kmer[1:3] group by seq""")
def markov_scores(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return Q.markov_scores(s, Q.markov_model(Q.kmer_counts(s, 4)), 3).withColumn("score", F.round("score", 4))


@query("splice_motifs", f"with {SEQ}, m as (select seq, upper(substring(bases, 3, 2) || substring(bases, length(bases) - 3, 2)) as motif from sequences where length(bases) >= 8) select seq, motif, case when motif like '%GTAG%' then '+' when reverse(translate(motif, 'ACGT', 'TGCA')) like '%GTAG%' then '-' end as strand from m")
def splice_motifs(spark, sf_dir):
    m = S.splice_motif("bases", F.lit(3), F.length("bases") - 2)
    return sequences(spark, sf_dir).where("length(bases) >= 8").select("seq", m.alias("motif")).withColumn("strand", S.motif_strand("motif"))


@query("exon_parts", f'with {IV}, w as (select id, s, e, (e - s + 1) // 5 as w from iv), p as (select id, i, s + i * w as a, case when i = 4 then e else s + (i + 1) * w - 1 end as b from w, (select unnest(range(5)) as i)) select id, a as start, b as "end", count(*) as n from p where a <= b group by all')
def exon_parts(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    p = iv.select("id", F.explode(scores.exon_parts("start", "end")).alias("p"))
    return p.groupBy("id", "p.start", "p.end").agg(F.count(F.lit(1)).alias("n"))


@query("flipped_coordinates", f'with {IV} select id, 5000 - 1 - e as start, 5000 - 1 - s as "end", count(*) as n from iv group by all')
def flipped_coordinates(spark, sf_dir):
    start, end = scores.flipped("start", "end", F.lit(5000))
    return intervals(spark, sf_dir).select("id", start.alias("start"), end.alias("end")).groupBy("id", "start", "end").agg(F.count(F.lit(1)).alias("n"))


@query("transcript_scores", f"with {IV} select id, round((4 * (score / 1000) + 4 * (mult::double) + priority) / 9.0, 6) as score from iv")
def transcript_scores(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    return iv.select("id", F.round(scores.transcript_score(F.col("score") / 1000, F.col("mult").cast("double"), F.col("priority").cast("double")), 6).alias("score"))


@query("logistic_scores", f"with {IV} select id, round(1 / (1 + exp(-(0.5 + 0.01 * priority - 0.2 * mult))), 9) as p from iv")
def logistic_scores(spark, sf_dir):
    return intervals(spark, sf_dir).select("id", F.round(scores.logistic(["priority", "mult"], [0.01, -0.2], 0.5), 9).alias("p"))


@query("faded_bonus", f"with {IV} select id, round(pow(1.5, greatest(case when e > s then 1 - abs(s + 2 - (s + e) / 2.0) / ((e - s) / 2.0) else case when s + 2 = s then 1.0 else 0.0 end end, 0.0)), 9) as bonus from iv")
def faded_bonus(spark, sf_dir):
    return intervals(spark, sf_dir).select("id", F.round(scores.faded_bonus(F.lit(1.5), "start", "end", F.col("start") + 2), 9).alias("bonus"))


@query("clean_headers", "select doc_id as seq, 'seq' || doc_id as name, md5(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g')) as header from documents")
def clean_headers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.concat(F.lit("seq"), F.col("doc_id").cast("string")).alias("name"), F.md5(F.regexp_replace("text", "[^A-Za-z0-9]+", "_")).alias("header"))


@query("merged_masks", f"with {_TWO}, m as (select seq, md5(string_agg(case when x between 'a' and 'z' or y between 'a' and 'z' then lower(x) else x end, '' order by i)) as digest from (select seq, i, substring(a, i::int, 1) as x, substring(b, i::int, 1) as y from (select *, unnest(range(1, length(a) + 1)) as i from two)) group by seq) select seq, digest from m")
def merged_masks(spark, sf_dir):
    s = sequences(spark, sf_dir).where("length(bases) > 0").select("seq", F.regexp_replace("bases", "[ac]", "A").alias("a"), F.regexp_replace("bases", "[cg]", "C").alias("b"))
    return s.select("seq", F.md5(S.merge_masking("a", "b")).alias("digest"))
