"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Spans of secrets are found per text.  The hash of every candidate value is aggregated by distinct
repositories and owners over the whole corpus, which separates widely copied examples from values
that one owner has in few places, which look live.  Values of base spans that look live get a span of
their own, and bare mixed tokens, which no rule catches by themselves, become spans if they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import written

#: Fixed values of the contract, in its order: kind, pattern, group of the value, its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: The method's own kind: a long token of digits and letters of both cases.
BARE = ("bare", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
#: And that of the value of a base span that looks live.
LIVE = "live"
#: A value of so many owners, or in so many repositories whoever owns them, is a widely copied example.
#: A value looks live if a single owner has it and it isn't widely copied.
COPIED_OWNERS, COPIED_REPOS = 3, 10

_SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string,hash:string,value_start:bigint>>"


def _found(text: Column, number: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind: leftmost non-overlapping matches, those with too short a value dropped.

    Offsets are in code points: the lengths of the pieces between matches and of the matches, summed up.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    starts = F.aggregate(
        F.zip_with(F.slice(between, F.lit(1), F.size(whole)), whole, lambda p, m: F.struct(F.char_length(p).cast("long").alias("p"), F.char_length(m).cast("long").alias("m"))),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["p"] + x["m"]).alias("at"), F.array_append(acc["out"], acc["at"] + x["p"]).alias("out")),
        lambda acc: acc["out"],
    )
    spans = F.transform(
        F.arrays_zip(starts.alias("s"), whole.alias("m"), value.alias("v")),
        lambda x: F.struct(
            x["s"].alias("start"), F.lit(number).alias("kind_no"), (x["s"] + F.char_length(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["v"].alias("hash"),
            # a value stands at the end of its match
            (x["s"] + F.char_length(x["m"]) - F.char_length(x["v"])).alias("value_start"),
        ),
    )
    kept = F.transform(F.filter(spans, lambda x: F.char_length(x["hash"]) >= least), lambda x: x.withField("hash", F.sha2(x["hash"], 256)))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(_SPAN))


def _mixed(text: Column) -> Column:
    """Bare tokens with a digit, a lower-case and an upper-case letter: as spans, before hashing."""
    number = len(KINDS)
    pattern = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z]){BARE[1]}"
    return _found(text, number, BARE[0], pattern, BARE[2], BARE[3])


def _string(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``base`` and ``added`` spans, ``n_live``, ``n_copied``.

    Spans are ``start, kind_no, end, kind, hash, value_start`` with code point offsets, end exclusive,
    ``hash`` the value's SHA-256.  A value is copied if at least ``COPIED_OWNERS`` owners or
    ``COPIED_REPOS`` repositories have it, and live if it isn't copied and has one owner.  ``n_live``
    and ``n_copied`` count the candidates with such values.  ``added`` are the values of live base
    spans, as kind ``live``, and live bare tokens outside base spans.

    Null or empty text: no spans.  Null repositories and owners each count as one.  Repeated rows
    count once as repositories and get a result each; rows that share an id, null or not, with other
    texts are kept apart by a hash of the text.  Columns besides the four named ones are not read.
    """
    text = F.coalesce(F.col("lf_text"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("lf_id"), F.xxhash64(text_col).alias("lf_key"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("lf_repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("lf_owner"), F.col(text_col).alias("lf_text")
    )
    kinds = {f"lf_{k[0]}": _found(text, n, *k) for n, k in enumerate(KINDS)}
    base = rows.withColumns(kinds | {"lf_bare": _mixed(text)}).select("lf_id", "lf_key", "lf_repo", "lf_owner", F.concat(*kinds).alias("base"), "lf_bare")
    outside = F.filter("lf_bare", lambda b: ~F.exists("base", lambda s: (s["start"] <= b["start"]) & (b["end"] <= s["end"])))
    base = written(base.select("lf_id", "lf_key", "lf_repo", "lf_owner", "base", outside.alias("bare")), "secret-spans")

    each = base.select("lf_id", "lf_key", "lf_repo", "lf_owner", F.explode(F.concat("base", "bare")).alias("span"))
    owned = each.select(F.col("span.hash").alias("hash"), "lf_owner", "lf_repo").distinct()
    frequency = owned.groupBy("hash", "lf_owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))
    # as a table, so that the join's hot values can be split over tasks
    frequency = written(frequency, "secret-owners")
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS)
    judged = each.withColumn("hash", F.col("span.hash")).join(frequency, "hash").select("lf_id", "lf_key", F.struct("span.*", copied.alias("copied"), (~copied & (F.col("n_owners") == 1)).alias("live")).alias("span"))
    by_row = judged.groupBy("lf_id", "lf_key").agg(F.collect_set("span").alias("spans"))

    def marked(s: Column) -> Column:
        bare = s["kind"] == BARE[0]
        return F.struct(
            s["value_start"].alias("start"), F.when(bare, s["kind_no"]).otherwise(len(KINDS) + 1).alias("kind_no"), s["end"].alias("end"), F.when(bare, s["kind"]).otherwise(LIVE).alias("kind"), s["hash"].alias("hash"), s["value_start"].alias("value_start")
        )

    by_row = by_row.select(
        F.col("lf_id").alias("r_id"),
        F.col("lf_key").alias("r_key"),
        # kinds that overlap, such as an assigned hexadecimal value, have the same value
        F.array_distinct(F.transform(F.filter("spans", lambda s: s["live"]), marked)).alias("added"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["copied"])).cast("long").alias("n_copied"),
    )
    out = base.join(by_row, F.col("lf_id").eqNullSafe(F.col("r_id")) & (F.col("lf_key") == F.col("r_key")), "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("lf_id").alias(id_col), "base", F.coalesce("added", F.array().cast(_SPAN)).alias("added"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and spans by kind, with ownership.

    The table has no repository column, so each document stands for one; its source is the owner.
    """
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_string(F.col("base")), 256).alias("base_sha256"), _string(F.concat("base", "added")).alias("spans"), "n_live", "n_copied")


#: RE2 has no look-around and folds non-ASCII letters, so the SQL spells the letters out and filters bare tokens.
_SQL_ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _sql_kind(number: int, kind: str, pattern: str, group: int, least: int, more: str = "") -> str:
    return rf"""
  select doc_id, {number} as kind_no, '{kind}' as kind, source,
    length(v[i]) as vn,
    (list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0))::bigint as s, length(m[i]) as n, v[i] as value
  from (select *, unnest(range(1, len(m) + 1)) as i from (
    select doc_id, source, regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {group}) as v, string_split_regex(text, '{pattern}') as p
    from documents where text is not null))
  where length(v[i]) >= {least} {more}"""


OP2_SQL = rf"""
with base as ({" union all ".join(_sql_kind(n, k, _SQL_ASSIGN if k == "assign" else p, g, least) for n, (k, p, g, least) in enumerate(KINDS))}
), bare as ({_sql_kind(len(KINDS), *BARE, "and regexp_matches(v[i], '[0-9]') and regexp_matches(v[i], '[a-z]') and regexp_matches(v[i], '[A-Z]')")}
), outside as (
  select * from bare b where not exists (select 1 from base a where a.doc_id = b.doc_id and a.s <= b.s and b.s + b.n <= a.s + a.n)
), everything as (select * from base union all select * from outside),
owners as (select value, count(distinct coalesce(source, '')) as n_owners, count(distinct (coalesce(source, ''), doc_id)) as n_repos from everything group by value),
judged as (
  select e.*, n_owners >= {COPIED_OWNERS} or n_repos >= {COPIED_REPOS} as copied, n_owners = 1 and n_repos < {COPIED_REPOS} as live from everything e join owners using (value)
), spans as (
  select doc_id, kind, kind_no, s, s + n as e from judged where kind <> 'bare' or live
  union select doc_id, '{LIVE}', {len(KINDS) + 1}, s + n - vn, s + n from judged where kind <> 'bare' and live
), named as (select *, kind || ':' || s::varchar || ':' || e::varchar as span from spans
), by_span as (
  select doc_id, string_agg(span, ',' order by s, kind_no) filter (where kind_no < {len(KINDS)}) as base, string_agg(span, ',' order by s, kind_no) as spans from named group by doc_id
), by_kind as (
  select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
    count(*) filter (where live) as n_live, count(*) filter (where copied) as n_copied
  from judged group by doc_id
), by_doc as (select * from by_kind left join by_span using (doc_id))
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from documents left join by_doc using (doc_id)
"""
