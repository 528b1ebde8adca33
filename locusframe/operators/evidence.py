"""Evidence hints: parsing of attributes, collapsing, compatibility, groups and conformance.

A hint table has ``seq, source, type, start, end, score, strand, frame`` and, once parsed, ``grp,
priority, mult, esource``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import grade_class
from ..tables import written
from .intervals import BIN, overlap_join

#: The hint types in their order, which has a meaning, and short names of some.
TYPES = (
    "start", "stop", "ass", "dss", "tss", "tts", "exonpart", "exon", "intronpart", "intron", "irpart", "CDS", "CDSpart", "UTR", "UTRpart", "nonexonpart", "nonirpart",
)
ALIASES = {"ep": "exonpart", "ip": "intronpart", "cp": "CDSpart", "up": "UTRpart", "nep": "nonexonpart", "genicpart": "nonirpart"}
SIGNALS = ("start", "stop", "ass", "dss", "tss", "tts")
#: Margin of UTR ends, and distances up to which two tts or tss hints exclude each other.
UTR_MARGIN, TTS_DISTANCE, TSS_DISTANCE = 50, 1000, 0
MAX_CONTRADICTION = 9.0
MAX_GENIC_GAP = 500_000


def type_name(kind: Column | str) -> Column:
    """The full name of a hint type; null for an unknown one."""
    c = F.col(kind) if isinstance(kind, str) else kind
    names = F.create_map(*[F.lit(x) for k, v in ({t: t for t in TYPES} | ALIASES).items() for x in (k, v)])
    return F.try_element_at(names, c)


def type_id(kind: Column) -> Column:
    """Place of a full type name in the order of types; -1 for an unknown one."""
    return (F.array_position(F.array(*[F.lit(t) for t in TYPES]), kind) - 1).cast("int")


def parsed(hints: DataFrame, attributes: str = "attributes") -> DataFrame:
    """``hints`` with ``grp, priority, mult, esource`` from the attribute column and the full ``type``.

    The group is that of ``group=`` before ``grp=``, the priority of ``priority=`` before ``pri=``
    (-1 without), multiplicity 1 without ``mult=``, the source letters of ``source=`` before ``src=``.
    """
    a = F.coalesce(F.col(attributes), F.lit(""))
    pick = lambda *keys: reduce(lambda x, y: F.coalesce(x, y), [F.nullif(F.regexp_extract(a, rf"{k}=([^;]*)", 1), F.lit("")) for k in keys])
    return hints.withColumns(
        {
            "type": type_name("type"),
            "grp": pick("group", "grp"),
            "priority": F.coalesce(F.regexp_extract(pick("priority", "pri"), r"^\s*(-?\d+)", 1).try_cast("int"), F.lit(-1)),
            "mult": F.coalesce(F.nullif(F.regexp_extract(a, r"mult=(\d+)", 1), F.lit("")).cast("int"), F.lit(1)),
            "esource": reduce(lambda x, y: F.coalesce(x, y), [F.nullif(F.regexp_extract(a, rf"{k}=([A-Za-z]+)", 1), F.lit("")) for k in ("source", "src")]),
        }
    )


def collapsed(hints: DataFrame) -> DataFrame:
    """Hints equal in place, type, strand, frame and first letter of the source as one.

    Their multiplicities add up (1 where missing) and become the score; a hint alone keeps its own.
    """
    key = ["seq", "type", "start", "end", "strand", "frame", F.substring(F.coalesce("esource", F.lit("")), F.lit(1), F.lit(1)).alias("src1")]
    return hints.groupBy(*key).agg(
        F.sum(F.coalesce("mult", F.lit(1))).cast("long").alias("mult"),
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) > 1, F.sum(F.coalesce("mult", F.lit(1))).cast("double")).otherwise(F.max("score")).alias("score"),
        F.min("source").alias("source"),
    )


def union_distinct(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """All hints, of those equal in ``key`` the one of the first table."""
    stacked = reduce(DataFrame.unionByName, [t.withColumn("_file", F.lit(i)) for i, t in enumerate(tables)])
    rest = [c for c in tables[0].columns if c not in key]
    first = F.min(F.struct("_file", *rest)).alias("_first")
    return stacked.groupBy(*key).agg(first).select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def _strands_differ(a: Column, b: Column) -> Column:
    return ((a == "+") & (b == "-")) | ((a == "-") & (b == "+"))


def compatible(t1: Column, s1: Column, e1: Column, st1: Column, t2: Column, s2: Column, e2: Column, st2: Column, own: Column | None = None) -> Column:
    """Whether a gene structure can agree with both hints; the first has the smaller type index.

    ``own`` is the strand of the hint that asks, which decides at what end a signal belongs: by default
    that of the first.  It matters only where one of the two has no strand.
    """
    middle = F.floor(F.abs((e1 + s1) - (e2 + s2)) / 2)
    near = F.when(t1 == "tts", middle <= TTS_DISTANCE).when(t1 == "tss", middle <= TSS_DISTANCE).otherwise(False)
    apart = ~((t1 == t2) & (st1 == st2) & near)
    met = _compatible(_rule_of(type_id(t1), type_id(t2), t1 == t2), type_id(t1), s1, e1, st1, type_id(t2), s2, e2, st2, st1 if own is None else own)
    return F.when((s1 <= e2) & (s2 <= e1), met).otherwise(apart)


def _rule(p: str, q: str) -> str:
    """The name of the rule for overlapping hints of types ``p`` and ``q`` on one strand, ``p`` not after ``q`` in their order."""
    if p == q:
        return "equal" if p in ("exon", "intron", "CDS", "UTR") else "yes"
    if p in ("start", "stop"):
        if q in ("intronpart", "intron", "irpart", "nonexonpart", "UTR", "UTRpart"):
            return "out"
        return {"CDS": "codon", "CDSpart": "end"}.get(q, "yes")
    if p in ("ass", "dss"):
        return "out" if q in ("irpart", "UTR", "UTRpart", "exonpart", "exon", "CDS", "CDSpart") else "end" if q in ("intron", "intronpart") else "yes"
    if p in ("tss", "tts"):
        return "out" if q in ("irpart", "intron", "intronpart", "nonexonpart", "CDS", "CDSpart") else "margin" if q in ("UTR", "UTRpart", "exon", "exonpart") else "yes"
    if p in ("exonpart", "exon") and q in ("intronpart", "intron", "irpart", "nonexonpart"):
        return "no"
    if p == "exonpart":
        return {"exon": "inside", "UTR": "bare"}.get(q, "yes")
    if p == "exon":
        return "contains" if q in ("CDS", "CDSpart", "UTRpart") else "side" if q == "UTR" else "yes"
    if p in ("intronpart", "intron"):
        return "inside" if q == "intron" else "no" if q in ("irpart", "CDS", "CDSpart", "UTR", "UTRpart") else "yes"
    if p == "irpart":
        return "yes" if q == "nonexonpart" else "no"
    return "contains" if (p, q) in (("CDS", "CDSpart"), ("UTR", "UTRpart")) else "no"


_RULES = ("no", "yes", "equal", "out", "inside", "contains", "end", "codon", "margin", "bare", "side")


def _rule_of(i1: Column, i2: Column, same: Column) -> Column:
    """The place in ``_RULES`` for two type ids, the smaller first: one look-up in a fixed table.  Unknown types agree with themselves alone."""
    codes = F.array(*[F.lit(_RULES.index(_rule(p, q))) for p in TYPES for q in TYPES])
    return F.coalesce(F.get(codes, F.when((i1 >= 0) & (i2 >= 0), i1 * len(TYPES) + i2)), F.when(same, 1).otherwise(0))


def _compatible(rule: Column, i1: Column, s1: Column, e1: Column, st1: Column, i2: Column, s2: Column, e2: Column, st2: Column, own: Column) -> Column:
    """:func:`compatible` of hints that overlap, by type ids and the pair's rule (:func:`_rule_of`)."""
    inside = (s2 <= s1) & (e1 <= e2)
    strict = (s2 < s1) & (e1 < e2)
    contains = (s1 <= s2) & (e2 <= e1)
    signals = [i.between(0, len(SIGNALS) - 1) for i in (i1, i2)]
    opposite = (signals[0] & signals[1]) | (signals[0] & ~inside) | (signals[1] & ~contains)

    # start, dss and tss on + stand at the left end of what they belong to, the others at the right; on - the other way round
    left = i1.isin(*[TYPES.index(t) for t in ("start", "dss", "tss")]) == (own == "+")
    known = own.isin("+", "-")
    off = strict | F.when(known, F.when(left, s1 > s2).otherwise(e1 < e2)).otherwise(False)
    short = (e1 < s2 + 2) | (s1 > e2 - 2)
    to_left, to_right = F.greatest(s1 - s2, s2 - e1) <= UTR_MARGIN, F.greatest(e2 - e1, s1 - e2) <= UTR_MARGIN
    tests = {
        "no": F.lit(False), "yes": F.lit(True), "equal": (s1 == s2) & (e1 == e2), "out": ~inside, "inside": inside, "contains": contains, "end": ~off, "codon": ~(off | short),
        "margin": F.when(known, F.when(left, to_left).otherwise(to_right)).otherwise(to_left | to_right), "bare": ~((s1 < s2) & (e1 > e2)), "side": ((s1 == s2) & (e1 >= e2)) | ((e1 == e2) & (s1 <= e2)),
    }
    out = F.when(_strands_differ(st1, st2), opposite)
    for k, name in enumerate(_RULES):
        out = out.when(rule == k, tests[name])
    return out.otherwise(False)


def weaker(t1: Column, s1: Column, e1: Column, t2: Column, s2: Column, e2: Column) -> Column:
    """Whether every structure that agrees with the second hint agrees with the first."""
    overlap = (s1 <= e2) & (s2 <= e1)
    inside, contains, equal = (s2 <= s1) & (e1 <= e2), (s1 <= s2) & (e2 <= e1), (s1 == s2) & (e1 == e2)
    hosts = {"exonpart": ("exon", "exonpart"), "intronpart": ("intron", "intronpart"), "irpart": ("irpart",), "CDSpart": ("CDS", "CDSpart"), "UTRpart": ("UTR", "UTRpart"), "nonexonpart": ("nonexonpart",)}
    rule = F.when((t1 == t2) & equal, True).when(t1.isin(*SIGNALS), (t1 == t2) & contains)
    for part, whole in hosts.items():
        rule = rule.when(t1 == part, t2.isin(*whole) & inside)
    return overlap & rule.when(t1 == "nonirpart", (t2 != "irpart") & inside).otherwise(False)


#: What a hint needs to be weaker than one of the second type: nothing will do, equal, around it, or inside it.
_WEAKER = ("no", "equal", "contains", "inside")


def _weaker_rule(p: str, q: str) -> str:
    """The name in ``_WEAKER`` for a hint of type ``p`` against one of type ``q``."""
    if p in SIGNALS:
        return "contains" if p == q else "no"
    if p == "nonirpart":
        return "no" if q == "irpart" else "inside"
    if p.endswith("part") and q in (p, p.removesuffix("part")) and not (p == "irpart" and q != p) and not (p == "nonexonpart" and q != p):
        return "inside"
    return "equal" if p == q else "no"


def _weaker(i1: Column, s1: Column, e1: Column, i2: Column, s2: Column, e2: Column, same: Column) -> Column:
    """:func:`weaker` of hints that overlap, by type ids (-1 for unknown types, which ``same`` compares): one look-up in a fixed table."""
    codes = F.array(*[F.lit(_WEAKER.index(_weaker_rule(p, q))) for p in TYPES for q in TYPES])
    unknown = F.when(i1 == TYPES.index("nonirpart"), 3).when(same, 1).otherwise(0)
    rule = F.when((i1 >= 0) & (i2 >= 0), F.get(codes, i1 * len(TYPES) + i2)).otherwise(unknown)
    return F.when(rule == 1, (s1 == s2) & (e1 == e2)).when(rule == 2, (s1 <= s2) & (e2 <= e1)).when(rule == 3, (s2 <= s1) & (e1 <= e2)).otherwise(False)


def _close_ends(hints: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of transcript end hints of one type and strand with near middles and no overlap, as an overlap join gives them."""
    reach = max(TTS_DISTANCE, TSS_DISTANCE) + 1
    side = lambda df: df.where(F.col("type").isin("tss", "tts")).withColumn("_cell", F.floor((F.col("start") + F.col("end")) / (2 * reach)))
    a = side(hints).withColumn("_cell", F.explode(F.array(*[F.col("_cell") + d for d in (-1, 0, 1)])))
    b = side(other).select(F.col("seq"), "_cell", *[F.col(c).alias(c + "_r") for c in other.columns if c != "seq"])
    middle = F.floor(F.abs(F.col("start") + F.col("end") - F.col("start_r") - F.col("end_r")) / 2)
    near = middle <= F.when(F.col("type") == "tts", TTS_DISTANCE).otherwise(TSS_DISTANCE)
    apart = (F.col("start") > F.col("end_r")) | (F.col("start_r") > F.col("end"))
    return a.join(b, ["seq", "_cell"]).where((F.col("type") == F.col("type_r")) & (F.col("strand") == F.col("strand_r")) & near & apart).drop("_cell")


def hint_pairs(hints: DataFrame, other: DataFrame | None = None, width: int = BIN, apart: bool = True) -> DataFrame:
    """Pairs of hints that can bear on each other, with ``compatible``, ``weaker`` (first than second) and ``strict``.

    These are the overlapping ones, and with ``apart`` tss or tts hints of one strand that are close without overlap.
    """
    other = hints if other is None else other
    # types are numbered once a hint, so that a pair compares numbers and looks its rule up
    numbered = lambda df: df.withColumn("_tid", type_id(F.col("type")))
    met = overlap_join(numbered(hints), numbered(other), ("seq",), width)
    c = F.col
    x, y = ("_tid", "start", "end", "strand"), ("_tid_r", "start_r", "end_r", "strand_r")
    # the pair in the order of types, as columns, so that the rules stand in the plan once; they are looked up by numbers, because
    # the code that Spark makes of a pair's rules is interpreted, not compiled, from 8000 bytes on
    first = c("_tid") <= c("_tid_r")
    ordered = {f"_a_{k}": F.when(first, c(k)).otherwise(c(r)) for k, r in zip(x, y, strict=True)} | {f"_b_{k}": F.when(first, c(r)).otherwise(c(k)) for k, r in zip(x, y, strict=True)}
    ordered["_rule"] = _rule_of(F.least("_tid", "_tid_r"), F.greatest("_tid", "_tid_r"), c("type") == c("type_r"))
    strict = ~((c("start") == c("start_r")) & (c("end") == c("end_r")))
    fits = _compatible(c("_rule"), *[c(k) for k in ordered if k != "_rule"], own=c("strand"))
    out = met.withColumns(ordered).withColumns({"compatible": fits, "weaker": _weaker(c("_tid"), c("start"), c("end"), c("_tid_r"), c("start_r"), c("end_r"), c("type") == c("type_r")), "strict": strict})
    out = out.drop(*ordered, "_tid", "_tid_r")
    if apart:
        # transcript ends that are close without overlap never agree
        out = out.unionByName(_close_ends(hints, other).withColumns({"compatible": F.lit(False), "weaker": F.lit(False), "strict": F.lit(True)}))
    return out


def grouped(hints: DataFrame, key: str = "hint_id") -> DataFrame:
    """``hints`` with ``gid``: the named group on the sequence, or the hint itself where unnamed."""
    named = F.nullif(F.coalesce("grp", F.lit("")), F.lit(""))
    return hints.withColumn("gid", F.coalesce(F.concat(F.lit("g:"), named), F.concat(F.lit("h:"), F.col(key).cast("string"))))


def group_ranges(hints: DataFrame) -> DataFrame:
    """``seq, gid, start, end, n, mult, priority`` of the groups."""
    return hints.groupBy("seq", "gid").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.sum("mult").cast("long").alias("mult"), F.max("priority").alias("priority"))


def group_relations(hints: DataFrame, key: str = "hint_id", width: int = BIN) -> DataFrame:
    """For overlapping groups: ``compatible`` (all pairs of hints are) and ``weaker``.

    The first group is weaker if each of its hints is weaker than one of the second, and one of them
    strictly or the second has a hint beyond the first's range.  Groups of one hint are compared where they
    meet; only pairs with a larger group are gathered from pairs of hints.
    """
    own = Window.partitionBy("seq", "gid")
    rows = written(hints.select("seq", "gid", key, "type", "start", "end", "strand").withColumn("_n", F.count(F.lit(1)).over(own)), "groups-hints")
    # the hints of larger groups as a table of their own: where it is small it is broadcast, and the others stay where they are
    one, more = rows.where("_n = 1").drop("_n"), written(rows.where("_n > 1").drop("_n"), "groups-larger")
    beyond = (F.col("start_r") < F.col("start")) | (F.col("end_r") > F.col("end"))
    relation = lambda fits, under: ("seq", "gid", "gid_r", F.coalesce(fits, F.lit(True)).alias("compatible"), F.coalesce(under, F.lit(False)).alias("weaker"))
    alone = hint_pairs(one, None, width, apart=False).where("gid <> gid_r").select(*relation(F.col("compatible"), F.col("weaker") & (F.col("strict") | beyond)))

    small = one.select("seq", "gid", "start", "end", F.lit(1).cast("long").alias("n"))
    large = written(more.groupBy("seq", "gid").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")), "groups-ranges")
    pairs = overlap_join(large, small.unionByName(large), ("seq",), width).unionByName(overlap_join(small, large, ("seq",), width)).where("gid <> gid_r")
    met = hint_pairs(more, rows.drop("_n"), width).unionByName(hint_pairs(one, more, width)).where("gid <> gid_r")
    by_hint = met.groupBy("seq", "gid", "gid_r", key).agg(F.every("compatible").alias("fits"), F.max(F.col("weaker").cast("int")).alias("under"), F.max((F.col("weaker") & F.col("strict")).cast("int")).alias("strictly"))
    by_group = by_hint.groupBy("seq", "gid", "gid_r").agg(F.every("fits").alias("fits"), F.sum("under").alias("under"), F.max("strictly").alias("strictly"))
    gathered = pairs.join(by_group, ["seq", "gid", "gid_r"], "left")
    return alone.unionByName(gathered.select(*relation(F.col("fits"), (F.col("under") == F.col("n")) & ((F.col("strictly") == 1) | beyond))))


def conformance_counts(hints: DataFrame, key: str = "hint_id", width: int = BIN) -> DataFrame:
    """For each hint: ``support`` and ``contradict``, summed over the other groups that it meets.

    A group with a hint that this one is weaker than supports it; a group with an incompatible hint
    contradicts it unless its known priority is lower.  An intron that only parts contradict counts
    with the share of it they cover.
    """
    met = hint_pairs(hints.select("seq", "gid", key, "type", "start", "end", "strand", "priority"), None, width).where("gid <> gid_r")
    lower = (F.col("priority") >= 0) & (F.col("priority_r") >= 0) & (F.col("priority_r") < F.col("priority"))
    part = F.col("type_r").endswith("part")
    length = F.least(F.greatest(F.col("end") - F.col("start") + 1, F.lit(1)), F.lit(2000))
    share = F.when((F.col("type") == "intron") & part, F.least(F.col("end_r") - F.col("start_r") + 1, length) / length).otherwise(1.0)
    bad = ~F.col("compatible") & ~lower
    # a hint's groups are sets of numbers in one row, so a pair is shuffled once, as a number, and pairs that do neither not at all
    group = F.xxhash64("gid_r")
    named = lambda test, value: F.collect_set(F.when(test, value))
    sets = met.groupBy(key).agg(named(F.col("weaker"), group).alias("for"), named(bad & (share >= 1.0), group).alias("against"), named(bad & (share < 1.0), F.struct(group.alias("g"), share.alias("share"))).alias("parts"))
    # of the parts of a group the largest counts, the last of it in order, unless all of it is against the hint
    parts = sets.withColumn("parts", F.array_sort(F.filter("parts", lambda x: ~F.array_contains("against", x["g"]))))
    largest = F.filter("parts", lambda x, i: F.coalesce(F.get("parts", i + 1)["g"] != x["g"], F.lit(True)))
    total = F.size("against") + F.aggregate(largest, F.lit(0.0), lambda a, x: a + x["share"])
    return parts.select(key, F.size("for").cast("long").alias("support"), total.alias("contradict"))


def trashy_groups(hints: DataFrame, limit: float = MAX_CONTRADICTION) -> DataFrame:
    """Groups of which a hint has ``contradict / (support + 1)`` of at least ``limit``."""
    return hints.groupBy("seq", "gid").agg(F.max(F.col("contradict") / (F.col("support") + 1)).alias("ratio")).where(F.col("ratio") >= limit)


def can_alternate(hints: DataFrame, types: list[str]) -> DataFrame:
    """Groups that may cause alternative transcripts: with a hint of one of ``types``."""
    return hints.groupBy("seq", "gid").agg(F.max(F.col("type").isin(types).cast("int")).alias("any")).where("any = 1").drop("any")


def equal_groups(hints: DataFrame) -> DataFrame:
    """Groups with the same hints as one, the least id, with ``copies``."""
    own = F.array_sort(F.collect_list(F.struct("start", "end", "type", "strand", "frame")))
    return hints.groupBy("seq", "gid").agg(own.alias("_own")).groupBy("seq", "_own").agg(F.min("gid").alias("gid"), F.count(F.lit(1)).alias("copies")).drop("_own")


def genic_gaps(hints: DataFrame, most: int = MAX_GENIC_GAP) -> DataFrame:
    """Gaps of 1 to ``most`` bases between the hints of a group: ``seq, gid, start, end``."""
    by = Window.partitionBy("seq", "gid").orderBy("start", "end")
    seen = hints.withColumn("_reach", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    size = F.col("start") - F.col("_reach") - 1
    return seen.where(size.between(1, most)).select("seq", "gid", (F.col("_reach") + 1).alias("gap_start"), (F.col("start") - 1).alias("gap_end")).withColumnsRenamed({"gap_start": "start", "gap_end": "end"})


def in_region(hints: DataFrame, regions: DataFrame, mode: str = "overlap", width: int = BIN) -> DataFrame:
    """Hints of each region (``seq, start, end`` and an id): those that overlap it, or with
    ``mode="end_in_range"`` those that end in it."""
    met = overlap_join(hints, regions, ("seq",), width)
    return met if mode == "overlap" else met.where(F.col("end").between(F.col("start_r"), F.col("end_r")))


def frame_congruent(start: Column, end: Column, frame: Column, strand: Column, relative: Column) -> Column:
    """Whether a hint's reading frame agrees with a position of frame 0."""
    known = frame.isin("0", "1", "2")
    f = F.when(known, frame.cast("int")).otherwise(0)
    return ~known | F.when(strand == "-", F.pmod(end - f - relative, F.lit(3)) == 0).otherwise(F.pmod(start + f - relative, F.lit(3)) == 0)


def splice_filtered(introns: DataFrame, sequences: DataFrame, patterns: tuple[str, ...] = ("GTAG",)) -> DataFrame:
    """Introns whose ends have an allowed motif, with ``strand`` as the motif says.

    ``sequences`` are whole texts or chunks: only the four bases at an intron's ends are fetched (``sequences.fetched``).
    """
    from ..functions.sequence import motif_strand
    from .sequences import fetched

    ends = fetched(introns, sequences, {"_a": (F.col("start"), F.col("start") + 1), "_z": (F.col("end") - 1, F.col("end"))})
    found = ends.withColumn("strand", motif_strand(F.upper(F.concat("_a", "_z")), patterns))
    return found.where("strand is not null").select(*introns.columns, *([] if "strand" in introns.columns else ["strand"]))


def attach_hints(features: DataFrame, hints: DataFrame) -> DataFrame:
    """Hints onto features of equal place, type and strand; hints without one become features."""
    key = ["seq", "type", "start", "end", "strand"]
    best = hints.groupBy(*key).agg(F.sum("mult").cast("long").alias("mult"), F.array_join(F.array_sort(F.collect_set("esource")), ",").alias("sources"))
    out = features.join(best, key, "full_outer")
    return out.withColumn("has_feature", F.col("feature_id").isNotNull())


#: Bases of a hint that is read whole where its consistency with a sequence is tested.
NEAR_BASES = 64
#: Fixed value: what of a signal hint's bases is mandatory, as read on its strand.
SIGNAL_BASES = {"start": ("ATG",), "stop": ("TAA", "TAG", "TGA"), "dss": ("GT", "GC"), "ass": ("AG",)}


def consistent_with_sequence(hints: DataFrame, sequences: DataFrame) -> DataFrame:
    """``hints`` with ``consistent``: signals have their bases, introns their splice sites; null if the
    type has no such rule.  Without a strand either strand will do.

    ``sequences`` are whole texts or chunks: only signals and the ends of introns are fetched (``sequences.fetched``).
    Hints of unknown sequences are dropped.
    """
    from ..functions.sequence import reverse_complement
    from .sequences import fetched, fetched_near

    start, end = F.col("start"), F.col("end")
    short = end - start < 3
    none = F.lit(0).cast("long")
    intron = F.col("type") == "intron"
    at = lambda test, c: F.when(test, c)
    spans = {"_own": (at(short & ~intron, start), F.when(short & ~intron, end).otherwise(none)), "_a": (at(intron, start), at(intron, start + 1)), "_z": (at(intron, end - 1), at(intron, end))}
    # hints of some bases are read whole, from one place; those of whole texts only, which can be cut with a margin
    near = F.coalesce((start >= 1) & (end > start) & (end - start < NEAR_BASES), F.lit(False)) & F.lit("offset" not in sequences.columns)
    far = hints.where(~near)
    rows = None if "offset" not in sequences.columns and far.isEmpty() else fetched(far, sequences, spans)
    if "offset" not in sequences.columns:
        last = F.substring("_text", (end - start).cast("int"), F.lit(2))
        cut = fetched_near(hints.where(near), sequences, "_text", margin=NEAR_BASES)
        cut = cut.select(*hints.columns, at(short & ~intron, F.col("_text")).alias("_own"), at(intron, F.substring("_text", 1, 2)).alias("_a"), at(intron, last).alias("_z"))
        cut = cut.fillna("", ["_own", "_a", "_z"])
        rows = cut if rows is None else cut.unionByName(rows.select(*cut.columns))
    own, motif = F.upper("_own"), F.upper(F.concat("_a", "_z"))

    def on(text: Column, wanted: tuple[str, ...]) -> Column:
        plus, minus = text.isin(*wanted), reverse_complement(text).isin(*wanted)
        return F.when(F.col("strand") == "+", plus).when(F.col("strand") == "-", minus).otherwise(plus | minus)

    rule = F.when(intron, on(motif, ("GTAG", "GCAG", "ATAC")))
    for kind, wanted in SIGNAL_BASES.items():
        rule = rule.when(F.col("type") == kind, on(own, wanted))
    return rows.withColumn("consistent", rule).select(*hints.columns, "consistent")


def hinted_splice_sites(introns: DataFrame) -> DataFrame:
    """``seq, type, start, end, strand, mult``: the splice sites that intron hints imply, collapsed."""
    left = F.struct(F.when(F.col("strand") == "-", "ass").otherwise("dss").alias("type"), (F.col("start") - 1).alias("start"))
    right = F.struct(F.when(F.col("strand") == "-", "dss").otherwise("ass").alias("type"), (F.col("end") + 1).alias("start"))
    rows = introns.where("strand in ('+', '-')").select("seq", "strand", "mult", F.explode(F.array(left, right)).alias("s"))
    return rows.groupBy("seq", "s.type", "s.start", "strand").agg(F.sum("mult").cast("long").alias("mult")).withColumn("end", F.col("start"))


def in_order(hints: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """``hints`` with ``place``, from 1: their order along a sequence by end, start, strand, frame and source, then ``ties``.

    A sequence is in one window, sorted and numbered with spilling, so a place needs no collected group.
    """
    by = Window.partitionBy("seq").orderBy("end", "start", "strand", "frame", "source", *ties)
    return hints.withColumn("place", F.row_number().over(by).cast("long"))


def configured(hints: DataFrame, config: DataFrame) -> DataFrame:
    """``hints`` (``type, source, score`` and others) with ``bonus, malus, local_malus, quotient, grade``, as a configuration weighs them.

    ``config`` is what ``read_config`` gives: for each type and source the bounds between grades and a factor for each.
    The grade is the number of bounds that the score reaches; a hint without a score has the grade 0.  Hints of a type
    or source that the configuration doesn't name are dropped.  The configuration is a row for each type and source, by its format, and
    is joined like any table.
    """
    rows = hints.join(config, ["type", "source"])
    grade = grade_class("score", "bounds")
    return rows.withColumns({"grade": grade, "quotient": F.coalesce(F.get("quots", grade), F.lit(1.0))}).drop("bounds", "quots")
