"""Scores of evidence, alignments and gene structures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def grade_class(score: Column | str, bounds: Column | str) -> Column:
    """Number of bounds that are not greater than ``score``; bounds ascend."""
    return F.size(F.filter(_col(bounds), lambda b: _col(score) >= b))


def hint_bonus(bonus: Column | str, quotient: Column | str, mult: Column | str, general: Column | str, factor: float = 1.0) -> Column:
    """Bonus of a hint: ``bonus * quotient * factor``; where ``general`` holds, a hint of
    multiplicity m has ``min(b ** m, b * m)``."""
    b = _col(bonus) * _col(quotient) * factor
    m = _col(mult)
    return F.when(_col(general) & (m > 1), F.least(F.pow(b, m), b * m)).otherwise(b)


def conformance(support: Column | str, contradict: Column | str) -> Column:
    """``(5 + s) / (10 + s + k)``."""
    s, k = _col(support), _col(contradict)
    return (s + 5) / (s + k + 10)


def conformed_bonus(bonus: Column | str, support: Column | str, contradict: Column | str) -> Column:
    """``exp(ln(bonus) * 2 * conformance)``."""
    return F.exp(F.ln(_col(bonus)) * 2 * conformance(support, contradict))


def faded_bonus(bonus: Column | str, start: Column | str, end: Column | str, position: Column | str) -> Column:
    """The bonus where ``position`` is the middle of the hint, falling to 1 at its ends and outside."""
    s, e, p = _col(start), _col(end), _col(position)
    half = (e - s) / 2.0
    near = F.when(half > 0, 1 - F.abs(p - (s + e) / 2.0) / half).otherwise(F.when(p == s, 1.0).otherwise(0.0))
    return F.pow(_col(bonus), F.greatest(near, F.lit(0.0)))


def part_penalty(malus: Column | str, length: Column | str) -> Column:
    """Local penalty of a part feature: ``malus ** length``."""
    return F.pow(_col(malus), _col(length))


def transcript_score(avg_cds: Column | str, avg_intron: Column | str, avg_utr: Column | str) -> Column:
    """``(4 cds + 4 intron + utr) / 9``, missing parts counting 0."""
    zero = F.lit(0.0)
    return (4 * F.coalesce(_col(avg_cds), zero) + 4 * F.coalesce(_col(avg_intron), zero) + F.coalesce(_col(avg_utr), zero)) / 9


def logistic(features: list[Column | str], weights: list[float], intercept: float) -> Column:
    """Probability of a logistic model."""
    z = F.lit(intercept)
    for x, w in zip(features, weights, strict=True):
        z = z + _col(x) * w
    return 1 / (1 + F.exp(-z))


def f_score(sensitivity: Column | str, specificity: Column | str) -> Column:
    """Harmonic mean, 0 where both are 0."""
    a, b = _col(sensitivity), _col(specificity)
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def geometric_mean(probabilities: Column | str) -> Column:
    """Of an array of probabilities; 0 if one of them is 0, null if empty."""
    p = _col(probabilities)
    logs = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.when(x > 0, F.ln(x)).otherwise(F.lit(float("-inf"))))
    return F.when(F.size(p) > 0, F.exp(logs / F.size(p)))


def floor_mod(x: Column | str, m: int) -> Column:
    """Modulo with a result in ``0 .. m-1``."""
    return F.pmod(_col(x), F.lit(m))


def flipped(start: Column | str, end: Column | str, length: Column | str) -> tuple[Column, Column]:
    """0-based inclusive coordinates on the other strand of a sequence of ``length``."""
    return _col(length) - 1 - _col(end), _col(length) - 1 - _col(start)


def cigar_sum(cigar: Column | str, ops: str) -> Column:
    """Total length of the CIGAR operations in ``ops``."""
    found = F.regexp_extract_all(_col(cigar), F.lit(rf"(\d+)[{ops}]"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def exon_parts(start: Column | str, end: Column | str, parts: int = 5) -> Column:
    """An exon as ``parts`` equal sub-intervals (the last takes the rest)."""
    s, e = _col(start), _col(end)
    width = F.floor((e - s + 1) / parts).cast("long")
    return F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct((s + i * width).alias("start"), F.when(i == parts - 1, e).otherwise(s + (i + 1) * width - 1).alias("end"))),
        lambda x: x["start"] <= x["end"],
    )
