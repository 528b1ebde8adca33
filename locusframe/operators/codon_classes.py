"""Two classes of codon columns on one tree: fitted rate families, and the log ratio of each column.

A family is a codon model with its own selection, pace and codon frequencies (the bias of its class).
Columns of the same labels are one pattern, computed once.  Eigen systems are computed once for a family
and branch matrices once for a length, in each worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import Tree
from .phylo import CODONS, Pruner, _leaves, codon_matrix, pruned_likelihoods, summed_by

#: Values tried for selection and for pace, the stretch of all branches.
OMEGAS, PACES = (0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 1.5), (0.5, 1.0, 2.0)


@dataclass(frozen=True)
class Family:
    """Selection, transition bias, pace and codon frequencies."""

    omega: float
    kappa: float
    pace: float
    frequencies: tuple[float, ...]


@dataclass(frozen=True)
class TwoClasses:
    """Families of the two classes, and the log of their odds."""

    coding: Family
    other: Family
    odds: float


@lru_cache(maxsize=64)
def _eigen(omega: float, kappa: float, frequencies: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, f = codon_matrix(omega, kappa, np.array(frequencies))
    root = np.sqrt(f)
    values, vectors = np.linalg.eigh(q * root[:, None] / root[None, :])
    return values, vectors / root[:, None], vectors.T * root[None, :]


@lru_cache(maxsize=1024)
def branch_matrix(omega: float, kappa: float, frequencies: tuple[float, ...], time: float) -> np.ndarray:
    """Transition probabilities along a branch."""
    values, left, right = _eigen(omega, kappa, frequencies)
    return np.clip((left * np.exp(values * time)) @ right, 0, None)


def logliks(tree: Tree, family: Family, labels: np.ndarray) -> np.ndarray:
    """Log likelihood of each row of codon numbers (-1: missing)."""
    matrices = [branch_matrix(family.omega, family.kappa, family.frequencies, round(t * family.pace, 9)) for t in tree.length]
    return pruned_likelihoods(tree, matrices, np.array(family.frequencies), labels)


@lru_cache(maxsize=64)
def _pruner(parents: tuple[int, ...], lengths: tuple[float, ...], family: Family) -> Pruner:
    matrices = [branch_matrix(family.omega, family.kappa, family.frequencies, round(t * family.pace, 9)) for t in lengths]
    return Pruner(SimpleNamespace(parent=parents), matrices, np.array(family.frequencies))


def _values(tree: Tree, families: list[Family]) -> Callable[[np.ndarray], np.ndarray]:
    """Log likelihoods of label rows, a column for each family."""
    parents, lengths = tuple(tree.parent), tuple(tree.length)
    return lambda labels: np.column_stack([_pruner(parents, lengths, f)(labels) for f in families])


def _labels(patterns: pd.Series) -> np.ndarray:
    number = {c: i for i, c in enumerate(CODONS)}
    return np.array([[number.get(c.upper(), -1) for c in p.split(",")] for p in patterns], int).reshape(len(patterns), -1)


def pattern_logliks(patterns: DataFrame, tree: Tree, families: list[Family]) -> DataFrame:
    """``pattern, loglik array<double>`` by family for distinct ``pattern`` (codons of the leaves in order, comma-joined)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                labels = _labels(frame["pattern"])
                yield pd.DataFrame({"pattern": frame["pattern"], "loglik": np.array([logliks(tree, f, labels) for f in families]).T.tolist()})

    return patterns.select("pattern").where("pattern is not null").distinct().mapInPandas(run, "pattern string, loglik array<double>")


def codon_frequencies(columns: DataFrame, pseudo: float = 1.0) -> tuple[float, ...]:
    """Shares of the sense codons in all columns, with ``pseudo`` counts added: 61 rows reach the driver."""
    seen = columns.select(F.explode(F.split(F.upper("pattern"), ",")).alias("codon")).groupBy("codon").agg(F.count(F.lit(1)).alias("n"))
    n = {r["codon"]: r["n"] for r in seen.where(F.col("codon").isin(CODONS)).collect()}
    counts = np.array([n.get(c, 0) + pseudo for c in CODONS], float)
    return tuple((counts / counts.sum()).tolist())


def fitted_classes(columns: DataFrame, tree: Tree, kappa: float = 4.0, omegas: tuple[float, ...] = OMEGAS, paces: tuple[float, ...] = PACES) -> TwoClasses:
    """The most likely family of each class, of all pairs of selection and pace, from labelled columns (``pattern, coding`` boolean).

    Frequencies are those of the class.  A class without columns keeps even frequencies and no selection, and the odds are those of the
    columns, with one added to each class.  Of equal families the first is taken.
    """
    labelled, leaves = columns.where("coding is not null and pattern is not null"), len(_leaves(tree))
    totals = {r["coding"]: r["n"] for r in labelled.groupBy("coding").agg(F.count(F.lit(1)).alias("n")).collect()}
    best = {}
    for coding in (True, False):
        if not totals.get(coding):
            best[coding] = Family(1.0, kappa, 1.0, tuple([1 / len(CODONS)] * len(CODONS)))
            continue
        own = labelled.where(F.col("coding") == coding)
        frequencies = codon_frequencies(own)
        families = [Family(w, kappa, p, frequencies) for w in omegas for p in paces]
        sums = summed_by(own, "coding", leaves, [f"l{k}" for k in range(len(families))], _values(tree, families)).first()
        best[coding] = families[int(np.argmax([sums[f"l{k}"] for k in range(len(families))]))]
    odds = float(np.log((totals.get(True, 0) + 1) / (totals.get(False, 0) + 1)))
    return TwoClasses(best[True], best[False], odds)


def codon_ratios(columns: DataFrame, tree: Tree, model: TwoClasses) -> DataFrame:
    """``columns`` (with ``pattern``) and ``ratio``: the log likelihood under the coding family less that under the other."""
    found = pattern_logliks(columns, tree, [model.coding, model.other])
    return columns.join(found.select("pattern", (F.get("loglik", F.lit(0)) - F.get("loglik", F.lit(1))).alias("ratio")), "pattern", "left")


def exon_ratios(columns: DataFrame, tree: Tree, model: TwoClasses) -> DataFrame:
    """``exon, ratio, columns, coding``: the sum over an exon's columns, and whether it and the odds are for coding."""
    both = _values(tree, [model.coding, model.other])

    def ratio(labels: np.ndarray) -> np.ndarray:
        found = both(labels)
        return found[:, :1] - found[:, 1:]

    sums = summed_by(columns, "exon", len(_leaves(tree)), ["ratio"], ratio).withColumnRenamed("n", "columns")
    # columns without a pattern count, but have no ratio
    without = columns.where("pattern is null").groupBy("exon").agg(F.lit(None).cast("double").alias("ratio"), F.count(F.lit(1)).alias("columns"))
    sums = sums.select("exon", "ratio", "columns").unionByName(without).groupBy("exon").agg(F.sum("ratio").alias("ratio"), F.sum("columns").alias("columns"))
    return sums.select("exon", "ratio", "columns", (F.col("ratio") + model.odds > 0).alias("coding"))
