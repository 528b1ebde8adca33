"""Evolution along a tree: likelihoods, parsimony and codon selection, for many columns at once.

A tree is small and goes to the tasks as it is; columns are rows with a label for each leaf.  Equal
label patterns are computed once and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import codon_table
from ..sources.readers import Tree


def rate_matrix(exchange: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """A reversible rate matrix with one expected change in a unit of time."""
    q = exchange * frequencies[None, :]
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(axis=1))
    return q / -(frequencies * np.diag(q)).sum()


def transition(q: np.ndarray, frequencies: np.ndarray, time: float) -> np.ndarray:
    """``exp(q time)`` of a reversible matrix, by the eigenvalues of its symmetric form."""
    root = np.sqrt(frequencies)
    values, vectors = np.linalg.eigh(q * root[:, None] / root[None, :])
    return np.clip((vectors * np.exp(values * time)) @ vectors.T / root[:, None] * root[None, :], 0, None)


def codon_matrix(omega: float, kappa: float, frequencies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rates between the 61 sense codons, of single changes only: ``kappa`` for transitions, ``omega`` if the amino acid changes."""
    code = {c: a for c, a in codon_table().items() if a != "*"}
    codons = sorted(code)
    f = np.full(len(codons), 1 / len(codons)) if frequencies is None else frequencies
    rates = np.zeros((len(codons), len(codons)))
    for i, a in enumerate(codons):
        for j, b in enumerate(codons):
            changes = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
            if len(changes) == 1:
                rates[i, j] = (kappa if set(changes[0]) in ({"A", "G"}, {"C", "T"}) else 1.0) * (omega if code[a] != code[b] else 1.0)
    return rate_matrix(rates, f), f


def _leaves(tree: Tree) -> list[int]:
    inner = set(tree.parent)
    return [i for i in range(len(tree.parent)) if i not in inner]


def pruned_likelihoods(tree: Tree, matrices: list[np.ndarray], frequencies: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Log likelihood of each row of ``labels`` (columns x leaves, -1: missing), by pruning from the leaves.

    ``matrices``: one transition matrix for each node's branch.
    """
    n, states = len(labels), len(frequencies)
    below = np.ones((len(tree.parent), n, states))
    scale = np.zeros(n)
    for k, leaf in enumerate(_leaves(tree)):
        known = labels[:, k] >= 0
        below[leaf][known] = np.eye(states)[labels[known, k]]
    for node in range(len(tree.parent) - 1, 0, -1):
        up = below[node] @ matrices[node].T
        top = up.max(axis=1)
        top[top == 0] = 1
        below[tree.parent[node]] *= up / top[:, None]
        scale += np.log(top)
    with np.errstate(divide="ignore"):
        return np.log(below[0] @ frequencies) + scale


class Pruner:
    """:func:`pruned_likelihoods` with what comes up from one leaf, or from two leaves beside each other, in tables by label."""

    def __init__(self, tree: Tree, matrices: list[np.ndarray], frequencies: np.ndarray) -> None:
        self.matrices, self.frequencies, self.states = matrices, frequencies, len(frequencies)
        self.children: dict[int, list[int]] = {}
        for node in range(1, len(tree.parent)):
            self.children.setdefault(tree.parent[node], []).append(node)
        self.column = {leaf: k for k, leaf in enumerate(_leaves(tree))}
        # the last label stands for a missing one
        one = np.vstack([np.eye(self.states), np.ones(self.states)])
        self.tables = {leaf: self._up(leaf, one, np.zeros(len(one))) for leaf in self.column if leaf}
        for node, below in self.children.items():
            if node and len(below) == 2 and all(c in self.column for c in below):
                (a, x), (b, y) = (self.tables[c] for c in below)
                self.tables[node] = self._up(node, (a[:, None] * b[None, :]).reshape(-1, self.states), (x[:, None] + y[None, :]).ravel())

    def _up(self, node: int, below: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up = below @ self.matrices[node].T
        top = up.max(axis=1)
        top[top == 0] = 1
        return up / top[:, None], scale + np.log(top)

    def _message(self, node: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if node in self.column:
            code = labels[:, self.column[node]]
        elif node in self.tables:
            a, b = (labels[:, self.column[c]] for c in self.children[node])
            code = a * (self.states + 1) + b
        else:
            return self._up(node, *self._product(node, labels))
        table, scale = self.tables[node]
        return table[code], scale[code]

    def _product(self, node: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        below, scale = np.ones((len(labels), self.states)), np.zeros(len(labels))
        for child in self.children[node]:
            up, more = self._message(child, labels)
            below *= up
            scale += more
        return below, scale

    def __call__(self, labels: np.ndarray) -> np.ndarray:
        below, scale = self._product(0, np.where(labels < 0, self.states, labels))
        with np.errstate(divide="ignore"):
            return np.log(below @ self.frequencies) + scale


#: Fixed value: the sense codons in their order.
CODONS = sorted(c for c, a in codon_table().items() if a != "*")
_BASE = np.full(256, 4)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _BASE[[ord(_pair[0]), ord(_pair[1])]] = _i
_NUMBER = np.full(125, -1)
for _i, _c in enumerate(CODONS):
    _NUMBER[_BASE[ord(_c[0])] * 25 + _BASE[ord(_c[1])] * 5 + _BASE[ord(_c[2])]] = _i


def codon_labels(patterns: pa.Array, leaves: int) -> np.ndarray:
    """Numbers of the sense codons of comma-joined columns, -1 for all else; patterns aren't null."""
    n, size = len(patterns), 4 * leaves - 1
    if not n:
        return np.zeros((0, leaves), int)
    data = np.frombuffer(patterns.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(patterns.buffers()[1], np.int32)[patterns.offset : patterns.offset + n + 1]
    if (np.diff(ends) == size).all():
        cells = data[ends[0] : ends[-1]].reshape(n, size)
        if (cells[:, 3::4] == ord(",")).all():
            x = _BASE[cells]
            return _NUMBER[x[:, 0::4] * 25 + x[:, 1::4] * 5 + x[:, 2::4]]
    number = {c: i for i, c in enumerate(CODONS)}
    return np.array([[number.get(c.upper(), -1) for c in p.split(",")] for p in patterns.to_pylist()], int).reshape(n, -1)


def distinct_labels(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and for each row the place of its own among them."""
    if labels.shape[1] > 10:
        rows, place = np.unique(labels, axis=0, return_inverse=True)
        return rows, place.ravel()
    code = np.zeros(len(labels), np.int64)
    for column in labels.T:
        code = code * (len(CODONS) + 1) + column + 1
    _, first, place = np.unique(code, return_index=True, return_inverse=True)
    return labels[first], place.ravel()


def summed_by(columns: DataFrame, by: str, leaves: int, names: list[str], values: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``by, n`` and ``names``: sums over the codon columns (``pattern``) of each value of ``by``.

    ``values`` gives numbers, a row for each of some label rows and a column for each name.  Columns are summed where they stand,
    so what is shuffled is a row for each key and batch.  Null patterns have no values and aren't counted.
    """
    schema = f"{by} {dict(columns.dtypes)[by]}, n bigint, " + ", ".join(f"{x} double" for x in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, place = distinct_labels(codon_labels(batch.column(1), leaves))
            each = values(rows)[place]
            coded = batch.column(0).dictionary_encode("encode")
            key, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            sums = [pa.array(np.bincount(key, each[:, k], len(keys))) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.bincount(key, minlength=len(keys)))] + sums, [by, "n", *names])

    found = columns.select(by, "pattern").where("pattern is not null").mapInArrow(run, schema)
    return found.groupBy(by).agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in names))


def parsimony(tree: Tree, labels: np.ndarray) -> np.ndarray:
    """Fitch's least number of changes for each row of ``labels``; missing leaves fit anything."""
    states = int(labels.max(initial=0)) + 1
    sets = np.ones((len(tree.parent), len(labels), states), bool)
    for k, leaf in enumerate(_leaves(tree)):
        known = labels[:, k] >= 0
        sets[leaf][known] = np.eye(states, dtype=bool)[labels[known, k]]
    changes = np.zeros(len(labels), int)
    children: dict[int, list[int]] = {}
    for node in range(1, len(tree.parent)):
        children.setdefault(tree.parent[node], []).append(node)
    for node in sorted(children, reverse=True):
        now = sets[children[node][0]]
        for child in children[node][1:]:
            both = now & sets[child]
            empty = ~both.any(axis=1)
            changes += empty
            now = np.where(empty[:, None], now | sets[child], both)
        sets[node] = now
    return changes


def diversity(tree: Tree, present: np.ndarray) -> np.ndarray:
    """Total branch length of the subtree that joins the present leaves of each row."""
    leaves, counts = _leaves(tree), np.zeros((len(tree.parent), len(present)), int)
    for k, leaf in enumerate(leaves):
        counts[leaf] = present[:, k]
    for node in range(len(tree.parent) - 1, 0, -1):
        counts[tree.parent[node]] += counts[node]
    total, out = counts[0], np.zeros(len(present))
    for node in range(1, len(tree.parent)):
        out += np.where((counts[node] > 0) & (counts[node] < total), tree.length[node], 0)
    return out


def likely_ancestors(tree: Tree, matrices: list[np.ndarray], frequencies: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The jointly most probable state of every node for each row of ``labels``."""
    n, states = len(labels), len(frequencies)
    below = np.zeros((len(tree.parent), n, states))
    back = np.zeros((len(tree.parent), n, states), int)
    with np.errstate(divide="ignore"):
        for k, leaf in enumerate(_leaves(tree)):
            known = labels[:, k] >= 0
            below[leaf][known] = np.log(np.eye(states)[labels[known, k]])
        for node in range(len(tree.parent) - 1, 0, -1):
            paths = np.log(matrices[node])[None, :, :] + below[node][:, None, :]
            back[node] = paths.argmax(axis=2)
            below[tree.parent[node]] += paths.max(axis=2)
        out = np.zeros((len(tree.parent), n), int)
        out[0] = (below[0] + np.log(frequencies)).argmax(axis=1)
    for node in range(1, len(tree.parent)):
        out[node] = back[node][np.arange(n), out[tree.parent[node]]]
    return out


@lru_cache(maxsize=256)
def _codon_branches(omega: float, kappa: float, lengths: tuple[float, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    q, f = codon_matrix(omega, kappa)
    return [transition(q, f, t) for t in lengths], f


@lru_cache(maxsize=64)
def _codon_pruner(omega: float, kappa: float, parents: tuple[int, ...], lengths: tuple[float, ...]) -> Pruner:
    return Pruner(SimpleNamespace(parent=parents), *_codon_branches(omega, kappa, lengths))


#: Grid and prior of omega.
OMEGAS = tuple(np.round(np.exp(np.linspace(np.log(0.05), np.log(3.0), 8)), 6).tolist())


def column_scores(columns: DataFrame, tree: Tree, kappa: float = 4.0) -> DataFrame:
    """``pattern, loglik array<double>, changes, diversity`` for distinct codon columns.

    ``pattern``: the codons of the leaves in the tree's order, comma-joined, ``---`` where absent.
    ``loglik`` follows the grid ``OMEGAS``.  Patterns, not columns, are computed.
    """
    import pandas as pd

    codons = {c: i for i, c in enumerate(sorted(c for c, a in codon_table().items() if a != "*"))}

    def run(frames):
        for frame in frames:
            labels = np.array([[codons.get(c.upper(), -1) for c in p.split(",")] for p in frame["pattern"]], int).reshape(len(frame), -1)
            grid = np.array([pruned_likelihoods(tree, *_codon_branches(w, kappa, tuple(tree.length)), labels) for w in OMEGAS]).T
            yield pd.DataFrame({"pattern": frame["pattern"], "loglik": grid.tolist(), "changes": parsimony(tree, labels), "diversity": diversity(tree, labels >= 0)})

    return columns.select("pattern").distinct().mapInPandas(run, "pattern string, loglik array<double>, changes bigint, diversity double")


def omega(columns: DataFrame, tree: Tree, kappa: float = 4.0) -> DataFrame:
    """``exon, omega, variance, columns, changes``: posterior mean and variance of omega on a flat grid,
    from the codon columns (``exon, pattern``) of each exon."""
    names = [f"_l{i}" for i in range(len(OMEGAS))]

    def values(labels: np.ndarray) -> np.ndarray:
        grid = [_codon_pruner(w, kappa, tuple(tree.parent), tuple(tree.length))(labels) for w in OMEGAS]
        return np.column_stack([*grid, parsimony(tree, labels)])

    sums = summed_by(columns, "exon", len(_leaves(tree)), [*names, "changes"], values).withColumnRenamed("n", "columns").withColumn("changes", F.col("changes").cast("long"))
    top = F.greatest(*[F.col(f"_l{i}") for i in range(len(OMEGAS))])
    weight = [F.exp(F.col(f"_l{i}") - top) for i in range(len(OMEGAS))]
    total = sum(weight[1:], weight[0])
    mean = sum([w * x for w, x in zip(weight[1:], OMEGAS[1:], strict=True)], weight[0] * OMEGAS[0]) / total
    square = sum([w * x * x for w, x in zip(weight[1:], OMEGAS[1:], strict=True)], weight[0] * OMEGAS[0] ** 2) / total
    return sums.select("exon", mean.alias("omega"), (square - mean * mean).alias("variance"), "columns", "changes")


def omega_prefixes(columns: DataFrame, tree: Tree) -> DataFrame:
    """``bits, frame, i, total array<double>``: running log likelihoods along positions, for range queries by difference."""
    from pyspark.sql import Window

    scores = column_scores(columns, tree)
    by = Window.partitionBy("bits", "frame").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    joined = columns.join(scores, "pattern")
    return joined.select("bits", "frame", "i", F.array(*[F.sum(F.get("loglik", F.lit(k))).over(by) for k in range(len(OMEGAS))]).alias("total"))
