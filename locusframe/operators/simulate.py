"""Sampled coding sequences: a Markov model of codon positions, driven by numbers that depend on row and place alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STOPS = ("taa", "tag", "tga")
_BASES = np.frombuffer(b"acgt", np.uint8)


def uniform(seed: int, ids: np.ndarray, place: int) -> np.ndarray:
    """Numbers in ``[0, 1)`` by counter: functions of seed, id and place, whatever the partitioning."""
    u = np.uint64
    x = ids.astype(np.int64).view(u) * u(0x9E3779B97F4A7C15) + u((seed * 0xD1B54A32D192ED03 + place * 0x8CB92BA72F3D8DD7) & ((1 << 64) - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> u(shift))) * u(factor)
    return (x >> u(11)).astype(np.float64) / (1 << 53)


def stop_contexts(order: int) -> np.ndarray:
    """``[context, base]``: whether the last two bases of a context and the base are a stop codon."""
    out = np.zeros((4**order, 4), bool)
    for stop in STOPS:
        a, b, c = ("acgt".index(x) for x in stop)
        out[np.arange(4**order) % 16 == 4 * a + b, c] = True
    return out


def sampled_cds(rows: DataFrame, model: np.ndarray, seed: int = 1) -> DataFrame:
    """``id, bases`` for ``rows`` (``id, n_codons``): ``order`` bases from equal shares, then so many codons without a stop.

    ``model[f, context, base]`` are weights of the base at codon position ``f`` after the ``order`` bases before it
    (a number in base 4, the latest last); the order is two or more, so that a context shows a codon's first bases.
    Where all weights are 0, or those left by the stop codons are, allowed bases have equal shares.  The rows of a
    batch are drawn at once, place by place.  Null or negative numbers of codons count as 0; a null id as -1.
    """
    order = round(np.log2(model.shape[1]) / 2)
    if model.shape != (3, 4**order, 4) or order < 2:
        raise ValueError("a model has the shape 3, 4^order, 4 with an order of two or more")
    stops = stop_contexts(order)

    def shares(f: int) -> np.ndarray:
        w = np.asarray(model[f], float) * ~(stops if f == 2 else np.zeros_like(stops))
        allowed = (~stops if f == 2 else np.ones_like(stops)).astype(float)
        w = np.where(w.sum(axis=1, keepdims=True) > 0, w, allowed)
        return np.cumsum(w / w.sum(axis=1, keepdims=True), axis=1)

    cumulated = [shares(f) for f in range(3)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["id"].fillna(-1).to_numpy(np.int64)
            codons = frame["n_codons"].fillna(0).clip(lower=0).to_numpy(np.int64)
            by_length = np.argsort(-codons, kind="stable")
            ids, codons = ids[by_length], codons[by_length]
            total = order + 3 * int(codons[0]) if len(codons) else 0
            out = np.zeros((len(ids), total), np.uint8)
            context = np.zeros(len(ids), np.int64)
            for place in range(total):
                # rows that are long enough stand first
                n = len(ids) if place < order else int(np.searchsorted(-codons, -((place - order) // 3), "left"))
                r = uniform(seed, ids[:n], place)
                base = (4 * r).astype(np.int64) if place < order else np.minimum((cumulated[(place - order) % 3][context[:n]] <= r[:, None]).sum(axis=1), 3)
                out[:n, place] = _BASES[base]
                context[:n] = (4 * context[:n] + base) % 4**order
            texts = [row[: order + 3 * n].tobytes().decode() for row, n in zip(out, codons.tolist(), strict=True)]
            yield pd.DataFrame({"id": frame["id"].to_numpy()[by_length], "bases": texts})

    # a batch is a matrix of its rows and places
    return rows.selectExpr("cast(id as bigint) id", "cast(n_codons as bigint) n_codons").mapInPandas(run, "id bigint, bases string")


def codon_model(sequences: list[str], order: int, pseudo: float = 0.1) -> np.ndarray:
    """Counts of the bases of coding sequences (whole codons) by codon position and context, with ``pseudo`` added."""
    out = np.full((3, 4**order, 4), pseudo)
    for s in sequences:
        x = ["acgt".find(c) for c in s.lower()]
        for i in range(order, len(x)):
            before = x[i - order : i + 1]
            if min(before) >= 0:
                out[i % 3, sum(b * 4**k for k, b in enumerate(reversed(before[:-1]))), before[-1]] += 1
    return out
