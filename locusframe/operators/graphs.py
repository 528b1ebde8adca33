"""Graph algorithms on edge tables, and small ones inside one group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import dropped, written


def connected(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 50) -> DataFrame:
    """``node, component`` (the least node reached) for edges ``u, v``; ``nodes`` adds lone ones.

    In a round each node goes into the least of its neighbours' least ones, and only edges between what is left go on; a component's least node
    is the one left at last.  So tables shrink from round to round, rounds grow with the logarithm of a chain, and what a round doesn't need is deleted.
    """
    ordered = lambda u, v: [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]
    left = written(edges.where("u <> v").select(*ordered("u", "v")).distinct(), "components-edges")
    levels: list[DataFrame] = []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("up")), "components-near")
        label = written(near.join(near.select(F.col("node").alias("up"), F.col("up").alias("component")), "up").select("node", "component"), "components-labels")
        a, b = label.select(F.col("node").alias("u"), F.col("component").alias("a")), label.select(F.col("node").alias("v"), F.col("component").alias("b"))
        new = written(left.join(a, "u").join(b, "v").where("a <> b").select(*ordered("a", "b")).distinct(), "components-edges")
        dropped(left, near)
        levels.append(label)
        left = new
    else:
        raise RuntimeError("components didn't settle")
    found = levels.pop() if levels else left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for label in reversed(levels):
        up = found.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = written(label.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "components-labels")
        dropped(label, found)
        found = new
    if nodes is None:
        return found
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def longest_path(n: int, edges: list[tuple[int, int, float]], source: int, sink: int) -> tuple[float, list[int]]:
    """The heaviest path of a graph without positive cycles, by relaxing edges until nothing changes.

    Edges are relaxed in the order given; of equal paths the first found stays.
    """
    best, back = np.full(n, -np.inf), np.full(n, -1)
    best[source] = 0.0
    for _ in range(n):
        changed = False
        for u, v, w in edges:
            if best[u] + w > best[v] + 1e-12:
                best[v], back[v], changed = best[u] + w, u, True
        if not changed:
            break
    path, at = [], sink
    while at >= 0 and len(path) <= n:
        path.append(int(at))
        at = back[at]
    return float(best[sink]), path[::-1]


def strong_components(n: int, edges: list[tuple[int, int]]) -> list[int]:
    """The least node of each node's strongly connected component, by two searches without recursion."""
    out: list[list[int]] = [[] for _ in range(n)]
    into: list[list[int]] = [[] for _ in range(n)]
    for u, v in edges:
        out[u].append(v)
        into[v].append(u)
    seen, order = [False] * n, []
    for root in range(n):
        stack = [(root, 0)] if not seen[root] else []
        seen[root] = True
        while stack:
            u, k = stack.pop()
            if k < len(out[u]):
                stack.append((u, k + 1))
                if not seen[out[u][k]]:
                    seen[out[u][k]] = True
                    stack.append((out[u][k], 0))
            else:
                order.append(u)
    label = [-1] * n
    for root in reversed(order):
        if label[root] < 0:
            members, stack = [root], [root]
            label[root] = root
            while stack:
                for v in into[stack.pop()]:
                    if label[v] < 0:
                        label[v] = root
                        members.append(v)
                        stack.append(v)
            least = min(members)
            for m in members:
                label[m] = least
    return label


def strong_components_by(edges: DataFrame, by: str) -> DataFrame:
    """``by, node, component`` for the edges ``by, u, v`` (bigint nodes) of many small graphs."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(frame["u"]) | set(frame["v"]))
        place = {x: i for i, x in enumerate(names)}
        label = strong_components(len(names), [(place[u], place[v]) for u, v in zip(frame["u"], frame["v"], strict=True)])
        return pd.DataFrame({by: frame[by].iloc[0], "node": names, "component": [names[i] for i in label]})

    return edges.groupBy(by).applyInPandas(run, f"{by} {dict(edges.dtypes)[by]}, node bigint, component bigint")
