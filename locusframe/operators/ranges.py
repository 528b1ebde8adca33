"""Gene ranges: paths through the graph of multi-species alignments, and ranges of bounded size and depth.

An alignment has a row for each of its species: ``ali, species, seq, strand, start, end, len``, 1-based and
closed; ``len`` are the aligned bases.  Its signature is the set of its (species, sequence, strand).
Joins, components, inverted indexes and pruning are Spark's; what runs in a group is one component of
the alignments that a signature fits, of ``MOST_NODES`` at most, or one alignment that is too large.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import dropped, written
from .graphs import connected

#: Longest gap between neighbours, share of species that must allow it, signatures that are followed anyway, and the mean
#: of aligned bases for each species beyond which others are.
MAX_GAP, FRACTION, SIGNATURES, MEAN_BASES = 500_000, 0.6, 100, 1000
#: Alignments of a component in one group; larger components are cut along the genome.
MOST_NODES = 50_000
#: Depth beyond which bases are penalised, and the penalty of such a base against that of an uncovered one.
MAX_DEPTH, DEPTH_PENALTY = 3, 0.2
#: Pieces of ranges from which on one task thins them (some 50 bytes each).
THINNED_PIECES = 100_000


def _distance(u: str, v: str) -> Column:
    return F.col(f"{v}.start") - F.col(f"{u}.end") - 1


def alignment_edges(rows: DataFrame, max_gap: int = MAX_GAP, fraction: float = FRACTION) -> DataFrame:
    """``u, v``: alignments that follow each other in some species and may be put together.

    Neighbours along a species' sequence and strand (by start, end, then ``ali``) are candidates.  Of the
    species that both have, a share of ``fraction`` must have them on one sequence and strand, ``v`` behind ``u``
    and at most ``max_gap`` bases away.
    """
    by = Window.partitionBy("species", "seq", "strand").orderBy("start", "end", "ali")
    near = rows.select(F.col("ali").alias("u"), F.lead("ali").over(by).alias("v")).where("u <> v").distinct()
    met = near.join(rows.alias("a"), F.col("u") == F.col("a.ali")).join(rows.alias("b"), (F.col("v") == F.col("b.ali")) & (F.col("a.species") == F.col("b.species")))
    fits = (F.col("a.seq") == F.col("b.seq")) & (F.col("a.strand") == F.col("b.strand")) & _distance("a", "b").between(0, max_gap)
    both = met.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.sum((~fits).cast("int")).alias("bad"))
    return both.where(F.col("bad") <= F.floor((1.0 - fraction) * F.col("n") + 1e-9)).select("u", "v")


def signatures(rows: DataFrame) -> DataFrame:
    """``ali, sig``: each alignment's signature as text."""
    return rows.groupBy("ali").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("\t", "species", "seq", "strand"))), "\n").alias("sig"))


def followed_signatures(rows: DataFrame, most: int = SIGNATURES, mean_bases: int = MEAN_BASES) -> DataFrame:
    """``sid, sig``: the ``most`` signatures with the most aligned bases (ties by text), and all whose bases are over ``mean_bases`` for each species of ``rows``."""
    bases = rows.groupBy("ali").agg(F.sum("len").alias("len")).join(signatures(rows), "ali").groupBy("sig").agg(F.sum("len").alias("len"))
    species = rows.agg(F.countDistinct("species")).first()[0]
    first = bases.orderBy(F.desc("len"), "sig").limit(most)
    found = first.unionByName(bases.where(F.col("len") >= mean_bases * species)).select("sig").distinct()
    return found.select(F.xxhash64("sig").alias("sid"), "sig")


def fitting_rows(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``sid`` and the rows that agree with a signature in species, sequence and strand."""
    part = F.explode(F.transform(F.split("sig", "\n"), lambda x: F.split(x, "\t")))
    parts = chosen.select("sid", part.alias("p")).select("sid", F.get("p", F.lit(0)).alias("species"), F.get("p", F.lit(1)).alias("seq"), F.get("p", F.lit(2)).alias("strand"))
    return parts.join(rows, ["species", "seq", "strand"])


def projected(rows: DataFrame, edges: DataFrame, chosen: DataFrame, max_gap: int = MAX_GAP) -> tuple[DataFrame, DataFrame]:
    """Nodes ``sid, ali, weight, whole, exact, at`` and edges ``sid, u, v`` under each chosen signature.

    A node has two fitting rows or more and weighs their aligned bases; ``whole`` tells that all of its rows
    fit, ``exact`` that its signature is the very one.  An edge has two fitting species in which ``v`` follows
    ``u`` within ``max_gap``.  ``at`` orders nodes along the genome.
    """
    fits = written(fitting_rows(rows, chosen), "ranges-fits")
    size = rows.groupBy("ali").agg(F.count(F.lit(1)).alias("filled"))
    nodes = fits.groupBy("sid", "ali").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("weight"), F.min(F.struct("species", "seq", "start")).alias("at")).where("n >= 2")
    own = signatures(rows).select("ali", F.xxhash64("sig").alias("own"))
    nodes = nodes.join(size, "ali").join(own, "ali").select("sid", "ali", "weight", (F.col("n") == F.col("filled")).alias("whole"), (F.col("own") == F.col("sid")).alias("exact"), "at")
    met = edges.join(fits.alias("a"), F.col("u") == F.col("a.ali")).join(fits.alias("b"), (F.col("v") == F.col("b.ali")) & (F.col("a.sid") == F.col("b.sid")) & (F.col("a.species") == F.col("b.species")))
    kept = met.where(_distance("a", "b").between(0, max_gap)).groupBy(F.col("a.sid").alias("sid"), "u", "v").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return nodes, kept.select("sid", "u", "v")


def heaviest_paths(weights: dict[int, int], edges: list[tuple[int, int]], whole: set[int], exact: set[int]) -> list[list[int]]:
    """Paths of one component, each the heaviest when it was taken, until none covers anything new.

    Nodes in ``exact`` that aren't covered yet weigh more than all others together.  A path covers its nodes
    in ``whole``.  Of equal predecessors the least node counts.  Nodes are taken in topological order, the least first;
    where a circle leaves none, the least node left is next, and edges against the order don't count.
    """
    after: dict[int, list[int]] = {v: [] for v in weights}
    missing = dict.fromkeys(weights, 0)
    for u, v in edges:
        after[u].append(v)
        missing[v] += 1
    ready, left, place = [v for v in weights if not missing[v]], sorted(weights, reverse=True), {}
    heapq.heapify(ready)
    while len(place) < len(weights):
        while ready and ready[0] in place:
            heapq.heappop(ready)
        if ready:
            u = heapq.heappop(ready)
        else:
            while left[-1] in place:
                left.pop()
            u = left.pop()
        place[u] = len(place)
        for v in after[u]:
            missing[v] -= 1
            if not missing[v] and v not in place:
                heapq.heappush(ready, v)
    order = sorted(weights, key=place.__getitem__)
    before: dict[int, list[int]] = {v: [] for v in weights}
    for u, v in sorted(edges):
        if place[u] < place[v]:
            before[v].append(u)
    more, covered, paths = sum(weights.values()) + 1, set(), []
    while True:
        best: dict[int, tuple[int, int | None]] = {}
        top: tuple[int, int | None] = (0, None)
        for v in order:
            own = weights[v] + (more if v in exact and v not in covered else 0)
            sums, back = 0, None
            for u in before[v]:
                if best[u][0] > sums:
                    sums, back = best[u][0], u
            best[v] = (sums + own, back)
            if best[v][0] > top[0]:
                top = (best[v][0], v)
        path, v = [], top[1]
        while v is not None:
            path.append(v)
            v = best[v][1]
        new = [v for v in path if v in whole and v not in covered]
        if not new:
            return paths
        covered.update(new)
        paths.append(path[::-1])


def alignment_paths(nodes: DataFrame, edges: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """``path, sid, pos, ali, weight``: :func:`heaviest_paths` of the components under each signature.

    A component of more than ``most_nodes`` is cut along the genome into parts of so many at most, and edges
    between parts are lost: ranges are cut to a size in any case.
    """
    name = lambda c: F.xxhash64("sid", c)
    found = connected(edges.select(name("u").alias("u"), name("v").alias("v")))
    placed = nodes.withColumn("node", name("ali")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    large = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_nodes).select("component", F.lit(True).alias("large"))
    placed = written(placed.join(large, "component", "left"), "ranges-placed")
    along = Window.partitionBy("component").orderBy("at", "ali")
    # only components that are too large are numbered
    cut = placed.where("large").withColumn("part", F.floor((F.row_number().over(along) - 1) / most_nodes)).drop("large")
    placed = placed.where("large is null").drop("large").withColumn("part", F.lit(0).cast("long")).unionByName(cut)
    placed = written(placed.select("component", "part", "sid", "ali", "node", "weight", "whole", "exact"), "ranges-parts")
    where = placed.select("node", "component", "part")
    a, b = where.select(F.col("node").alias("nu"), F.col("component").alias("cu"), F.col("part").alias("pu")), where.select(F.col("node").alias("nv"), F.col("component").alias("cv"), F.col("part").alias("pv"))
    inside = edges.withColumns({"nu": name("u"), "nv": name("v")}).join(a, "nu").join(b, "nv").where("cu = cv and pu = pv")
    inside = inside.select(F.col("cu").alias("component"), F.col("pu").alias("part"), F.col("sid"), F.col("u"), F.col("v"))

    def run(key, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c: [] for c in ("component", "part", "number", "sid", "pos", "ali", "weight")})
        weights = {int(x): int(w) for x, w in zip(own["ali"], own["weight"], strict=True)}
        paths = heaviest_paths(weights, [(int(u), int(v)) for u, v in zip(links["u"], links["v"], strict=True)], {int(x) for x in own.loc[own["whole"], "ali"]}, {int(x) for x in own.loc[own["exact"], "ali"]})
        out = [(key[0], key[1], k, int(own["sid"].iloc[0]), i, x, weights[x]) for k, path in enumerate(paths) for i, x in enumerate(path)]
        return pd.DataFrame(out, columns=["component", "part", "number", "sid", "pos", "ali", "weight"])

    paths = placed.groupBy("component", "part").cogroup(inside.groupBy("component", "part")).applyInPandas(run, "component bigint, part bigint, number bigint, sid bigint, pos bigint, ali bigint, weight bigint")
    return paths.select(F.xxhash64("component", "part", "number").alias("path"), "sid", "pos", "ali", "weight")


def pruned_paths(paths: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Paths without the ends that better paths have.

    An end (the first or last alignments, as many as possible) goes if a path that ranks higher, by total weight,
    then by the smaller number, has it as a stretch in which each alignment weighs at least as much.  All ends
    of a round are cut at once, and rounds go on until nothing changes: what goes stays in a path of higher rank.
    """
    now = written(paths, "ranges-paths")
    for _ in range(max_rounds):
        rank = now.groupBy("path").agg(F.sum("weight").alias("total"), F.max("pos").alias("last"))
        rows = now.join(rank, "path")
        p, o = rows.alias("p"), rows.alias("o")
        better = (F.col("o.total") > F.col("p.total")) | ((F.col("o.total") == F.col("p.total")) & (F.col("o.path") < F.col("p.path")))
        # the inverted index: a row for each pair of paths and alignment that both have
        shared = p.join(o, (F.col("p.ali") == F.col("o.ali")) & better & (F.col("o.weight") >= F.col("p.weight")))
        shared = shared.select(F.col("p.path").alias("path"), F.col("o.path").alias("other"), F.col("p.pos").alias("pos"), (F.col("o.pos") - F.col("p.pos")).alias("shift"), F.col("p.last").alias("last"))
        by = Window.partitionBy("path", "other", "shift").orderBy("pos")
        back = Window.partitionBy("path", "other", "shift").orderBy(F.desc("pos"))
        ends = shared.withColumns({"head": F.col("pos") == F.row_number().over(by) - 1, "tail": F.col("last") - F.col("pos") == F.row_number().over(back) - 1})
        cuts = ends.groupBy("path", "other", "shift").agg(F.sum(F.col("head").cast("long")).alias("head"), F.sum(F.col("tail").cast("long")).alias("tail")).groupBy("path").agg(F.max("head").alias("head"), F.max("tail").alias("tail")).where("head + tail > 0")
        cuts = written(cuts, "ranges-cuts")
        if cuts.isEmpty():
            dropped(cuts)
            break
        left = rows.join(cuts, "path", "left").where("head is null or (pos >= head and pos <= last - tail)")
        new = written(left.select("path", "sid", (F.col("pos") - F.coalesce("head", F.lit(0))).alias("pos"), "ali", "weight"), "ranges-paths")
        dropped(now, cuts)
        now = new
    else:
        raise RuntimeError("paths didn't settle")
    return now


def gene_ranges(rows: DataFrame, max_gap: int = MAX_GAP, fraction: float = FRACTION, most: int = SIGNATURES, mean_bases: int = MEAN_BASES, min_bases: int = 0, most_nodes: int = MOST_NODES) -> DataFrame:
    """``path, species, seq, strand, start, end, n_alignments, len``: what each path spans in each species of its signature.

    ``n_alignments`` counts those of the path that the species has.  Paths with fewer than ``min_bases`` aligned
    bases are left out.  An alignment has one row for a species; null or empty rows give nothing.
    """
    rows = rows.select("ali", "species", "seq", "strand", "start", "end", "len").where("ali is not null and start <= end")
    chosen = written(followed_signatures(rows, most, mean_bases), "ranges-signatures")
    nodes, edges = projected(rows, written(alignment_edges(rows, max_gap, fraction), "ranges-edges"), chosen, max_gap)
    paths = pruned_paths(alignment_paths(written(nodes, "ranges-nodes"), written(edges, "ranges-links"), most_nodes))
    enough = paths.groupBy("path").agg(F.sum("weight").alias("bases")).where(F.col("bases") >= min_bases).select("path")
    fits = fitting_rows(rows, chosen)
    return paths.join(enough, "path").join(fits, ["sid", "ali"]).groupBy("path", "species", "seq", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_alignments"), F.sum("len").alias("len"))


def cut_columns(fragments: list[tuple[int, int, int, int]], cap: int) -> list[int]:
    """Alignment columns before which one alignment is cut, so that no row spans more than ``cap`` bases between two cuts.

    ``fragments`` are ``row, chr_pos, ali_pos, len``.  From the left: the last column that still fits is known, and the cut
    is before the column, in the stretch where the longest row has over two thirds of ``cap``, with the largest sum of the
    rows' gaps; candidates are columns where a fragment begins, and the last that fits.  Of equal ones the last is taken.
    """
    listed: dict[int, list[tuple[int, int, int]]] = {}
    for r, c, a, n in fragments:
        listed.setdefault(r, []).append((a, c, n))
    by_row = {r: np.array(sorted(own), np.int64) for r, own in listed.items()}
    begins = np.unique([f[2] for f in fragments])

    def first_base(rows: np.ndarray, column: int) -> int | None:
        """Position of the first base at or behind a column."""
        k = int(np.searchsorted(rows[:, 0] + rows[:, 2], column, "right"))
        return None if k == len(rows) else int(rows[k, 1] + max(0, column - rows[k, 0]))

    def column_of(rows: np.ndarray, pos: int) -> int | None:
        """Column of the first base at or behind a position."""
        k = int(np.searchsorted(rows[:, 1] + rows[:, 2], pos, "right"))
        return None if k == len(rows) else int(rows[k, 0] + max(0, pos - rows[k, 1]))

    cuts: list[int] = []
    start = int(begins[0])
    while True:
        heads = {r: first_base(rows, start) for r, rows in by_row.items()}
        limit = [c for r, rows in by_row.items() if heads[r] is not None and (c := column_of(rows, heads[r] + cap)) is not None]
        if not limit:
            return cuts
        latest = min(limit)
        early = min(c for r, rows in by_row.items() if heads[r] is not None and (c := column_of(rows, heads[r] + 2 * cap // 3)) is not None)
        options = [int(c) for c in begins[(begins > max(early, start)) & (begins < latest)]] + [latest]

        # the rows' gaps at all options at once; a row without a base before or behind an option has none there
        at = np.array(options, np.int64)
        gaps = np.zeros(len(at), np.int64)
        for rows in by_row.values():
            before, behind = np.searchsorted(rows[:, 0], at) - 1, np.searchsorted(rows[:, 0] + rows[:, 2], at, "right")
            both = (before >= 0) & (behind < len(rows))
            i, j, c = before[both], behind[both], at[both]
            last = rows[i, 1] + np.minimum(rows[i, 2], c - rows[i, 0]) - 1
            gaps[both] += rows[j, 1] + np.maximum(0, c - rows[j, 0]) - last - 1
        start = int(at[np.flatnonzero(gaps == gaps.max())[-1]])
        cuts.append(start)


def capped_alignments(fragments: DataFrame, cap: int) -> DataFrame:
    """Fragments ``ali, species, seq, strand, chr_pos, ali_pos, len`` with ``piece``, from 0: no species of a piece spans more than ``cap`` bases.

    Fragments across a cut (:func:`cut_columns`) are divided, so every aligned base stays.  Alignments within ``cap``
    are passed on as they are; tasks go through larger ones row by row and hold the fragments of one.
    """
    if cap < 1:
        raise ValueError("a piece has a base at least")
    spans = fragments.groupBy("ali", "species").agg((F.max(F.col("chr_pos") + F.col("len")) - F.min("chr_pos")).alias("span"))
    large = spans.where(F.col("span") > cap).select("ali").distinct()
    names = ["ali", "species", "seq", "strand", "chr_pos", "ali_pos", "len"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts of one alignment after the other, rows sorted by ``ali``; one alignment is held at a time."""
        now, held = None, []
        for batch in batches:
            done = []
            for ali, *fragment in zip(*(batch.column(c).to_pylist() for c in ("ali", "species", "chr_pos", "ali_pos", "len")), strict=True):
                if ali != now:
                    if held:
                        done.append((now, cut_columns(held, cap)))
                    now, held = ali, []
                held.append(tuple(fragment))
            yield as_batch(done)
        if held:
            yield as_batch([(now, cut_columns(held, cap))])

    def as_batch(done: list[tuple[int, list[int]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.list_(pa.int64()))], ["ali", "cuts"])

    own = fragments.select(F.col("ali").cast("long").alias("ali"), "species", *[F.col(c).cast("long").alias(c) for c in ("chr_pos", "ali_pos", "len")])
    cuts = own.join(large, "ali").repartition("ali").sortWithinPartitions("ali").mapInArrow(run, "ali bigint, cuts array<bigint>")
    met = fragments.select(*names).where("len > 0").join(written(cuts, "capped-cuts"), "ali", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    end = F.col("ali_pos") + F.col("len")
    inside = F.filter("cuts", lambda c: (c > F.col("ali_pos")) & (c < end))
    first = F.size(F.filter("cuts", lambda c: c <= F.col("ali_pos")))
    edges = F.concat(F.array("ali_pos"), inside, F.array(end))
    part = F.transform(F.sequence(F.lit(0), F.size(inside)), lambda i: F.struct((first + i).alias("piece"), F.get(edges, i).alias("from"), F.get(edges, i + 1).alias("to")))
    parts = met.select(*names, F.explode(part).alias("part"))
    return parts.select("ali", F.col("part.piece").cast("long").alias("piece"), "species", "seq", "strand", (F.col("chr_pos") + F.col("part.from") - F.col("ali_pos")).alias("chr_pos"), F.col("part.from").alias("ali_pos"), (F.col("part.to") - F.col("part.from")).alias("len"))


def _depth_gains(cell: np.ndarray, start: np.ndarray, end: np.ndarray, max_depth: int, penalty: float) -> np.ndarray:
    """What the removal of each piece alone gains by the depth of its bases; pieces of different cells don't meet."""
    low = start.min()
    stride = end.max() - low + 2
    a, b = cell * stride + (start - low), cell * stride + (end - low) + 1
    spots, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    depth = np.cumsum(np.bincount(at[: len(a)], minlength=len(spots)) - np.bincount(at[len(a) :], minlength=len(spots)))
    size = np.diff(spots, append=spots[-1])
    gain = np.concatenate([[0.0], np.cumsum(np.where(depth > max_depth, penalty, np.where(depth == 1, -1.0, 0.0)) * size)])
    return gain[at[len(a) :]] - gain[at[: len(a)]]


def _best_rivals(cell: np.ndarray, start: np.ndarray, end: np.ndarray, path: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``gain, path`` of another path that overlaps each piece; pieces are in order of cell and start."""
    n = len(cell)
    rival, of = np.full(n, -np.inf), np.zeros(n, np.int64)

    def offer(to: np.ndarray, by: np.ndarray) -> None:
        better = (gain[by] > rival[to]) | ((gain[by] == rival[to]) & (path[by] > of[to]))
        rival[to[better]], of[to[better]] = gain[by[better]], path[by[better]]

    # each piece against the one so many places behind it, as long as that begins before its end
    i, lag = np.arange(n), 0
    while len(i):
        lag += 1
        i = i[i + lag < n]
        i = i[(cell[i + lag] == cell[i]) & (start[i + lag] <= end[i])]
        other = i[path[i] != path[i + lag]]
        offer(other, other + lag)
        offer(other + lag, other)
    return rival, of


def _runs(batches: Iterator[pa.RecordBatch], by: list[str], least: int = 1 << 16) -> Iterator[dict[str, np.ndarray]]:
    """Columns of about ``least`` rows at a time, whole runs of equal ``by``, from rows in order of ``by``."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([x[c] for x in held]) for c in held[0]}

    for batch in batches:
        if len(batch):
            held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
        if sum(len(x[by[0]]) for x in held) >= least:
            rows = joined()
            last = np.logical_and.reduce([rows[c] == rows[c][-1] for c in by])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = [{c: v[cut:] for c, v in rows.items()}]
            if cut:
                yield {c: v[:cut] for c, v in rows.items()}
    if held:
        yield joined()


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Numbers, from 0, of runs of equal values."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


_SETTLED, _OPEN, _GONE = 0, 1, 2
_PIECES = {"path": np.int64, "place": np.int64, "bin": np.int64, "start": np.int64, "end": np.int64, "state": np.int8, "gain": np.float64}
_JUDGED = _PIECES | {"part": np.float64, "rival": np.float64, "rival_path": np.int64}


def _as_batch(rows: dict[str, np.ndarray], kinds: dict[str, type]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[c].astype(t)) for c, t in kinds.items()], list(kinds))


def _looked_at(rows: dict[str, np.ndarray], max_depth: int, penalty: float) -> dict[str, np.ndarray]:
    """Pieces in order of place, bin and start with what they gain and their best rivals; those that no open piece shares a bin with are left out."""
    cell = _fresh(rows["place"], rows["bin"])
    alive = np.bincount(cell, rows["state"] == _OPEN) > 0
    keep = alive[cell] | (rows["state"] == _GONE)
    rows, cell = {c: v[keep] for c, v in rows.items()}, cell[keep]
    n = len(cell)
    rows |= {"part": np.zeros(n), "rival": np.full(n, -np.inf), "rival_path": np.zeros(n, np.int64)}
    here = np.flatnonzero(rows["state"] != _GONE)
    if len(here):
        # by place in the bin, so that numbers stay small
        low = np.zeros(cell[-1] + 1, np.int64)
        low[cell[here][::-1]] = rows["start"][here][::-1]
        start, end = (rows[c][here] - low[cell[here]] for c in ("start", "end"))
        rows["part"][here] = _depth_gains(cell[here], start, end, max_depth, penalty)
        open_ = rows["state"][here] == _OPEN
        at = here[open_]
        rows["rival"][at], rows["rival_path"][at] = _best_rivals(cell[at], start[open_], end[open_], rows["path"][at], rows["gain"][at])
    return rows


def _decided(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Pieces in order of path with the paths' states: gone (a row of each), settled or open with their gain."""
    k = _fresh(rows["path"])
    # ranges without a path are settled and may stand among those of a path
    open_ = rows["state"] == _OPEN
    gain = np.round(np.bincount(k, np.where(open_, rows["part"], 0.0)), 6)
    beaten = (rows["rival"] > gain[k]) | ((rows["rival"] == gain[k]) & (rows["rival_path"] > rows["path"]))
    gone = (gain > 0) & (np.bincount(k, open_ & beaten) == 0)
    state = np.where(open_, np.where(gain[k] <= 0, _SETTLED, np.where(gone[k], _GONE, _OPEN)), rows["state"])
    at = np.flatnonzero(open_)
    keep = ~(open_ & (state == _GONE))
    keep[at[np.diff(k[at], prepend=-1) > 0]] = True
    return {c: v[keep] for c, v in rows.items()} | {"state": state[keep], "gain": np.where(open_, gain[k], rows["gain"])[keep]}


def thinned_ranges(ranges: DataFrame, max_depth: int = MAX_DEPTH, penalty: float = DEPTH_PENALTY, width: int = 1 << 14, steps: int = 3, most_pieces: int = THINNED_PIECES) -> DataFrame:
    """Ranges ``path, species, seq, start, end`` of the paths that are left when overlaps are reduced.

    The cost of a set of paths is a unit for each base that it leaves uncovered and ``penalty`` for each depth over
    ``max_depth`` of a base.  In a round every path (bigint) that overlaps no better candidate goes: candidates are paths whose
    removal lowers the cost, the better one lowers it more, and ties go to the larger ``path``.  So each round lowers the
    cost by the sum of its gains, and it ends where no single removal does.

    Removals only lower the gains of others.  So a path that gains nothing stays for good, a gain of some rounds ago bounds one of now, and
    whatever goes as the best of its neighbourhood, by bounds or not, goes in the rounds too: steps of bounds give the same rows.
    Ranges are cut at bins; a step goes through bins (depth, best rivals) and through paths (sums, what goes), and bins without open
    paths are left out.  ``steps`` of them are one job.  From ``most_pieces`` pieces on the rest is one task's.
    """
    key = ["species", "seq"]
    long = lambda c: F.col(c).cast("long")
    rows = ranges.select("path", *key, "start", "end").where("start <= end")
    state = F.when(F.col("path").isNull(), _SETTLED).otherwise(_OPEN).cast("tinyint")
    bins = F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))
    pieces = rows.where("species is not null and seq is not null").select(F.coalesce(long("path"), F.lit(0)).alias("path"), F.xxhash64(*key).alias("place"), F.explode(bins).alias("bin"), long("start").alias("start"), long("end").alias("end"), state.alias("state"), F.lit(float("inf")).alias("gain"))
    now = pieces.withColumns({"start": F.greatest("start", F.col("bin") * width), "end": F.least("end", (F.col("bin") + 1) * width - 1)})
    owned, gone, kinds = [], [], "path bigint, place bigint, bin bigint, start bigint, end bigint, state tinyint, gain double"

    def by_bin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["place", "bin"]):
            yield _as_batch(_looked_at(run, max_depth, penalty), _JUDGED)

    def by_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["path"]):
            yield _as_batch(_decided(run), _PIECES)

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [{c: b.column(c).to_numpy(zero_copy_only=False) for c in _PIECES} for b in batches]
        rows = {c: np.concatenate([x[c] for x in held] or [np.zeros(0, t)]) for c, t in _PIECES.items()}
        found = []
        while (rows["state"] == _OPEN).any():
            order = np.lexsort((rows["start"], rows["bin"], rows["place"]))
            seen = _looked_at({c: v[order] for c, v in rows.items()}, max_depth, penalty)
            order = np.argsort(seen["path"], kind="stable")
            rows = _decided({c: v[order] for c, v in seen.items()})
            found.append(rows["path"][rows["state"] == _GONE])
            rows = {c: v[rows["state"] != _GONE] for c, v in rows.items() if c in _PIECES}
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["path"])

    while True:
        for _ in range(steps):
            seen = now.repartition("place", "bin").sortWithinPartitions("place", "bin", "start").mapInArrow(by_bin, kinds + ", part double, rival double, rival_path bigint")
            now = seen.repartition("path").sortWithinPartitions("path").mapInArrow(by_path, kinds)
        now = written(now, "thinned-pieces")
        gone.append(written(now.where(F.col("state") == _GONE).select("path"), "thinned-gone"))
        dropped(*owned)
        owned = [now]
        now = now.where(F.col("state") != _GONE)
        n_open, n = now.agg(F.count_if(F.col("state") == _OPEN), F.count(F.lit(1))).first()
        if n_open and n <= most_pieces:
            gone.append(written(now.coalesce(1).mapInArrow(to_the_end, "path bigint"), "thinned-gone"))
        if not n_open or n <= most_pieces:
            break
    dropped(*owned)
    left_out = gone[0]
    for more in gone[1:]:
        left_out = left_out.unionByName(more)
    return rows.join(left_out, "path", "left_anti")
