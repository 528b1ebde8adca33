"""N-gram Jaccard join of a corpus with itself, skipping by set relations.

Exact: two documents link when their sets of word shingles have a Jaccard similarity of at least
``percent`` / 100.  Equal sets form a class, which is handled once.

1. A sketch of shingle counts (fixed size) gives a global order, rare first.  Sets that link share a
   shingle among the first ``n - ceil(t n) + 1`` of either, so only these prefixes are indexed.
2. Index lists with a single class are dropped: bits of shingles seen twice, summed over all tasks, leave
   out most of them before anything is shuffled, and counting drops the rest.  Each class takes as its pivot the class that leads
   most of its lists, and pivots of pivots lead families of highly similar sets.
3. A pivot's answers are its overlaps with the members of its family, ``|P & T| = |P| - |Dt|``, where a
   member T is stored as its difference from the pivot: Dt removed and At added.  A follower S derives
   its own from them: ``|S & T| = |P & T| - |Ds| + |Ds & Dt| + |As & At|``.  The sizes of the differences
   alone bound this from both sides.  Members stand in blocks by the size of their differences, and
   blocks whose bounds decide are answered as a whole, so pairs are formed only between blocks that
   stay open.  Of those, only the shared differences are counted.
4. Lists that mix families are joined for pairs across families.  A list is cut into blocks by set
   size and position, and a block meets only those blocks of its list whose sizes and remaining
   shingles let some pair link; the others are skipped before any pair is formed.  The pairs that are
   left are verified on whole sets.

Shingles are 64-bit hashes, and a class is named by a 64-bit hash of its set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _bins, _text
from ._store import dropped, small_batches, written
from .components import components

SHINGLE_WORDS, PERCENT = 4, 85
#: Counters of the sketch that orders shingles, bits of the filter of wanted documents and classes,
#: of that of shingles which several classes have, and of that of shingles seen twice in prefixes.
SKETCH_BITS, FILTER_BITS, TOKEN_BITS, TWICE_BITS = 22, 24, 26, 27
#: Members of a family in one block, about.
BLOCK = 256
#: Bands of set sizes in a list: so many within the range of sizes that can link.
BANDS = 8
#: Up to so many candidate pairs across families are broadcast to the sets, more are shuffled.
BROADCAST_PAIRS = 20_000
#: A class follows a pivot only if they share at least this percentage of its prefix.
FOLLOW_PERCENT = 25
_U = np.uint64


def shingle_windows(part: _text.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows and the rows they are of; a shorter text is one shingle as a whole."""
    h = part.hashes(lower=True)
    words = part.last - part.first
    row = np.repeat(np.arange(len(words)), words)
    n = max(0, len(h) - size + 1)
    values = np.zeros(n, _U)
    for k in range(size):
        values = _text.mix(values + h[k : k + n])
    inside = row[:n] == row[len(row) - n :]
    short = np.flatnonzero((words > 0) & (words < size))
    one = words[short].astype(_U)
    for k in range(size - 1):
        has = np.flatnonzero(words[short] > k)
        one[has] = _text.mix(one[has] * _U(3) + h[part.first[short[has]] + k])
    return np.concatenate([values[inside], one]), np.concatenate([row[:n][inside], short])


def shingle_sets(part: _text.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted inside each row, and the offsets of the rows."""
    values, row = shingle_windows(part, size)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.searchsorted(row[new], np.arange(part.hi - part.lo + 1))


def set_ids(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set; that of an empty set means nothing."""
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(_text.mix(values + _U(0x5851F42D4C957F2D)), out=sums[1:])
    return _text.mix(_text.mix(sums[offsets[1:]] - sums[offsets[:-1]]) + np.diff(offsets).astype(_U)).view(np.int64)


def prefix_length(n, percent: int):
    """Shingles of a set of ``n`` (a number or an array) that the index needs: ``n - ceil(n percent / 100) + 1``, none of an empty set."""
    return (n - -(-n * percent // 100) + 1) * (n > 0)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        shift = _U(64 - SKETCH_BITS)
        for batch in batches:
            for part in _text.chunks(batch.column(0), _text.NOT_SPACE):
                np.add.at(cells, (shingle_windows(part, size)[0] >> shift).astype(np.int64), 1)
        yield _bins.parts(cells)

    return run


def _prefixes(broadcast, size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, shift = broadcast.value, _U(64 - SKETCH_BITS)
        for batch in batches:
            for part in _text.chunks(batch.column(1), _text.NOT_SPACE):
                values, offsets = shingle_sets(part, size)
                n = np.diff(offsets)
                row = np.repeat(np.arange(len(n)), n)
                key = (rank[(values >> shift).astype(np.int64)].astype(_U) << _U(48)) | (values & _U((1 << 48) - 1))
                ordered = values[np.lexsort((key, row))]
                length = prefix_length(n, percent)
                tokens = ordered[np.arange(len(row)) - offsets[row] < length[row]].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(tokens))
                ids = pa.array(set_ids(values, offsets), pa.int64(), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.hi - part.lo), ids, pa.array(n, pa.int64()), lists], ["doc_id", "cid", "n", "tokens"])

    return run


def _bit_of(ids: np.ndarray, width: int) -> np.ndarray:
    return (_text.mix(ids.astype(np.int64).view(_U)) >> _U(64 - width)).astype(np.int64)


def bit_filter(ids: DataFrame, width: int) -> np.ndarray:
    """A bit for the hash of each id in the one column of ``ids``: what has none isn't there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (width - 3), np.uint8)
        for batch in batches:
            at = _bit_of(batch.column(0).to_numpy(zero_copy_only=False), width)
            np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        yield _bins.parts(bits.view(np.int64))

    return _bins.merged(ids.mapInArrow(run, _bins.PARTS), _bins.tasks_of(ids), (1 << width) // 64, bits=True)


def has_bit(cells: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    at = _bit_of(ids, width)
    return (cells.view(np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _with_bit(broadcast):
    """Rows whose ``token`` the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(broadcast.value, batch.column("token").to_numpy(zero_copy_only=False), TOKEN_BITS)))

    return run


def seen_twice(lists: DataFrame) -> np.ndarray:
    """Bits of the shingles that occur twice or more in the one column of lists; others may share a bit with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(1 << (TWICE_BITS - 3), np.uint8), np.zeros(1 << (TWICE_BITS - 3), np.uint8)
        for batch in batches:
            at = np.sort(_bit_of(np.asarray(batch.column(0).flatten()), TWICE_BITS))
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            bit = np.uint8(128) >> (at & 7).astype(np.uint8)
            again = ~new | (one[at >> 3] & bit > 0)
            np.bitwise_or.at(two, at[again] >> 3, bit[again])
            np.bitwise_or.at(one, at >> 3, bit)
        yield _bins.twice_parts(one.view(np.int64), two.view(np.int64))

    return _bins.merged(lists.mapInArrow(run, _bins.PARTS), _bins.tasks_of(lists), (1 << TWICE_BITS) // 64, twice=True)


def _repeated(broadcast, width: int):
    """Entries of the shingles that the filter has: the others are surely a single class's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            sizes = np.diff(np.asarray(tokens.offsets))
            flat = np.asarray(tokens.flatten())
            keep = np.flatnonzero(has_bit(broadcast.value, flat, width))
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep], pa.int64()), batch.column("cid").take(own), batch.column("n").take(own), pa.array(pos[keep], pa.int32())], ["token", "cid", "n", "pos"])

    return run


def _sets(documents, classes, size: int):
    """Sets of the documents whose bit is in the filter, if their class's is too; others aren't shingled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = has_bit(documents.value, batch.column(0).to_numpy(zero_copy_only=False), FILTER_BITS)
            if not wanted.any():
                continue
            for part in _text.chunks(batch.column(1).filter(pa.array(wanted)), _text.NOT_SPACE):
                values, offsets = shingle_sets(part, size)
                ids, n = set_ids(values, offsets), np.diff(offsets)
                own = np.flatnonzero((n > 0) & has_bit(classes.value, ids, FILTER_BITS))
                sets = [values[offsets[i] : offsets[i + 1]].tobytes() for i in own.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own], pa.int64()), pa.array(n[own], pa.int64()), pa.array(sets, pa.binary())], ["cid", "n", "shingles"])

    return run


def _shingles(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py(), _U)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members as positions removed from the pivot's sorted set, and shingles added to it."""
    for batch in batches:
        removed, added, sizes = [], [], []
        for own, lead in zip(batch.column("shingles"), batch.column("lead_shingles"), strict=True):
            s, p = _shingles(own), _shingles(lead)
            removed.append(np.flatnonzero(~np.isin(p, s, assume_unique=True)).astype(np.int32))
            added.append(s[~np.isin(s, p, assume_unique=True)].view(np.int64))
            sizes.append(len(p))
        yield pa.RecordBatch.from_arrays(
            [batch.column("cid"), batch.column("lead"), batch.column("n"), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(added, pa.list_(pa.int64()))],
            ["cid", "lead", "n", "lead_n", "removed", "added"],
        )


def _shared_counts(lists: pa.ChunkedArray) -> np.ndarray:
    """For all pairs of rows, how many values their lists share."""
    arrays = [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64) for x in lists]
    rows = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    out = np.zeros((len(arrays), len(arrays)), np.float32)
    if len(rows):
        values, column, times = np.unique(np.concatenate(arrays).astype(np.int64), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        rows, column = rows[shared], (np.cumsum(times > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            x = np.zeros((len(arrays), 4096), np.float32)
            x[rows[a:b], column[a:b] - at] = 1
            out += x @ x.T
    return out


def _linked(percent: int):
    """Links of a pair of blocks, by the shared differences: each member's number of them, and the least member it reaches."""

    def run(table):
        if table.num_rows > 1:
            _, first = np.unique(table.column("cid").to_numpy(), return_index=True)
            table = table.take(pa.array(first))
        cid, n, block = (table.column(c).to_numpy() for c in ("cid", "n", "block"))
        gone = np.array([len(x) for x in table.column("removed")], np.int64)
        shared = _shared_counts(table.column("removed")) + _shared_counts(table.column("added"))
        both = table.column("lead_n").to_numpy()[0] - gone[:, None] - gone[None, :] + np.rint(shared).astype(np.int64)
        link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        np.fill_diagonal(link, False)
        first_block, second_block = table.column("left")[0].as_py(), table.column("right")[0].as_py()
        if first_block != second_block:
            link &= block[:, None] != block[None, :]
        links = link.sum(axis=1)
        label = np.arange(len(cid))
        while True:
            near = np.where(link, label[None, :], len(cid)).min(axis=1)
            new = np.minimum(label, near)
            new = new[new]
            if (new == label).all():
                break
            label = new
        has = links > 0
        return pa.table({"cid": pa.array(cid[has], pa.int64()), "least": pa.array(cid[label[has]], pa.int64()), "links": pa.array(links[has], pa.int64())})

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for own, other in zip(batch.column("shingles"), batch.column("other_shingles"), strict=True):
                s, t = _shingles(own), _shingles(other)
                both = int(np.isin(s, t, assume_unique=True).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def jaccard_join(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs`` (``doc_id, text``).

    ``n_links`` is the number of other sets that the row's set links with (equal sets are one set);
    ``component_id`` the smallest ``doc_id`` reachable by links and equal sets.  Null or empty texts,
    and texts without words, have no shingles and are linked with nothing, themselves excepted.  A
    null ``doc_id`` takes no part and has a null component.  Rows that repeat a ``doc_id`` are nodes of
    their own that share the name.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = rows.select("text")
    cells = _bins.merged(texts.mapInArrow(_sketch(size), _bins.PARTS), _bins.tasks_of(texts), 1 << SKETCH_BITS)
    rank = spark.sparkContext.broadcast(np.rint(64 * np.log2(1.0 + cells)).astype(np.uint16))
    prefixes = written(rows.mapInArrow(_prefixes(rank, size, percent), "doc_id bigint, cid bigint, n bigint, tokens array<bigint>"), "jaccard-prefixes")
    named = prefixes.where("doc_id is not null and cid is not null")

    entry = "token bigint, cid bigint, n bigint, pos int"
    twice = spark.sparkContext.broadcast(seen_twice(named.select("tokens")))
    tokens = named.select("cid", "n", "tokens").mapInArrow(_repeated(twice, TWICE_BITS), entry).groupBy("token").agg(F.min("cid").alias("first"), F.max("cid").alias("last"))
    listed = written(tokens.where("first < last").drop("last"), "jaccard-lists")
    repeated = spark.sparkContext.broadcast(bit_filter(listed.select("token"), TOKEN_BITS))
    entries = named.select("cid", "n", "tokens").mapInArrow(_repeated(repeated, TOKEN_BITS), entry)
    lists = written(entries.join(listed, "token").groupBy("token", "cid", "n", "pos", "first").agg(F.lit(1).alias("one")).drop("one"), "jaccard-entries")

    votes = lists.groupBy("cid", "first", "n").agg(F.count(F.lit(1)).alias("votes"))
    pivot = votes.groupBy("cid", "n").agg(F.max(F.struct("votes", (-F.col("first")).alias("back"))).alias("best"))
    enough = 100 * F.col("best.votes") >= FOLLOW_PERCENT * (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    pivot = written(pivot.select("cid", F.when(enough, -F.col("best.back")).otherwise(F.col("cid")).alias("pivot")), "jaccard-pivots")
    lead = pivot.join(pivot.select(F.col("cid").alias("pivot"), F.col("pivot").alias("lead")), "pivot", "left")
    family = written(lead.select("cid", F.coalesce("lead", "pivot").alias("lead")), "jaccard-families")
    dropped(listed, pivot)

    pairs = _across(lists, family, percent)
    followers = family.where("cid <> lead")
    wanted = followers.select("cid").unionByName(followers.select(F.col("lead").alias("cid"))).unionByName(pairs.select(F.col("a").alias("cid"))).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    home = written(named.groupBy("cid").agg(F.min("doc_id").alias("doc_id")), "jaccard-classes")
    wanted = written(home.join(wanted, "cid", "left_semi"), "jaccard-wanted")
    documents, chosen = (spark.sparkContext.broadcast(bit_filter(wanted.select(c), FILTER_BITS)) for c in ("doc_id", "cid"))
    # what the filters let through besides is harmless, and so are documents whose rows repeat
    sets = written(rows.where("doc_id is not null").mapInArrow(_sets(documents, chosen, size), "cid bigint, n bigint, shingles binary"), "jaccard-sets")

    inside = _inside(sets, family, percent)
    few = F.broadcast if pairs.count() <= BROADCAST_PAIRS else lambda df: df
    own = sets.select(F.col("cid").alias("a"), "shingles").join(few(pairs), "a")
    others = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("other_shingles")).join(few(pairs.select("b").distinct()), "b", "left_semi")
    across = own.join(others, "b").mapInArrow(_verified(percent), "a bigint, b bigint")
    across = written(across.distinct(), "jaccard-across")
    dropped(sets, wanted, pairs, family, lists)

    edges = inside.select(F.col("cid").alias("u"), F.col("least").alias("v")).unionByName(across.select(F.col("a").alias("u"), F.col("b").alias("v")))
    counts = inside.select("cid", "links").unionByName(across.select(F.col("a").alias("cid"), F.lit(1).cast("long").alias("links"))).unionByName(across.select(F.col("b").alias("cid"), F.lit(1).cast("long").alias("links")))
    n_links = counts.groupBy("cid").agg(F.sum("links").alias("n_links"))
    found = components(edges).withColumnRenamed("node", "cid").join(home, "cid")
    named_component = written(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-components")
    by_class = found.join(named_component, "component").select("cid", "component_id")
    classes = written(
        home.join(by_class, "cid", "left").join(n_links, "cid", "left").select("cid", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")),
        "jaccard-result",
    )
    dropped(inside, across, home, named_component)
    return prefixes.join(classes, "cid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def _enough(n: Column, m: Column, shared: Column, percent: int) -> Column:
    """Whether sets of ``n`` and ``m`` shingles with ``shared`` ones in both prefixes can link."""
    # other shared shingles are beyond the prefix that ends first
    beyond = F.ceil(F.greatest(n, m) * percent / 100) - 1
    return (100 + percent) * (shared + beyond) >= percent * (n + m)


def _near(n: Column, lo: Column, hi: Column, shared: Column, percent: int) -> Column:
    """Whether :func:`_enough` holds for any size from ``lo`` to ``hi``.

    Up to ``n`` the least size is best.  Above, sizes with the same ``c = ceil(m percent / 100)`` differ
    only on the right side, so the least of them is best, and that of ``c`` beats that of ``c - 1``: the
    left side grows by ``100 + percent``, and the right by less, as the two are under ``100 / percent + 1``
    apart.  So the best size is the least one with the ``c`` of ``hi``, or the lower end if that is greater.
    """
    least = F.floor((F.ceil(hi * percent / 100) - 1) * 100 / percent) + 1
    return ((lo <= n) & _enough(n, lo, shared, percent)) | ((hi >= n) & _enough(n, F.greatest(n, lo, least), shared, percent))


def _across(lists: DataFrame, family: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs ``a, b`` of different families, formed in lists that both are in."""
    owned = written(lists.drop("first").join(family, "cid"), "jaccard-owned")
    bounds = owned.groupBy("token").agg(F.min("lead").alias("one"), F.max("lead").alias("two"), F.min("n").alias("lo"), F.max("n").alias("hi")).where("one < two").select("token", "lo", "hi")
    mixed = written(bounds, "jaccard-mixed")
    found = owned.sparkSession.sparkContext.broadcast(bit_filter(mixed.select("token"), TOKEN_BITS))
    owned_mixed = owned.mapInArrow(_with_bit(found), owned.schema).join(mixed, "token")
    by_class = owned_mixed.groupBy("cid", "n", "lead").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "lo", "hi"))).alias("own"))
    by_class = written(by_class.select("*", F.transform("own", lambda e: F.xxhash64(e["token"], *_block(F.col("n"), e["pos"], percent).values())).alias("spots")), "jaccard-index")

    # a list is skipped by classes that no size in it lets reach the threshold
    lo, hi = F.greatest("here.lo", F.ceil(F.col("n") * percent / 100)), F.least("here.hi", F.floor(F.col("n") * 100 / percent))
    open_list = (lo <= hi) & _near(F.col("n"), lo, hi, F.size("own"), percent)
    place = F.col("here.pos").alias("pos"), F.col("here.token").alias("token")
    entry = by_class.select("n", "own", F.explode("own").alias("here")).where(open_list).select("n", *place).withColumns(_block(F.col("n"), F.col("pos"), percent))
    meeting = written(_meeting(entry, percent), "jaccard-meeting")
    spot = lambda *key: F.xxhash64(*key).alias("spot")
    spots = meeting.select(spot("token", "band", "place")).unionByName(meeting.select(spot("token", "band_y", "place_y"))).distinct()
    met = entry.sparkSession.sparkContext.broadcast(bit_filter(spots, TOKEN_BITS))
    kept = by_class.mapInArrow(_meeting_spots(met), "cid bigint, n bigint, lead bigint, own array<struct<pos:int,token:bigint,lo:bigint,hi:bigint>>, keep array<int>")
    # two bytes of each shingle bound what two classes share, and are a fraction of what whole ones would shuffle
    marks = F.transform("own", lambda e: F.shiftright(e["token"], 48).cast("short"))
    kept = kept.withColumn("marks", marks).withColumn("extra", F.size("marks") - F.size(F.array_distinct("marks")))
    kept = kept.select("cid", "n", "lead", "own", "marks", "extra", F.explode("keep").alias("at")).withColumn("here", F.get("own", F.col("at"))).where(open_list)
    kept = kept.select("cid", "n", "lead", *place, "marks", "extra").withColumns(_block(F.col("n"), F.col("pos"), percent))
    x = kept.join(meeting, ["token", "band", "place"]).alias("x")
    y = kept.alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cid") < F.col("y.cid")))
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    reach = (100 * F.col("x.n") >= percent * F.col("y.n")) & ((100 + percent) * left >= percent * (F.col("x.n") + F.col("y.n")))
    count = _enough(F.col("x.n"), F.col("y.n"), F.size(F.array_intersect("x.marks", "y.marks")) + F.col("x.extra"), percent)
    # a pivot that follows another is also a member of its own family, where it has met its followers
    apart = (F.col("x.lead") != F.col("y.lead")) & (F.col("x.lead") != F.col("y.cid")) & (F.col("y.lead") != F.col("x.cid"))
    block = (F.col("x.token") == F.col("y.token")) & (F.col("x.band_y") == F.col("y.band")) & (F.col("x.place_y") == F.col("y.place"))
    joined = x.join(y, block & apart & smaller & reach & count)
    # a pair may be formed in several of the lists that both are in
    pairs = written(joined.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct(), "jaccard-pairs")
    dropped(owned, mixed, by_class, meeting)
    return pairs


def _step(percent: int) -> float:
    return math.log(1 + max(1, 100 - percent) / (100 * BANDS))


def _block(n: Column, pos: Column, percent: int) -> dict[str, Column]:
    """The block of an entry in its list: a band of sizes, and a place, positions by powers of two."""
    return {"band": F.floor(F.log(n) / _step(percent)).cast("int"), "place": F.floor(F.log2(pos + F.lit(1))).cast("int")}


def _meeting_spots(broadcast):
    """Classes with ``keep``, the places in ``own`` of the entries whose block the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column("spots")
            sizes = np.diff(np.asarray(spots.offsets))
            has = has_bit(broadcast.value, np.asarray(spots.flatten()), TOKEN_BITS)
            at = np.arange(len(has)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ends = np.concatenate([[0], np.cumsum(has)])[np.concatenate([[0], np.cumsum(sizes)])]
            keep = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[has], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "n", "lead", "own")), keep], ["cid", "n", "lead", "own", "keep"])

    return run


def _meeting(entry: DataFrame, percent: int) -> DataFrame:
    """``token, band, place, band_y, place_y``: the blocks of a list that may hold a pair that links.

    A block is described by its least and largest size and by the most shingles that an entry of it
    has left, itself included.  The second block holds the larger set.
    """
    block = entry.groupBy("token", "band", "place").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("room"))
    # bands of sizes that can link are so many apart at most; one more for rounding
    reach = math.ceil(-math.log(max(1, percent) / 100) / _step(percent)) + 1
    x = block.withColumn("band_y", F.explode(F.sequence(F.col("band"), F.col("band") + F.lit(reach))))
    y = block.select("token", F.col("band").alias("band_y"), F.col("place").alias("place_y"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"), F.col("room").alias("room_y"))
    sizes = (F.col("lo") <= F.col("hi_y")) & (100 * F.col("hi") >= percent * F.col("lo_y"))
    left = (100 + percent) * F.least("room", "room_y") >= percent * (F.col("lo") + F.greatest("lo", "lo_y"))
    return x.join(y, ["token", "band_y"]).where(sizes & left).select("token", "band", "place", "band_y", "place_y")


def _inside(sets: DataFrame, family: DataFrame, percent: int) -> DataFrame:
    """``cid, least, links`` of members of families, derived from the pivot's answers."""
    followed = family.where("cid <> lead").select("lead").distinct()
    # a class that is followed is a member of its own family, whichever it follows itself
    member = family.where("cid <> lead").unionByName(followed.select(F.col("lead").alias("cid"), "lead"))
    own = sets.join(member, "cid")
    # the pivots' side is the same exchange of sets by class as the one below the members' side
    lead = sets.alias("p")
    met = own.join(lead, F.col("lead") == F.col("p.cid")).select(own["cid"], "lead", own["n"], own["shingles"], F.col("p.n").alias("lead_n"), F.col("p.shingles").alias("lead_shingles"))
    different = met.mapInArrow(_differences, "cid bigint, lead bigint, n bigint, lead_n bigint, removed array<int>, added array<bigint>")
    different = written(different.withColumns({"gone": F.size("removed"), "came": F.size("added")}), "jaccard-differences")

    far = F.col("gone") + F.col("came")
    at = different.groupBy("lead", far.alias("far")).agg(F.count(F.lit(1)).alias("n"))
    # a row for each size of a difference, which no number of members adds to
    before = F.sum("n").over(Window.partitionBy("lead").orderBy("far")) - F.col("n")
    at = written(at.select("lead", "far", F.floor(before / BLOCK).alias("begin"), F.ceil(F.col("n") / BLOCK).alias("parts")), "jaccard-sizes")
    placed = different.withColumn("far", far).join(at, ["lead", "far"]).withColumn("block", (F.col("begin") + F.pmod(F.xxhash64("cid"), F.col("parts"))).cast("int"))
    placed = written(placed.drop("far", "begin", "parts"), "jaccard-blocks")
    dropped(different, at)

    decided = written(_decided(placed, percent), "jaccard-decided")
    sides = decided.where("sure").select("lead", F.col("left").alias("block"), F.col("right").alias("mate"), F.col("right_members").alias("members"), F.col("right_least").alias("least"))
    sides = sides.unionByName(decided.where("sure and left <> right").select("lead", F.col("right").alias("block"), F.col("left").alias("mate"), F.col("left_members").alias("members"), F.col("left_least").alias("least")))
    whole = sides.groupBy("lead", "block").agg(F.sum(F.col("members") - (F.col("block") == F.col("mate")).cast("long")).alias("links"), F.min("least").alias("least")).where("links > 0")
    # rows of a document may repeat: a member counts once
    members = placed.select("cid", "lead", "block").distinct()
    derived = members.join(whole, ["lead", "block"]).select("cid", "least", "links")
    tied = decided.where("sure and left <> right").select(F.col("left_least").alias("cid"), F.col("right_least").alias("least"), F.lit(0).cast("long").alias("links"))

    open_pairs = decided.where("not sure").select("lead", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    counted = placed.drop("gone", "came").join(open_pairs, ["lead", "block"]).groupBy("lead", "left", "right").applyInArrow(_linked(percent), "cid bigint, least bigint, links bigint")
    links = written(derived.unionByName(tied).unionByName(counted), "jaccard-inside")
    dropped(placed, decided)
    return links


def _decided(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks of a family that may link: ``sure`` if all of their members do."""
    block = placed.groupBy("lead", "block").agg(
        F.countDistinct("cid").alias("members"), F.min("cid").alias("least"), F.max("lead_n").alias("lead_n"), F.min("gone").alias("gone_lo"), F.max("gone").alias("gone_hi"), F.min("came").alias("came_lo"), F.max("came").alias("came_hi")
    )
    block = written(block, "jaccard-block-bounds")
    x, y = block.alias("x"), block.alias("y")
    c = F.col

    def links(shared: Column, gone: Column, came: Column) -> Column:
        return (100 + percent) * shared >= percent * (2 * c("x.lead_n") - gone + came)

    # at least what neither removed is shared; at most what the one with more removed has left, and all that the one with less added
    gone, came = c("x.gone_hi") + c("y.gone_hi"), c("x.came_hi") + c("y.came_hi")
    sure = links(c("x.lead_n") - gone, gone, came)
    most = c("x.lead_n") - F.greatest("x.gone_lo", "y.gone_lo") + F.least("x.came_hi", "y.came_hi")
    may = links(most, gone, c("x.came_lo") + c("y.came_lo"))
    pairs = x.join(y, (c("x.lead") == c("y.lead")) & (c("x.block") <= c("y.block"))).where(may | sure)
    return pairs.select(
        "x.lead", c("x.block").alias("left"), c("y.block").alias("right"), c("x.members").alias("left_members"), c("y.members").alias("right_members"), c("x.least").alias("left_least"), c("y.least").alias("right_least"), sure.alias("sure")
    )


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every document."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from words where len(w) > 0)
), sets as (
  select doc_id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as own from shingles group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by all
), links as (
  select a, b, y.own as other, x.own <> y.own as unlike from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * shared.n >= 85 * (x.n + y.n - shared.n)
), reach as (
  select a as node, b as r from links union select reach.node, links.b from reach join links on links.a = reach.r
), components as (select node, least(node, min(r)) as component from reach group by node),
counts as (select a, count(distinct other) filter (where unlike) as n_links from links group by a)
select words.doc_id, coalesce(n, 0) as n_shingles, coalesce(component, words.doc_id) as component_id, coalesce(n_links, 0) as n_links
from words left join sets using (doc_id) left join components on node = words.doc_id left join counts on a = words.doc_id
"""
