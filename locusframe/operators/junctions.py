"""Junctions: alignments to spliced fragments brought onto the genome, and splice candidates between coverage jumps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .intervals import containing_points

_OPS = "array<struct<n:bigint,op:string>>"


def cigar_ops(cigar: Column | str) -> Column:
    """A CIGAR text as an array of ``n, op``; operations of no length are left out."""
    found = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    ops = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("long").alias("n"), F.substring(x, -1, 1).alias("op")))
    return F.filter(ops, lambda x: x["n"] > 0)


def on_reference(op: Column) -> Column:
    return op.isin("M", "D", "N", "=", "X")


def cigar_span(ops: Column) -> Column:
    """Bases of the reference that the operations cover."""
    return F.aggregate(ops, F.lit(0).cast("long"), lambda got, x: got + F.when(on_reference(x["op"]), x["n"]).otherwise(0))


def merged_ops(ops: Column) -> Column:
    """Operations with equal neighbours put together."""

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.array_append(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.struct((last["n"] + x["n"]).alias("n"), x["op"].alias("op")))
        return F.when(last["op"] == x["op"], longer).otherwise(F.array_append(out, x))

    return F.aggregate(ops, F.array().cast(_OPS), step)


def with_gap(ops: Column, before: Column, size: Column) -> Column:
    """Operations with a gap (``N``) of ``size`` bases after the first ``before`` bases of the reference.

    The operation across that place is divided; between two operations the gap comes before the first one
    that covers the reference again.  Outside the covered bases nothing is put in.
    """
    gap = F.struct(size.cast("long").alias("n"), F.lit("N").alias("op"))
    part = lambda n, op: F.struct(n.alias("n"), op.alias("op"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_OPS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at, n = acc["at"], x["n"]
        cut = F.array(part(before - at, x["op"]), gap, part(at + n - before, x["op"]))
        put = F.when(on_reference(x["op"]) & (at < before) & (before < at + n), cut).when(on_reference(x["op"]) & (at == before) & (before > 0), F.array(gap, x)).otherwise(F.array(x))
        return F.struct((at + F.when(on_reference(x["op"]), n).otherwise(0)).alias("at"), F.concat(acc["out"], put).alias("out"))

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def cigar_text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["n"].cast("string"), x["op"])), "")


def junctions_on_genome(sam: DataFrame, junctions: DataFrame, only_spliced: bool = True) -> DataFrame:
    """Alignments to the two flanks of introns, as alignments to the genome.

    ``junctions``: ``junction, seq, start, flank, intron``: the fragment ``junction`` is ``flank`` bases of ``seq`` from ``start`` (1-based) on,
    and what follows the next ``intron`` bases.  ``sam`` has ``rname`` (a junction), ``pos`` and ``cigar`` besides other columns.  An
    alignment across the junction gets the intron as a gap, and equal neighbours become one operation; one that
    begins behind it moves by the intron.  With ``only_spliced`` only those across are kept.  Unmapped lines (no ``pos``
    or ``cigar`` ``*``) and those of unknown fragments are dropped.
    """
    ops = cigar_ops("cigar")
    rows = sam.where("pos > 0 and cigar <> '*'").join(junctions.withColumnRenamed("junction", "rname").withColumnsRenamed({"seq": "lf_seq", "start": "lf_start"}), "rname")
    before = F.col("flank") - F.col("pos") + 1
    rows = rows.withColumns({"lf_ops": ops, "lf_before": before}).withColumn("lf_across", (F.col("lf_before") > 0) & (F.col("lf_before") < cigar_span(F.col("lf_ops"))))
    if only_spliced:
        rows = rows.where("lf_across")
    new = cigar_text(merged_ops(with_gap(F.col("lf_ops"), F.col("lf_before"), F.col("intron"))))
    place = F.col("lf_start") + F.col("pos") - 1 + F.when(F.col("lf_before") > 0, 0).otherwise(F.col("intron"))
    rows = rows.withColumns({"cigar": F.when(F.col("lf_across"), new).otherwise(cigar_text(merged_ops(F.col("lf_ops")))), "pos": place, "rname": F.col("lf_seq")})
    return rows.select(*sam.columns)


def motif_places(sequences: DataFrame, motifs: Sequence[str]) -> DataFrame:
    """``seq, pos, motif``: every place (1-based, its first base) of each of ``motifs`` (ASCII, by number) in the texts ``seq, bases``.

    A batch of texts is searched at once, as bytes; places that overlap count, and none reaches over a text's end.
    """
    wanted = [np.frombuffer(m.encode("ascii"), np.uint8) for m in motifs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("bases").cast(pa.large_string()), "")
            edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: edges[-1]]
            # number of the letter that a byte belongs to
            letter = np.cumsum((data & 0xC0) != 0x80)
            for k, m in enumerate(wanted):
                n = len(m)
                if len(data) < n:
                    continue
                fits = np.ones(len(data) - n + 1, bool)
                for j, b in enumerate(m):
                    fits &= data[j : len(data) - n + 1 + j] == b
                at = np.flatnonzero(fits)
                at = at[at >= edges[0]]
                row = np.searchsorted(edges, at, "right") - 1
                inside = at + n <= edges[row + 1]
                at, row = at[inside], row[inside]
                pos = letter[at] - letter[edges[row]] + 1
                yield pa.RecordBatch.from_arrays([batch.column("seq").take(pa.array(row)), pa.array(pos, pa.int64()), pa.array(np.full(len(at), k, np.int32))], ["seq", "pos", "motif"])

    return sequences.select("seq", "bases").mapInArrow(run, f"seq {dict(sequences.dtypes)['seq']}, pos bigint, motif int")


def motif_pairs(spots: DataFrame, motifs: DataFrame, longest: int, shortest: int = 0, width: int = 1 << 14, by: Sequence[str] = ("seq",), keep: Sequence[str] = ()) -> DataFrame:
    """``spot, seq, start, end``: pairs of an opening and a closing motif in the two ranges of a spot.

    ``spots``: ``spot, seq, left_start, left_end, right_start, right_end`` (closed); ``motifs``: ``seq, pos, opening`` (boolean).  Both
    agree in the columns ``by``, and those in ``keep`` come along from the spots.  The
    distance ``end - start`` is from ``shortest`` to ``longest``.  Positions stay rows: each range is joined with its
    motifs by bins, and both lists are joined by spot and a bin of ``longest`` bases, so that a spot with
    thousands of motifs is spread over its bins and pairs too far apart are never formed.  Bins of ``width`` should be about as long as
    the ranges: all ranges of a bin are compared with all of its motifs.
    """
    longest = max(1, longest)
    points = motifs.select(*by, "pos", "opening").where("pos is not null").distinct()

    def inside(side: str, opening: bool, more: Sequence[str]) -> DataFrame:
        ranges = spots.select("spot", *by, *more, F.col(f"{side}_start").alias("start"), F.col(f"{side}_end").alias("end"))
        met = containing_points(points.where(F.col("opening") == opening).select(*by, "pos"), ranges, on=by, width=width)
        return met.select(F.col("spot_r").alias("spot"), *by, "pos", *[F.col(c + "_r").alias(c) for c in more])

    # as tables, so that a hot spot can be split over tasks
    first, last = (written(inside(side, opening, more), "motifs") for side, opening, more in (("left", True, keep), ("right", False, ())))
    bins = F.sequence(F.floor((F.col("pos") + shortest) / longest), F.floor((F.col("pos") + longest) / longest))
    near = first.select("spot", *by, *keep, F.col("pos").alias("start"), F.explode(bins).alias("bin"))
    far = last.select("spot", *by, F.col("pos").alias("end"), F.floor(F.col("pos") / longest).alias("bin"))
    return near.join(far, ["spot", *by, "bin"]).where((F.col("end") - F.col("start")).between(shortest, longest)).drop("bin")


def splice_candidates(jumps: DataFrame, motifs: DataFrame, reach: int, longest: int, width: int = 1 << 14) -> DataFrame:
    """``seq, start, end, strand, sign``: introns between the motifs around two neighbouring segments of coverage.

    ``jumps``: ``spot, seq, start, end, strand, start_next, end_next, strand_next`` (see ``signals.coverage_jumps``); strands must agree
    or be ``.``, and the intron has the strand of both or ``.``.  ``motifs``: ``seq, pos, opening, strand``, first base of opening and
    last base of closing motifs in reading direction of the sequence.  Openings are looked for up to ``reach`` bases around
    the first segment, closings around the start of the next; forward motifs if a strand is ``+`` or both are ``.``, reverse ones likewise.
    ``sign`` is the motifs' strand, ``width`` as in :func:`motif_pairs`.
    """
    a, b = F.col("strand"), F.col("strand_next")
    agree = jumps.where((a == b) | (a == ".") | (b == ".")).withColumn("own", F.when(a == b, a).otherwise(F.lit(".")))
    ranges = [(F.col("start") - reach).alias("left_start"), (F.col("end") + reach).alias("left_end"), (F.col("start_next") - reach).alias("right_start"), (F.col("start_next") + reach).alias("right_end")]
    signs = F.filter(F.array(F.lit("+"), F.lit("-")), lambda x: (a == x) | (b == x) | ((a == ".") & (b == ".")))
    spots = agree.select("spot", "seq", *ranges, "own", F.explode(signs).alias("sign"))
    found = motif_pairs(spots, motifs.select("seq", "pos", "opening", F.col("strand").alias("sign")), longest, width=width, by=("seq", "sign"), keep=("own",))
    return found.select("spot", "seq", "start", "end", F.col("own").alias("strand"), "sign")
