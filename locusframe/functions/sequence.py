"""DNA as string columns: every function takes and returns columns and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, amino acids in the order of codons over TCAG, and by
#: table number the codons in which others differ from it.
BASES = "TCAG"
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
DIFFERENCES = {
    1: {},
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    4: {"TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"},
    10: {"TGA": "C"},
    12: {"CTG": "S"},
    26: {"CTG": "A"},
}


def codon_table(number: int = 1) -> dict[str, str]:
    """Amino acid (``*``: stop) of each codon in the genetic code ``number``."""
    codons = [a + b + c for a in BASES for b in BASES for c in BASES]
    return dict(zip(codons, STANDARD, strict=True)) | DIFFERENCES[number]


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: Column | str) -> Column:
    """The other strand; case (soft masking) is kept, other letters stay."""
    return F.reverse(F.translate(_col(seq), "ACGTacgt", "TGCAtgca"))


def on_strand(seq: Column | str, strand: Column | str) -> Column:
    """``seq`` as read on ``strand``."""
    return F.when(_col(strand) == "-", reverse_complement(seq)).otherwise(_col(seq))


def subsequence(seq: Column | str, start: Column | str, end: Column | str) -> Column:
    """Bases ``start .. end`` (1-based, inclusive)."""
    return F.substring(_col(seq), _col(start).cast("int"), (_col(end) - _col(start) + 1).cast("int"))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside a lambda an expression is computed for each element."""
    return F.transform(F.array(value), use)[0]


def pieces(seq: Column | str, size: int) -> Column:
    """The sequence cut into parts of ``size``; the last may be shorter."""
    return F.regexp_extract_all(_col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def codons(seq: Column | str, frame: int = 0) -> Column:
    """Whole codons from ``frame`` on, in upper case."""
    text = F.upper(F.substring(_col(seq), F.lit(frame + 1), F.length(_col(seq))))
    return F.regexp_extract_all(text, F.lit("(?s).{3}"), F.lit(0))


def translate(seq: Column | str, frame: int = 0, table: int = 1) -> Column:
    """Protein of a coding sequence; codons with other letters than ACGT are ``X``."""
    code = F.create_map(*[F.lit(x) for pair in codon_table(table).items() for x in pair])
    return F.array_join(F.transform(codons(seq, frame), lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")


def has_inframe_stop(seq: Column | str, frame: int = 0, table: int = 1) -> Column:
    """Whether a stop codon comes before the last codon."""
    stops = [c for c, aa in codon_table(table).items() if aa == "*"]
    found = codons(seq, frame)
    inner = F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))
    return F.exists(inner, lambda c: c.isin(stops))


def longest_orf(seq: Column | str, table: int = 1) -> Column:
    """``struct(frame, start, codons)`` of the longest run of codons without a stop over the three
    forward frames (``start`` 1-based; first frame wins ties)."""
    stops = "|".join(c for c, aa in codon_table(table).items() if aa == "*")
    # a mark behind each codon; a letter that looks like one can't be in a stop codon
    mark = "\u0001"
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def one(text: Column, frame: int) -> Column:
        marked = F.regexp_replace(F.substring(text, F.lit(frame + 1), F.length(text)), F.lit("(?s).{3}"), F.lit("$0" + mark))
        # split at stop codons, what is left are the runs between them, four characters a codon
        runs = F.transform(F.split(marked, f"(?:{stops}){mark}", -1), lambda r: F.floor(F.length(r) / 4).cast("int"))

        def longest(sizes: Column) -> Column:
            most = F.array_max(sizes)
            before = F.slice(sizes, F.lit(1), F.array_position(sizes, most).cast("int") - 1)
            codon = F.aggregate(before, F.lit(0), lambda acc, n: acc + n + 1)
            return F.struct(most.alias("n"), F.lit(-frame).alias("rank"), (codon * 3 + frame + 1).alias("start"))

        return once(runs, longest)

    best = once(F.translate(F.upper(_col(seq)), mark, "N"), lambda text: F.array_max(F.array(*[one(text, frame) for frame in range(3)])))
    return once(best, lambda top: F.struct((-top["rank"]).alias("frame"), top["start"].alias("start"), top["n"].alias("codons")))


def kmers(seq: Column | str, k: int | Column, step: int = 1) -> Column:
    """All windows of ``k`` letters, ``step`` apart."""
    size = F.lit(k) if isinstance(k, int) else k
    # a look-ahead matches at every letter that k - 1 others follow, but not inside a pair of surrogates
    pattern = F.concat(F.lit(r"(?s)(?![\uDC00-\uDFFF])(?=(.{"), size.cast("string"), F.lit("}))"))
    found = F.coalesce(F.regexp_extract_all(_col(seq), pattern, F.lit(1)), F.array().cast("array<string>"))
    return found if step == 1 else F.filter(found, lambda _, i: i % step == 0)


def kmer_number(kmer: Column | str) -> Column:
    """A k-mer over ACGT as a number in base 4; null if it has another letter."""
    up = F.upper(_col(kmer))
    digits = F.filter(F.split(F.translate(up, "ACGT", "0123"), ""), lambda d: d != "")
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: acc * 4 + d.cast("long"))
    return F.when(up.rlike("^[ACGT]+$"), value)


def letters(seq: Column | str, which: str) -> Column:
    """How many letters of ``which`` the sequence has (both cases as given)."""
    s = _col(seq)
    return (F.length(s) - F.length(F.translate(s, which, ""))).cast("long")


def gc_content(seq: Column | str) -> Column:
    """Share of G and C among A, C, G and T; null without any."""
    acgt = letters(seq, "ACGTacgt")
    return F.when(acgt > 0, letters(seq, "GCgc") / acgt)


def splice_motif(seq: Column | str, start: Column | str, end: Column | str) -> Column:
    """First two and last two bases of an intron (1-based, inclusive), upper case."""
    s, e = _col(start), _col(end)
    return F.upper(F.concat(subsequence(seq, s, s + 1), subsequence(seq, e - 1, e)))


def motif_strand(motif: Column | str, patterns: tuple[str, ...] = ("GTAG",)) -> Column:
    """``+`` or ``-`` if the four letters contain one of ``patterns`` on that strand, else null."""
    m = _col(motif)
    hit = lambda c: F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.instr(c, p) > 0)
    return F.when(hit(m), "+").when(hit(reverse_complement(m)), "-")


def masked_runs(seq: Column | str, pattern: str = "[a-z]+") -> Column:
    """``array<struct<start,end>>`` (1-based, inclusive) of the maximal runs matching ``pattern``: soft
    masking by default, ``[Nn]+`` for gaps."""
    s = _col(seq)
    runs, between = F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), F.split(s, pattern, -1)
    done = F.aggregate(
        F.zip_with(F.slice(between, F.lit(1), F.size(runs)), runs, lambda b, r: F.struct(F.length(b).alias("b"), F.length(r).alias("r"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["b"] + x["r"]).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + x["b"] + 1).alias("start"), (acc["at"] + x["b"] + x["r"]).alias("end"))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(s.rlike(pattern), done).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def merge_masking(a: Column | str, b: Column | str) -> Column:
    """Letters of ``a``, lower case where ``a`` or ``b`` is."""
    x, y = _col(a), _col(b)
    return F.array_join(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when((p == F.lower(p)) | (q == F.lower(q)), F.lower(p)).otherwise(p)), "")


def tempered(p: Column | str, heat: float) -> Column:
    """Probability raised to ``(8 - heat) / 8``."""
    return F.pow(_col(p), (8.0 - heat) / 8.0)
