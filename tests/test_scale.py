"""What operators hand to shuffles and groups, and that the cheaper ways give the same rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from locusframe.functions.sequence import longest_orf
from locusframe.operators import alignments, decode, evidence, genes, msa, phylo, ranges, sequences
from locusframe.operators.sequences import fetched
from locusframe.sources.readers import parse_newick


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_depth_cap_groups_get_only_what_can_be_accepted(spark):
    """20,000 alignments in one stretch: the first few of each first and last bin decide."""
    rng = random.Random(5)
    rows = [(a := rng.randrange(400), a + rng.randrange(40), i) for i in range(20_000)]
    kept, depth = [], {}
    for a, b, i in sorted(rows, key=lambda r: (r[0], r[2])):
        bins = range(a // 10, b // 10 + 1)
        if all(depth.get(k, 0) < 3 for k in bins):
            kept.append(i)
            for k in bins:
                depth[k] = depth.get(k, 0) + 1
    df = spark.createDataFrame([("s", a, b, i) for a, b, i in rows], "seq string, start bigint, end bigint, aid bigint")
    out = alignments.depth_capped(df, 3)
    assert sorted(r.aid for r in out.collect()) == sorted(kept)
    assert "WindowGroupLimit" in plan(out)


def test_alignment_columns_stay_in_their_block(spark):
    """No letter is a row of its own: columns are counted where a block's rows meet."""
    rng = random.Random(6)
    rows = [(b, s, "".join(rng.choice("ACGTacgt--N") for _ in range(rng.randrange(1, 40)))) for b in range(8) for s in "abc"]
    maf = spark.createDataFrame(rows, "block bigint, species string, text string")
    want, kept = {}, {}
    for b in range(8):
        texts = [t for k, _, t in rows if k == b]
        full = [i for i in range(max(map(len, texts))) if any(i < len(t) and t[i] != "-" for t in texts)]
        for k, s, t in rows:
            if k == b:
                kept[b, s] = "".join(t[i] for i in full if i < len(t))
        for i in range(max(map(len, texts))):
            n = np.array([sum(t[i : i + 1].upper() == c for t in texts) for c in "ACGT"], float)
            if n.sum():
                p = n[n > 0] / n.sum()
                want[b, i] = (1 + (p * np.log2(p)).sum() / 2) * n.sum() / 3
    got = msa.conservation(maf, 3)
    found = {(r.block, r.i): r.score for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    cut = msa.without_gap_columns(maf)
    assert {(r.block, r.species): r.text for r in cut.collect()} == kept
    assert "Generate" not in plan(got) and "Generate" not in plan(cut)


def test_codon_columns_are_summed_without_a_join(spark):
    """Tables of leaves and pairs of leaves give the likelihoods of pruning, on trees of both shapes."""
    rng = random.Random(7)
    for newick, n in (("((a:0.2,b:0.3):0.1,(c:0.15,d:0.4):0.2);", 4), ("(a:0.2,(b:0.3,(c:0.1,d:0.4):0.2):0.5,e:0.3);", 5)):
        tree = parse_newick(newick)
        labels = np.array([[rng.randrange(-1, 61) for _ in range(n)] for _ in range(300)])
        q, f = phylo.codon_matrix(0.4, 4.0)
        matrices = [phylo.transition(q, f, t) for t in tree.length]
        assert np.allclose(phylo.Pruner(tree, matrices, f)(labels), phylo.pruned_likelihoods(tree, matrices, f, labels), rtol=1e-12)
    tree = parse_newick("((a:0.2,b:0.3):0.1,(c:0.15,d:0.4):0.2);")
    rows = [(k % 3, ",".join(rng.choice([*phylo.CODONS[:9], "---", "nnn", "tga", "acg"]) for _ in range(4))) for k in range(200)]
    frame = spark.createDataFrame(rows, "exon bigint, pattern string")
    out = phylo.omega(frame, tree)
    assert "Join" not in plan(out)
    each = {r.pattern: (r.loglik, r.changes) for r in phylo.column_scores(frame, tree).collect()}
    for r in out.collect():
        own = [each[p] for e, p in rows if e == r.exon]
        sums = np.sum([x for x, _ in own], axis=0)
        weight = np.exp(sums - sums.max())
        assert abs(r.omega - (weight * phylo.OMEGAS).sum() / weight.sum()) < 1e-9
        assert (r.columns, r.changes) == (len(own), sum(c for _, c in own))


def test_many_sequences_are_decoded_side_by_side(monkeypatch):
    """Each path is that of its sequence alone, ties and lengths included, in one batch or several."""
    rng = np.random.default_rng(8)
    model = decode.Model(["n", "g", "h"], np.log([0.8, 0.1, 0.1]), np.log([[1e-9, 0.5, 0.5], [0.5, 1e-9, 0.5], [0.9, 0.1, 1e-9]]), np.log(rng.dirichlet(np.ones(5), 3)), [float(np.log(x)) for x in (0.9, 0.8, 0.8)])
    texts = [rng.integers(0, 5, n) for n in (0, 1, 1, 7, 200, 200, 33, 90, 2)]
    want = [decode.viterbi(model, x) for x in texts]
    assert decode.viterbi_many(model, texts) == want
    monkeypatch.setattr(decode, "CELLS", 700)
    assert decode.viterbi_many(model, texts) == want


def test_header_is_read_once_for_all_ranges_of_a_file(tmp_path, monkeypatch):
    """Ranges of a file share its header, and records are still each given once; a file written anew is read anew."""
    from locusframe.sources import bam

    calls, read = [], bam.read_header
    monkeypatch.setattr(bam, "read_header", lambda f: calls.append(1) or read(f))
    refs = [(f"c{k}", 1000) for k in range(500)]
    for n in (300, 301):
        rows = [{"qname": f"r{k}", "flag": 0, "rname": f"c{k % 500}", "pos": k + 1, "mapq": 9, "cigar": "4M", "rnext": "=", "pnext": 5, "tlen": 0, "seq": "ACGT", "qual": "*", "tags": []} for k in range(n)]
        data = bam.header_bytes(refs) + b"".join(bam.record_bytes(r, {x: i for i, (x, _) in enumerate(refs)}) for r in rows)
        (tmp_path / "a.bam").write_bytes(b"".join(bam.block_bytes(data[i : i + 700]) for i in range(0, len(data), 700)) + bam._EOF)
        calls.clear()
        reader = bam._Reader({"path": tmp_path.as_uri(), "splitBytes": "2000"})
        parts = reader.partitions()
        got = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
        assert len(parts) > 3 and len(calls) == 1
        assert sorted((r["qname"], r["rname"], r["rnext"]) for r in got) == sorted((r["qname"], r["rname"], "=") for r in rows)


def test_groups_of_one_hint_are_compared_where_they_meet(spark):
    """Relations of groups by their definition; pairs of single hints, which are nearly all, pass no grouping."""
    rng = random.Random(9)
    rows = []
    for i in range(220):
        a = rng.randrange(300)
        rows.append((i, rng.choice("xy"), f"g{i}" if i % 10 else f"m{i % 30}", rng.choice(evidence.TYPES), a, a + rng.randrange(40), rng.choice("+-.")))
    hints = spark.createDataFrame(rows, "hint_id bigint, seq string, gid string, type string, start bigint, end bigint, strand string")
    sides = (("type", "string"), ("start", "bigint"), ("end", "bigint"), ("strand", "string"))
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[2]), []).append(r)
    order = evidence.TYPES.index
    pairs = [(x[0], y[0], *(z for h in sorted((x, y), key=lambda h: order(h[3])) for z in h[3:]), x[6]) for x in rows for y in rows if x[1] == y[1] and x[0] != y[0]]
    df = spark.createDataFrame(pairs, ", ".join(["i bigint", "j bigint", *[f"{name}{k} {kind}" for k in (1, 2) for name, kind in sides], "own string"]))
    c = F.col
    fits = {(r.i, r.j): r.fits for r in df.select("i", "j", evidence.compatible(*[c(f"{k}1") for k in ("type", "start", "end", "strand")], *[c(f"{k}2") for k in ("type", "start", "end", "strand")], own=c("own")).alias("fits")).collect()}
    both = spark.createDataFrame([(x[0], y[0], x[3], x[4], x[5], y[3], y[4], y[5]) for x in rows for y in rows if x[1] == y[1]], "i bigint, j bigint, t1 string, s1 bigint, e1 bigint, t2 string, s2 bigint, e2 bigint")
    weak = {(r.i, r.j): r.w for r in both.select("i", "j", evidence.weaker(*[c(k) for k in ("t1", "s1", "e1", "t2", "s2", "e2")]).alias("w")).collect()}
    want = {}
    for (seq, g), own in groups.items():
        for (other, k), theirs in groups.items():
            lo, hi, lo2, hi2 = min(r[4] for r in own), max(r[5] for r in own), min(r[4] for r in theirs), max(r[5] for r in theirs)
            if seq != other or g == k or lo > hi2 or lo2 > hi:
                continue
            under = [any(weak[x[0], y[0]] for y in theirs) for x in own]
            strictly = any(weak[x[0], y[0]] and x[4:6] != y[4:6] for x in own for y in theirs)
            want[seq, g, k] = (all(fits[x[0], y[0]] for x in own for y in theirs), all(under) and (strictly or lo2 < lo or hi2 > hi))
    got = evidence.group_relations(hints, width=64)
    assert {(r.seq, r.gid, r.gid_r): (r.compatible, r.weaker) for r in got.collect()} == want
    # one branch of the union has no aggregate at all: that of single hints
    branches = got._jdf.queryExecution().optimizedPlan().children()
    assert "Aggregate" not in branches.apply(0).toString() and "Window" not in branches.apply(0).toString()


def test_sanity_of_transcripts_deals_each_segment_once(spark):
    """No row is copied for distinct counts, and one exchange serves windows and sums."""
    rows = [(1, "c", "+", "CDS", 1, 9), (1, "c", "-", "CDS", 5, 10), (2, "c", "+", "CDS", 1, 3), (2, "d", None, "UTR", 6, 9), (3, None, None, "CDS", 1, 6), (3, None, None, "CDS", 9, 11)]
    got = genes.sanity(spark.createDataFrame(rows, "tid bigint, seq string, strand string, type string, start bigint, end bigint"))
    assert sorted(map(tuple, got.collect())) == [(1, True, True, False, False, None), (2, None, False, True, False, None), (3, False, False, False, False, True)]
    assert "Expand" not in plan(got) and got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2].count("Exchange") <= 1


def test_sites_and_chains_are_scored_in_their_own_row(spark):
    """No letter or word becomes a row, but those of different sites; scores are those of the definition."""
    rng = random.Random(10)
    texts = ["".join(rng.choice("ACGTacgtNé") for _ in range(rng.randrange(0, 12))) for _ in range(60)] + ["NN", "", None]
    sites = spark.createDataFrame(list(enumerate(texts)) + [(0, "AC")], "id bigint, bases string")
    weights = sequences.position_weights(sites)
    assert "Aggregate" in plan(weights).partition("Generate")[2]
    counts = {}
    for t in [*texts, "AC"]:
        for p, c in enumerate((t or "").upper()):
            if c in "ACGT":
                counts.setdefault(p, dict.fromkeys("ACGT", 0))[c] += 1
    logs = {(p, c): np.log((n + 1) / (sum(own.values()) + 4)) for p, own in counts.items() for c, n in own.items()}
    got = {(r.pos, r.letter): r.logp for r in weights.collect()}
    assert got.keys() == logs.keys() and all(abs(got[x] - logs[x]) < 1e-9 for x in logs)
    scored = sequences.weight_scores(sites, weights)
    assert "Generate" not in plan(scored)
    want = {}
    for i, t in [*enumerate(texts), (0, "AC")]:
        for p, c in enumerate((t or "").upper()):
            if (p, c) in logs:
                want[i] = want.get(i, 0) + logs[p, c]
    found = {r.id: r.score for r in scored.collect()}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-9 for i in want)
    model = {"ACG": -0.5, "CGT": -1.25, "GTN": -2.0, "TÉA": -3.0, "AC": -9.0}
    chains = sequences.markov_scores(sites.withColumnRenamed("id", "seq"), spark.createDataFrame(list(model.items()), "kmer string, logp double"), 2)
    assert "Generate" not in plan(chains)
    want = {}
    for i, t in enumerate(texts):
        for k in range(len(t or "") - 2):
            if (w := t.upper()[k : k + 3]) in model:
                want[i] = want.get(i, 0) + model[w]
    assert {r.seq: round(r.score, 9) for r in chains.collect()} == {i: round(x, 9) for i, x in want.items()}


def test_longest_reading_frame_counts_no_codon_one_by_one(spark):
    """Runs between stop codons are measured whole: no state goes from codon to codon."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("ACGTtagN\u0001") for _ in range(rng.randrange(0, 90))) for _ in range(80)] + ["TAATAA", "", "TA\u0001\u0001TAACCC"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, bases string")
    out = df.select("i", longest_orf("bases").alias("o"))
    assert "regexp_extract_all" not in plan(out)
    for r in out.collect():
        best = (0, 0, 1)
        for frame in range(3):
            run, text = 0, texts[r.i].upper()[frame:]
            for k in range(len(text) // 3):
                run = 0 if text[3 * k : 3 * k + 3] in ("TAA", "TAG", "TGA") else run + 1
                if run > best[0]:
                    best = (run, frame, (k + 1 - run) * 3 + frame + 1)
        assert (r.o.codons, r.o.frame, r.o.start) == best
    assert spark.sql("select cast(null as string) as bases").select(longest_orf("bases").alias("o")).where("o.codons > 0").isEmpty()


def test_items_of_a_group_are_paired_without_a_join(spark):
    """Pairs of a group's different items, with repeated rows and nulls among them."""
    rows = [(1, 5), (1, 3), (1, 3), (2, 3), (2, 5), (2, 9), (2, None), (None, 3), (None, 5), (3, 7)]
    got = genes.cooccurrence(spark.createDataFrame(rows, "grp bigint, item bigint"))
    assert sorted(map(tuple, got.collect())) == [(3, 5, 2), (3, 9, 1), (5, 9, 1)]
    assert "Join" not in plan(got)


def test_code_of_hint_pairs_is_short_enough_to_be_compiled(spark):
    """From 8000 bytes on the virtual machine only interprets a method; pairs are judged as by the rules in the open."""
    import re

    rng = random.Random(4)
    kinds = [*evidence.TYPES, "tss", "tts", "odd", "other", None]
    rows = [(i, "x", kinds[i % len(kinds)], a, a + rng.choice((0, 2, rng.randrange(40))), rng.choice(["+", "-", ".", None]), i % 5) for i in range(200) for a in [rng.randrange(200)]]
    hints = spark.createDataFrame(rows, "hint_id bigint, seq string, type string, start bigint, end bigint, strand string, priority int")
    met = evidence.hint_pairs(hints, None, 64)
    c = F.col
    open_rule = evidence.weaker(*[c(k) for k in ("type", "start", "end", "type_r", "start_r", "end_r")])
    assert met.count() > 2000 and met.where(~F.col("weaker").eqNullSafe(F.coalesce(open_rule, F.lit(False)))).count() == 0
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = evidence.conformance_counts(hints.withColumn("gid", F.concat(F.lit("g"), c("hint_id"))), width=64)
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", counts._jdf.queryExecution().explainString(mode))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000


def test_larger_alignments_are_cut_row_by_row(spark):
    """No group for each alignment, and an alignment may be spread over batches."""
    rng = random.Random(6)
    rows = [(a, sp, "c", "+", 40 * k + rng.randrange(10) + 1, 30 * k, rng.randrange(1, 30)) for a in range(30) for sp in ("x", "y") for k in range(rng.randrange(1, 12))]
    frame = spark.createDataFrame(rows, "ali bigint, species string, seq string, strand string, chr_pos bigint, ali_pos bigint, len bigint")
    cuts = {a: ranges.cut_columns([(r[1], *r[4:]) for r in rows if r[0] == a], 60) for a in range(30)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    seen = []
    own = ranges.written
    try:
        ranges.written = lambda df, name: (seen.append(plan(df)), own(df, name))[1]
        got = ranges.capped_alignments(frame, 60).collect()
    finally:
        ranges.written = own
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(seen) == 1 and "FlatMapGroups" not in seen[0]
    assert {(r.ali, r.piece) for r in got} == {(r[0], sum(c <= x for c in cuts[r[0]])) for r in rows for x in range(r[5], r[5] + r[6])}


def test_island_hints_take_spans_as_they_take_positions(spark):
    from locusframe.operators import signals

    rng = random.Random(8)
    spans, at = [], 1
    for _ in range(120):
        n = rng.randrange(1, 40)
        if rng.random() < 0.85:
            spans.append(("c", at, at + n - 1, rng.randrange(1, 9)))
        at += n
    steps = spark.createDataFrame(spans, "seq string, start bigint, end bigint, value bigint")
    dense = spark.createDataFrame([("c", p, v) for _, s, e, v in spans for p in range(s, e + 1)], "seq string, pos bigint, value bigint")
    one, two = (sorted(tuple(r) for r in signals.island_hints(df, 3, 5, 10, 3.5, 64).collect()) for df in (steps, dense))
    assert one == two and len(one) > 30
    for _, s, e, score in one:
        assert abs(score - sum(v * (min(e, b) - max(s, a) + 1) for _, a, b, v in spans if a <= e and s <= b) / (e - s + 1)) < 1e-9


def test_accurate_paths_form_no_group_for_each_block(spark):
    """Best chains of stretches that come in pieces of three rows, against all subsets of each stretch."""
    from itertools import combinations

    rng = random.Random(12)
    rows = [(s, 1000 * k + a, 1000 * k + a + rng.randrange(20), rng.random()) for s in ("x", "y") for k in range(300) for a in (rng.randrange(30) for _ in range(rng.randrange(1, 5)))]
    rows = list({r[:3]: r for r in rows}.values())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = decode.accurate_paths(spark.createDataFrame(rows, "seq string, start bigint, end bigint, posterior double"))
        assert "FlatMapGroups" not in plan(df)
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sums, stretches = {}, {}
    for r in got:
        sums[r.seq, r.start // 1000] = sums.get((r.seq, r.start // 1000), 0) + r.weight
    for r in rows:
        stretches.setdefault((r[0], r[1] // 1000), []).append(r[1:])
    for key, own in stretches.items():
        best = max(sum((e - s + 1) * (p - 0.5) for s, e, p in c) for n in range(len(own) + 1) for c in combinations(own, n) if all(a[1] < b[0] or b[1] < a[0] for a, b in combinations(c, 2)))
        assert abs(sums.get(key, 0) - best) < 1e-9


def test_short_hints_meet_one_piece_and_are_not_joined_back(spark, monkeypatch):
    """Hints of some bases are read whole from one piece, across the pieces' ends and behind the sequence's, and only others span by span."""
    rng = random.Random(13)
    texts = {k: "".join(rng.choice("acgtACGT") for _ in range(n)) for k, n in enumerate((3000, 1024, 1025, 40, 0))}
    seqs = spark.createDataFrame(list(texts.items()), "seq int, bases string")
    rows = [(i, rng.randrange(6), s, s + rng.choice([1, 2, 30, 63, 64, 0]), rng.choice(["intron", "start", "stop", "dss", "exon"]), rng.choice("+-.")) for i in range(1500) for s in [rng.choice([rng.randrange(-3, 3100), rng.randrange(1000, 1030)])]]
    hints = spark.createDataFrame(rows, "id int, seq int, start bigint, end bigint, type string, strand string")
    by_chunks = evidence.consistent_with_sequence(hints, sequences.chunked(seqs, 500))
    seen, keep = [], sequences.fetched
    monkeypatch.setattr(sequences, "fetched", lambda far, *a: seen.append(far.count()) or keep(far, *a))
    got = evidence.consistent_with_sequence(hints, seqs)
    assert sorted(map(str, got.collect())) == sorted(map(str, by_chunks.collect())) and 500 < got.count() < 1500
    assert seen == [sum(not (s >= 1 and 0 < e - s < 64) for _, _, s, e, _, _ in rows)]
    short = hints.where("start >= 1 and end > start and end < start + 64")
    evidence.consistent_with_sequence(short, seqs).collect()
    assert len(seen) == 1


def test_conformance_shuffles_no_pair_of_hint_and_group(spark):
    """Ids on several sequences count a group once, the largest part of a group counts, and pairs aren't dealt by hint and group."""
    rng = random.Random(12)
    rows = [(rng.randrange(120), f"c{rng.randrange(2)}", f"g:{rng.randrange(25)}", rng.choice(["intron", "exonpart", "exon", "CDSpart", "intronpart", "start"]), s, s + rng.randrange(1, 40), rng.choice("+-."), rng.randrange(-1, 4)) for _ in range(220) for s in [rng.randrange(150)]]
    hints = spark.createDataFrame(rows, "hint_id bigint, seq string, gid string, type string, start bigint, end bigint, strand string, priority int")
    want = {}
    for r in evidence.hint_pairs(hints, None, 64).where("gid <> gid_r").collect():
        own = want.setdefault(r.hint_id, {}).setdefault(r.gid_r, [0, 0.0])
        own[0] = max(own[0], int(r.weaker))
        if not r.compatible and not 0 <= r.priority_r < r.priority:
            size = r.end - r.start + 1
            own[1] = max(own[1], min(r.end_r - r.start_r + 1, size) / size if r.type == "intron" and r.type_r.endswith("part") else 1.0)
    out = evidence.conformance_counts(hints, width=64)
    got = {r.hint_id: (r.support, round(r.contradict, 9)) for r in out.collect()}
    assert got == {h: (sum(x[0] for x in own.values()), round(sum(x[1] for x in own.values()), 9)) for h, own in want.items()}
    assert any(c % 1 for _, c in got.values()) and any(s for s, _ in got.values())
    text = out._jdf.queryExecution().executedPlan().toString()
    # each pair was a row of an exchange by hint and group before, and another by hint came behind it
    assert "hashpartitioning(hint_id#" in text and not any("hashpartitioning(hint_id#" in line and "gid_r#" in line for line in text.splitlines())
