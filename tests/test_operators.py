"""Operators against brute force on small random tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import scores
from locusframe.functions import sequence as S
from locusframe.operators import alignments, decode, evidence, genes, graphs, intervals, msa, phylo, signals, training
from locusframe.sources.readers import parse_newick

IV = "seq string, strand string, start bigint, end bigint, id bigint"


def random_intervals(seed, n=120, span=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randrange(1, span)
        rows.append((rng.choice("ab"), rng.choice("+-."), a, a + rng.choice([0, 0, 1, 5, 20, 60]), i))
    # touching, equal, nested, single bases, and one that is backwards
    return rows + [("c", "+", 1, 5, 1000), ("c", "+", 6, 9, 1001), ("c", "+", 6, 9, 1002), ("c", "+", 20, 40, 1003), ("c", "+", 25, 30, 1004), ("c", "-", 40, 40, 1005), ("c", "+", 9, 2, 1006)]


@pytest.mark.parametrize("width", [1, 7, 64, 1000])
def test_overlap_joins(spark, width):
    rows = random_intervals(1)
    df = spark.createDataFrame(rows, IV)
    pairs = [(x, y) for x in rows for y in rows if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]]
    ids = lambda got: sorted((r.id, r.id_r) for r in got.collect())
    assert ids(intervals.overlap_join(df, df, width=width)) == sorted((x[4], y[4]) for x, y in pairs)
    assert ids(intervals.contained_join(df, df, width=width)) == sorted((x[4], y[4]) for x, y in pairs if y[2] <= x[2] and x[3] <= y[3])
    assert ids(intervals.ends_in(df, df, width=width)) == sorted((x[4], y[4]) for x, y in pairs if y[2] <= x[3] <= y[3])
    minus = df.where("strand = '-'")
    hit = {x[4] for x, y in pairs if y[1] == "-"}
    assert {r.id for r in intervals.overlap_semi(df, minus, width=width).collect()} == hit
    assert {r.id for r in intervals.overlap_anti(df, minus, width=width).collect()} == {r[4] for r in rows} - hit


@pytest.mark.parametrize("chunk", [1, 16, 10_000])
def test_unions_gaps_and_coverage(spark, chunk):
    rows = [r for r in random_intervals(2) if r[2] <= r[3]]
    df = spark.createDataFrame(rows, IV)
    depth = {}
    for s, _, a, b, _ in rows:
        for p in range(a, b + 1):
            depth[s, p] = depth.get((s, p), 0) + 1
    got = intervals.coverage(df, chunk=chunk).collect()
    assert {(r.seq, p): r.cov for r in got for p in range(r.start, r.end + 1)} == depth
    united = sorted((r.seq, r.start, r.end) for r in intervals.merged(df, touching=True, chunk=chunk).collect())
    want = []
    for s in "abc":
        for p in sorted(p for q, p in depth if q == s):
            if want and want[-1][0] == s and want[-1][2] == p - 1:
                want[-1][2] = p
            else:
                want.append([s, p, p])
    assert united == sorted(map(tuple, want))
    holes = sorted((r.seq, r.start, r.end) for r in intervals.gaps(df, chunk=chunk).collect())
    assert holes == sorted((x[0], x[2] + 1, y[1] - 1) for x, y in zip(want, want[1:], strict=False) if x[0] == y[0])
    nested = {(r.seq, r.strand, r.start, r.end) for r in intervals.without_nested(df, chunk=chunk).collect()}
    assert nested == {(s, t, a, b) for s, t, a, b, _ in rows if not any(s == s2 and t == t2 and a2 <= a and b <= b2 and (a2, b2) != (a, b) for s2, t2, a2, b2, _ in rows)}
    points = spark.createDataFrame([(s, p) for s in "abd" for p in range(0, 400, 7)], "seq string, pos bigint")
    marks = spark.createDataFrame([(r[0], r[3]) for r in rows[:40]], "seq string, mark bigint")
    for r in intervals.nearest_after(points, marks, chunk=chunk).collect():
        assert r.next_mark == min((b for s, b in [(x[0], x[3]) for x in rows[:40]] if s == r.seq and b > r.pos), default=None)


def test_empty_intervals(spark):
    none = spark.createDataFrame([], IV)
    assert intervals.merged(none).count() == intervals.coverage(none).count() == intervals.overlap_join(none, none).count() == 0


def test_rules_of_evidence(spark):
    rows = [
        ("start", 10, 12, "+", "CDS", 10, 40, "+", True), ("start", 11, 13, "+", "CDS", 10, 40, "+", False), ("stop", 38, 40, "+", "CDS", 10, 40, "+", True),
        ("dss", 41, 41, "+", "intron", 41, 80, "+", True), ("dss", 50, 50, "+", "intron", 41, 80, "+", False), ("exonpart", 5, 9, ".", "exon", 1, 10, "+", True),
        ("exonpart", 5, 19, ".", "exon", 1, 10, "+", False), ("exon", 1, 10, "+", "intron", 10, 20, "+", False), ("exon", 1, 10, "+", "exon", 1, 10, "-", False),
        ("intronpart", 12, 15, ".", "intron", 10, 20, "-", True), ("tts", 1, 1, "+", "tts", 900, 900, "+", False), ("tts", 1, 1, "+", "tts", 1500, 1500, "+", True),
        ("irpart", 1, 9, ".", "nonexonpart", 3, 4, ".", True), ("CDS", 1, 30, "+", "CDSpart", 5, 9, "+", True), ("CDS", 1, 30, "+", "CDSpart", 25, 39, "+", False), ("exon", 1, 9, "+", "exon", 20, 30, "+", True),
        # signals at both ends of what they belong to, or beyond them
        ("start", 10, 12, "+", "CDSpart", 10, 12, "+", True), ("stop", 10, 12, "-", "CDSpart", 11, 12, "-", True), ("dss", 41, 42, "+", "intronpart", 41, 42, "+", True), ("ass", 40, 45, "+", "intron", 41, 44, "+", True),
        ("stop", 40, 40, "+", "CDS", 10, 40, "+", False), ("start", 10, 12, "-", "CDS", 10, 40, "-", False), ("exonpart", 1, 12, ".", "UTR", 1, 10, "+", True), ("exonpart", 0, 12, ".", "UTR", 1, 10, "+", False),
    ]
    df = spark.createDataFrame(rows, "t1 string, s1 bigint, e1 bigint, d1 string, t2 string, s2 bigint, e2 bigint, d2 string, want boolean")
    c = F.col
    got = df.withColumn("got", evidence.compatible(c("t1"), c("s1"), c("e1"), c("d1"), c("t2"), c("s2"), c("e2"), c("d2")))
    assert [(r.t1, r.t2, r.got) for r in got.collect()] == [(r[0], r[4], r[8]) for r in rows]


def test_sequence_functions(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ACGTacgtN", k=n))) for i, n in enumerate([0, 1, 2, 3, 50, 301])]
    df = spark.createDataFrame(rows, "i int, b string")
    flip = str.maketrans("ACGTacgt", "TGCAtgca")
    table = S.codon_table()
    for r in df.select("b", S.reverse_complement("b").alias("rc"), S.translate("b").alias("p"), S.kmers("b", 4).alias("k"), S.codons("b", 1).alias("c"), S.masked_runs("b").alias("m")).collect():
        assert r.rc == r.b[::-1].translate(flip)
        assert r.p == "".join(table.get(r.b[i : i + 3].upper(), "X") for i in range(0, len(r.b) - 2, 3))
        assert r.k == [r.b[i : i + 4] for i in range(len(r.b) - 3)]
        assert r.c == [r.b[i : i + 3].upper() for i in range(1, len(r.b) - 2, 3)]
        assert "".join(r.b[x.start - 1 : x.end] for x in r.m) == "".join(x for x in r.b if x.islower())
    assert table["ATG"] == "M" and table["TGA"] == "*" and S.codon_table(2)["TGA"] == "W" and len(table) == 64
    one = df.limit(1).select(scores.cigar_sum(F.lit("3S10M2I5M1D"), "M").alias("m"), scores.f_score(F.lit(0.5), F.lit(1.0)).alias("f")).first()
    assert one.m == 15 and abs(one.f - 2 / 3) < 1e-12


def brute_best(model, x):
    """Best path by trying all segmentations."""
    n, k = len(x), len(model.states)
    best = (-math.inf, None)
    for cuts in itertools.product([0, 1], repeat=n - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
        for states in itertools.product(range(k), repeat=len(edges) - 1):
            path = [(a, b - 1, s) for a, b, s in zip(edges, edges[1:], states, strict=False)]
            p = decode.path_logp(model, x, path)
            best = max(best, (p, path), key=lambda v: v[0])
    return best


def small_model():
    with np.errstate(divide="ignore"):
        return decode.Model(["n", "e"], np.log([0.7, 0.3]), np.log([[0.0, 1.0], [1.0, 0.0]]), np.log([[0.3, 0.2, 0.2, 0.3, 0.1], [0.1, 0.4, 0.4, 0.1, 0.1]]), [float(np.log(0.6)), np.log([0.1, 0.5, 0.4])])


def test_forward_counts_segments_of_any_length():
    """Sequences longer than 2000 bases, where one geometric segment may hold them all."""
    with np.errstate(divide="ignore"):
        model = decode.Model(["n", "e"], np.log([0.9, 0.1]), np.log([[0.0, 1.0], [1.0, 0.0]]), np.log([[0.3, 0.2, 0.2, 0.3, 0.1], [0.25, 0.25, 0.25, 0.25, 0.1]]), [float(np.log(0.9999)), float(np.log(0.999))])
    for n in (2100, 5000):
        x = decode.encoded("".join(random.Random(n).choices("AATTCG", k=n)))
        best, path = decode.viterbi(model, x)
        total, _, _ = decode.forward(model, x)
        assert total >= best and max(e - b + 1 for b, e, _ in path) > 2000
        tables = decode.forward(model, x)
        assert max(e - b + 1 for i in range(20) for b, e, _ in decode.sampled(model, x, np.random.default_rng(i), tables=tables)) > 2000


def test_sampled_segments_have_their_probability():
    """Shares of the first segment's length among samples against its exact distribution."""
    model = small_model()
    x = decode.encoded("ACGGCATT")
    tables = decode.forward(model, x)
    draws = [decode.sampled(model, x, np.random.default_rng(i), tables=tables)[0] for i in range(3000)]
    exact = {}
    for b, e, s in set(draws):
        rest = decode.Model(model.states, model.step[s], model.step, model.emit, model.duration)
        tail = decode.forward(rest, x[e + 1 :])[0] if e + 1 < len(x) else 0.0
        exact[b, e, s] = math.exp(decode.path_logp(model, x[: e + 1], [(b, e, s)]) + tail - tables[0])
    assert abs(sum(exact.values()) - 1) < 0.02
    for first, p in exact.items():
        assert abs(draws.count(first) / 3000 - p) < 0.03


def test_viterbi_forward_and_samples():
    model = small_model()
    rng = random.Random(1)
    for n in range(1, 7):
        x = decode.encoded("".join(rng.choices("ACGT", k=n)))
        p, path = decode.viterbi(model, x)
        want, _ = brute_best(model, x)
        assert abs(p - want) < 1e-9 and abs(decode.path_logp(model, x, path) - p) < 1e-9
        total, _, _ = decode.forward(model, x)
        every = []
        for cuts in itertools.product([0, 1], repeat=n - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
            for states in itertools.product(range(2), repeat=len(edges) - 1):
                path = [(a, b - 1, s) for a, b, s in zip(edges, edges[1:], states, strict=False)]
                if all(s == 0 or e - b < 3 for b, e, s in path):
                    every.append(decode.path_logp(model, x, path))
        assert abs(total - np.logaddexp.reduce(every)) < 1e-9
    x = decode.encoded("ACGGCA")
    draws = [tuple(decode.sampled(model, x, np.random.default_rng(i))) for i in range(400)]
    best = tuple(decode.viterbi(model, x)[1])
    expected = math.exp(decode.path_logp(model, x, list(best)) - decode.forward(model, x)[0])
    assert abs(draws.count(best) / 400 - expected) < 0.1


def test_decoding_whole_and_in_pieces(spark):
    rng = random.Random(2)
    bases = "".join("".join(rng.choices("ACGT", [4, 1, 1, 4] if i % 2 == 0 else [1, 4, 4, 1], k=150)) for i in range(8))
    model = decode.Model(["n", "e"], np.log([0.9, 0.1]), np.array([[-np.inf, 0], [0, -np.inf]]), np.log([[0.4, 0.1, 0.1, 0.39, 0.01], [0.1, 0.4, 0.4, 0.09, 0.01]]), [float(np.log(0.995)), float(np.log(0.99))])
    whole = spark.createDataFrame([("s", bases)], "seq string, bases string")
    want = sorted((r.begin, r.end, r.state) for r in decode.decoded(whole, model).collect())
    assert want[0][0] == 1 and want[-1][1] == len(bases) and all(a[1] + 1 == b[0] for a, b in zip(want, want[1:], strict=False))
    from locusframe.operators.sequences import chunked

    pieces = decode.decoded_in_pieces(chunked(whole, 700, 300), model, 300, "n")
    assert sorted((r.begin, r.end, r.state) for r in pieces.collect()) == want
    labels = spark.createDataFrame([("s", b, e, s) for b, e, s in want], "seq string, begin bigint, end bigint, state string")
    fitted = decode.trained(whole, labels, ["n", "e"])
    assert fitted.emit[1, 1] > fitted.emit[0, 1] and abs(np.exp(fitted.emit).sum() - 2) < 1e-9
    paths = decode.sampled_paths(whole.withColumn("bases", F.substring("bases", 1, 200)), model, 3)
    assert paths.select("sample").distinct().count() == 3
    hints = spark.createDataFrame([("s", "exon", 1, 150, 1e100)], "seq string, type string, start bigint, end bigint, bonus double")
    assert decode.decoded(whole, model, hints, {"exon": ["e"]}).where("begin = 1").first().state == "e"


def test_accurate_paths(spark):
    rng = random.Random(7)
    exons = list({(a, a + rng.randrange(3, 30)): round(rng.random(), 2) for a in rng.sample(range(200), 9)}.items())
    df = spark.createDataFrame([("s", a, b, p) for (a, b), p in exons], "seq string, start bigint, end bigint, posterior double")
    got = sum(r.weight for r in decode.accurate_paths(df).collect())
    best = 0.0
    for k in range(len(exons) + 1):
        for chosen in itertools.combinations(sorted(exons), k):
            if all(x[0][1] < y[0][0] for x, y in zip(chosen, chosen[1:], strict=False)):
                best = max(best, sum((b - a + 1) * (p - 0.5) for (a, b), p in chosen))
    assert abs(got - best) < 1e-6


def test_phylogeny(spark):
    tree = parse_newick("((a:0.2,b:0.3):0.1,(c:0.15,d:0.4):0.2);")
    f = np.array([0.3, 0.2, 0.2, 0.3])
    q = phylo.rate_matrix(np.ones((4, 4)), f)
    p = [phylo.transition(q, f, t) for t in tree.length]
    assert np.allclose(p[1].sum(axis=1), 1) and np.allclose(f @ p[1], f)
    labels = np.array([[0, 1, 2, 0], [1, 1, 1, 1], [0, -1, 3, 2]])
    want, change, joint = [], [], []
    for row in labels:
        total, fewest, top = 0.0, 9, -1.0
        leaves = [2, 3, 5, 6]
        for full in itertools.product(range(4), repeat=7):
            if any(x >= 0 and full[leaf] != x for leaf, x in zip(leaves, row, strict=True)):
                continue
            w = f[full[0]] * np.prod([p[i][full[tree.parent[i]], full[i]] for i in range(1, 7)])
            total += w
            fewest = min(fewest, sum(full[i] != full[tree.parent[i]] for i in range(1, 7)))
            top = max(top, w)
        want.append(math.log(total))
        change.append(fewest)
        joint.append(top)
    assert np.allclose(phylo.pruned_likelihoods(tree, p, f, labels), want)
    assert phylo.parsimony(tree, labels).tolist() == change
    states = phylo.likely_ancestors(tree, p, f, labels)
    for k in range(3):
        assert abs(f[states[0, k]] * np.prod([p[i][states[tree.parent[i], k], states[i, k]] for i in range(1, 7)]) - joint[k]) < 1e-12
    assert np.allclose(phylo.diversity(tree, np.array([[1, 1, 0, 0], [1, 0, 1, 0], [0, 0, 0, 1]])), [0.5, 0.65, 0])
    rows = [("neutral", "ATG,ATA,CTG,ATC"), ("neutral", "GCT,GAT,GGT,CCT"), ("kept", "GCT,GCC,GCA,GCG"), ("kept", "CTG,CTC,CTA,---")]
    got = {r.exon: r.omega for r in phylo.omega(spark.createDataFrame(rows, "exon string, pattern string"), tree).collect()}
    assert got["kept"] < got["neutral"]


def test_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    parent = list(range(60))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {r.node: r.component for r in graphs.connected(spark.createDataFrame(edges, "u bigint, v bigint"), spark.range(60).withColumnRenamed("id", "node")).collect()}
    assert got == {i: find(i) for i in range(60)}
    directed = [(rng.randrange(12), rng.randrange(12)) for _ in range(20)]
    reach = {i: {i} for i in range(12)}
    for _ in range(12):
        for u, v in directed:
            for s in reach.values():
                if u in s:
                    s.add(v)
    assert graphs.strong_components(12, directed) == [min(j for j in range(12) if j in reach[i] and i in reach[j]) for i in range(12)]


def test_longest_path():
    edges = [(0, 1, 2.0), (0, 2, 5.0), (1, 3, 4.0), (2, 3, 0.5), (3, 4, -1.0), (0, 4, 4.0)]
    assert graphs.longest_path(5, edges, 0, 4) == (5.0, [0, 1, 3, 4])


def test_signal_windows_cross_blocks(spark):
    rng = random.Random(6)
    value = {p: rng.randrange(9) for p in rng.sample(range(500), 300)}
    df = spark.createDataFrame([("s", p, v) for p, v in value.items()], "seq string, pos bigint, value bigint")
    for r in signals.sliding_sum(df, 7, 4, block=16).collect():
        assert r.sum == sum(v for p, v in value.items() if r.pos - 7 <= p <= r.pos + 4)


def test_depth_cap_and_tracks(spark):
    rng = random.Random(8)
    rows = sorted((a, a + rng.randrange(30), i) for i, a in enumerate(rng.choices(range(200), k=60)))
    kept, depth = [], {}
    for a, b, i in sorted(rows, key=lambda r: (r[0], r[2])):
        bins = range(a // 10, b // 10 + 1)
        if all(depth.get(k, 0) < 2 for k in bins):
            kept.append(i)
            for k in bins:
                depth[k] = depth.get(k, 0) + 1
    df = spark.createDataFrame([("s", a, b, i) for a, b, i in rows], "seq string, start bigint, end bigint, aid bigint")
    assert sorted(r.aid for r in alignments.depth_capped(df, 2).collect()) == sorted(kept)
    t = df.select("seq", "start", "end", F.col("aid").alias("tid"), (F.col("aid") % 7 / 7).alias("post"))
    got = genes.limited_tracks(t, 2).collect()
    assert max(sum(r.start <= p <= r.end for r in got) for p in range(240)) == 2


def test_columns_and_profiles(spark):
    rows = [(1, "a", "x", 0, 4, "+", 9, "AC-G-"), (1, "b", "y", 0, 3, "+", 9, "A--T-"), (2, "a", "x", 5, 1, "+", 9, "A")]
    maf = spark.createDataFrame(rows, "block bigint, species string, seq string, start bigint, size bigint, strand string, src_size bigint, text string")
    assert sorted((r.block, r.species, r.text) for r in msa.without_gap_columns(maf).collect()) == [(1, "a", "ACG"), (1, "b", "A-T"), (2, "a", "A")]
    got = {(r.block, r.i): r.score for r in msa.conservation(maf, 2).collect()}
    assert got[1, 0] == 1.0 and got[1, 1] == 0.5 and got[1, 3] == 0.5
    profile = msa.profile(spark.createDataFrame([("MKV",), ("MKV",), ("MRV",)], "text string"))
    assert abs(profile.agg(F.sum("prob")).first()[0] - 3) < 1e-9
    hits = msa.profile_hits(spark.createDataFrame([("p", "AAMKVA")], "seq string, bases string"), profile).collect()
    assert max(hits, key=lambda r: r.score).pos == 2 and len(hits) == 4


def test_training(spark):
    rng = random.Random(9)
    rows = [(x := rng.gauss(0, 1), y := rng.gauss(0, 1), int(rng.random() < 1 / (1 + math.exp(-(1 + 2 * x - y))))) for _ in range(3000)]
    weights, intercept = training.feature_weights(spark.createDataFrame(rows, "x double, y double, label int"), ["x", "y"])
    assert abs(weights[0] - 2) < 0.4 and abs(weights[1] + 1) < 0.3 and abs(intercept - 1) < 0.3
    counts = [(f"s{i}", k, 30 if (k == "AA") == (i % 2 == 0) else 3) for i in range(8) for k in ("AA", "CC")]
    found = training.content_clusters(spark.createDataFrame(counts, "seq string, kmer string, n bigint"), 2, rounds=8).collect()
    assert len({r.cluster for r in found if int(r.seq[1:]) % 2 == 0}) == 1 and len({r.cluster for r in found}) == 2


def test_streams(spark, tmp_path):
    from locusframe.streaming import collapsed_stream, coverage_events_stream

    schema = "ts timestamp, seq string, type string, start bigint, end bigint, strand string, frame string, esource string, mult int"
    rows = [("2024-01-01 00:00:01", "c", "intron", 1, 5, "+", ".", "E", 2), ("2024-01-01 00:00:02", "c", "intron", 1, 5, "+", ".", "E", None), ("2024-01-01 00:00:03", "c", "intron", 2, 5, "+", ".", "E", 1)]
    spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("hints", collapsed_stream(stream, "ts")), ("cover", coverage_events_stream(stream, "ts"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
    assert sorted((r.start, r.mult) for r in spark.table("hints").collect()) == [(1, 3), (2, 1)]
    assert sorted((r.pos, r.d) for r in spark.table("cover").collect()) == [(1, 2), (2, 1), (6, -3)]


def test_fetched_spans_and_what_uses_them(spark):
    """Bases by chunks equal those cut from whole texts, for spans across chunks and beyond the ends."""
    from locusframe.operators import evidence, genes
    from locusframe.operators.sequences import chunked, fetched

    rng = random.Random(11)
    texts = {f"c{k}": "".join(rng.choice("acgtACGTn") for _ in range(rng.randrange(20, 300))) for k in range(4)}
    seqs = spark.createDataFrame(list(texts.items()), "seq string, bases string")
    rows = [(k, f"c{rng.randrange(5)}", rng.randrange(1, 280), rng.randrange(0, 60), rng.choice("+-."), rng.choice(["intron", "start", "stop", "dss", "ass", "exon"])) for k in range(400)]
    frame = spark.createDataFrame([(k, c, s, s + n, d, t) for k, c, s, n, d, t in rows], "id int, seq string, start bigint, end bigint, strand string, type string")
    small = frame.where("type <> 'intron'").withColumn("end", F.col("start") + F.when(F.col("type").isin("dss", "ass"), 1).otherwise(2)).unionByName(frame.where("type = 'intron'"))
    for source in (seqs, chunked(seqs, 50)):
        got = {r.id: r.x for r in fetched(frame, source, {"x": (F.col("start"), F.col("end"))}, 64).collect()}
        assert got == {k: texts[c][s - 1 : s + n] for k, c, s, n, *_ in rows if c in texts}
        flip = str.maketrans("ACGT", "TGCA")
        found = {r.id: (r.start, r.end, r.strand, r.type, r.consistent) for r in evidence.consistent_with_sequence(small, source).collect()}
        assert set(found) == {k for k, c, *_ in rows if c in texts}
        for k, c, *_ in rows:
            if c in texts:
                s, e, d, t, ok = found[k]
                text = texts[c][s - 1 : e].upper() if t != "intron" else (texts[c][s - 1 : s + 1] + (texts[c][e - 2 : e] if e > 1 else texts[c][:e])).upper()
                wanted = {"intron": ("GTAG", "GCAG", "ATAC"), **evidence.SIGNAL_BASES}.get(t)
                own = {"+": [text], "-": [text[::-1].translate(flip)]}.get(d, [text, text[::-1].translate(flip)])
                assert ok == (None if wanted is None else any(x in wanted for x in own)), (t, text, d)
        parts = frame.select(F.concat("seq", F.lit("."), "strand", (F.col("id") % 9).cast("string")).alias("tid"), "seq", "strand", "start", "end", F.lit("CDS").alias("type")).dropDuplicates(["tid", "start"])
        spliced = {r.tid: r.bases for r in genes.spliced(parts, source).collect()}
        want = {}
        for r in sorted(parts.collect(), key=lambda r: r.start):
            if r.seq in texts:
                want.setdefault(r.tid, [r.strand, ""])[1] += texts[r.seq][r.start - 1 : r.end]
        both = str.maketrans("ACGTacgt", "TGCAtgca")
        assert spliced == {k: t[::-1].translate(both) if d == "-" else t for k, (d, t) in want.items()}
        motifs = evidence.splice_filtered(frame.where("type = 'intron'").drop("strand"), source, ("GTAG", "GCAG")).count()
        assert motifs == sum(any(p in (x, x[::-1].translate(flip)) for p in ("GTAG", "GCAG")) for k, c, s, n, _, t in rows if t == "intron" and c in texts for x in [(texts[c][s - 1 : s + 1] + (texts[c][s + n - 2 : s + n] if s + n > 1 else "")).upper()])
