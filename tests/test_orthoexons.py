"""Feature tables against a plain version, and codon classes against sums over all inner states."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from locusframe.operators import codon_classes as C
from locusframe.operators import orthoexons
from locusframe.operators.phylo import codon_matrix
from locusframe.sources.readers import parse_newick

EXONS = "seq string, start bigint, end bigint, strand string, frame bigint, score double, attributes string, lf_key int"


def random_exons(rng, n):
    out = []
    for _ in range(n):
        s = rng.randrange(1, 120)
        out.append((f"c{rng.randrange(2)}", s, s + rng.choice([3, 8, 14]), rng.choice("+-"), rng.randrange(3), rng.random(), rng.choice(["", "n=2;cons=0.5;", "cons=0.25;n=3", " n=3;div=x;contain=7", "PMomega=0.5;nn=9;"]), 1))
    return out


def test_feature_table(spark):
    rng = random.Random(2)
    exons = [*random_exons(rng, 150), ("c0", 500, 520, "+", 0, 1.0, None, 1)]
    ref = [r[:5] for r in random_exons(rng, 60)] + [exons[0][:5], exons[0][:5]]
    got = orthoexons.feature_table(spark.createDataFrame(exons, EXONS), spark.createDataFrame([(*r, 1) for r in ref], "seq string, start bigint, end bigint, strand string, frame bigint, score int"), width=16).collect()
    value = lambda text, k, d: next((float(v) for a, v in (x.strip().split("=") for x in (text or "").split(";") if "=" in x) if a == k and v.replace(".", "").isdigit()), d)
    places = {}
    for e in exons:
        places.setdefault(e[:5], []).append(e)
    assert len(got) == len(places)
    for r in got:
        key = (r.seq, r.start, r.end, r.strand, r.frame)
        best = min(places[key], key=lambda e: (-value(e[6], "n", 0), e[6] or "", e[5]))
        assert (r.n, r.cons, r.PMomega, r.div, r.contain, r.length, r.copies) == (value(best[6], "n", 0), value(best[6], "cons", 0), value(best[6], "PMomega", -1), 0, value(best[6], "contain", 0), r.end - r.start + 1, len(places[key]))
        near = [x for x in ref if x[0] == r.seq and x[1] <= r.end and r.start <= x[2]]
        fits = [x for x in near if x[3] == r.strand and ((r.frame - x[4] + r.start - x[1]) % 3 == 0 if r.strand == "+" else (x[2] - r.end + r.frame - x[4]) % 3 == 0)]
        assert r["class"] == (1 if key in ref else -1 if fits else 0)
        if not near:
            assert (r.left_code, r.right_code) == (0, 0)
            continue
        _, a, b = max((x == key, x[1], x[2]) for x in near)
        assert r.left_code == (1 if r.start == a else 2 if r.start < a else 3) and r.right_code == (1 if r.end == b else 2 if r.end > b else 3)
    assert {r["class"] for r in got} == {1, -1, 0}
    assert orthoexons.feature_table(spark.createDataFrame([], EXONS), spark.createDataFrame([(*r, 1) for r in ref], "seq string, start bigint, end bigint, strand string, frame bigint, score int")).count() == 0


def exponential(q, t):
    """By scaling, a series and squaring."""
    a, out, term = q * t / 1024, np.eye(len(q)), np.eye(len(q))
    for k in range(1, 12):
        term = term @ a / k
        out = out + term
    for _ in range(10):
        out = out @ out
    return out


def brute_loglik(tree, family, codons):
    """Likelihood by naming the states of the root and the only inner node, one by one."""
    f = np.array(family.frequencies)
    q, _ = codon_matrix(family.omega, family.kappa, f)
    step = [exponential(q, t * family.pace) for t in tree.length]
    inner = [i for i in range(1, len(tree.parent)) if i in set(tree.parent)]
    leaves = [i for i in range(len(tree.parent)) if i not in set(tree.parent)]
    seen = {i: C.CODONS.index(c) if c in C.CODONS else None for i, c in zip(leaves, codons, strict=True)}
    total = 0.0
    for root, *rest in itertools.product(range(61), repeat=1 + len(inner)):
        state = {0: root, **dict(zip(inner, rest, strict=True))}
        p = f[root]
        for i in range(1, len(tree.parent)):
            above = state[tree.parent[i]]
            if i in state:
                p *= step[i][above, state[i]]
            elif seen[i] is not None:
                p *= step[i][above, seen[i]]
        total += p
    return math.log(total)


TREES = ["(a:0.3,b:0.7);", "((a:0.2,b:0.3):0.1,c:0.4);", "(a:0.05,b:1.5,c:0.4);"]


def test_log_ratios_on_three_trees(spark):
    rng = np.random.default_rng(1)
    even = tuple([1 / 61] * 61)
    biased = tuple(rng.dirichlet(np.full(61, 3.0)).tolist())
    model = C.TwoClasses(C.Family(0.1, 4.0, 1.0, biased), C.Family(1.0, 4.0, 2.0, even), 0.5)
    for text in TREES:
        tree = parse_newick(text)
        leaves = 2 if text == TREES[0] else 3
        patterns = [",".join(rng.choice([*C.CODONS[:20], "---", "TAA"], leaves)) for _ in range(4)] + [",".join(["---"] * leaves), ",".join(["atg"] * leaves)]
        rows = [(k % 2, p, 1) for k, p in enumerate(patterns)] + [(0, patterns[0], 1)]
        frame = spark.createDataFrame(rows, "exon bigint, pattern string, ratio int").drop("ratio")
        want = {p: brute_loglik(tree, model.coding, p.upper().split(",")) - brute_loglik(tree, model.other, p.upper().split(",")) for p in patterns}
        got = C.codon_ratios(frame, tree, model).collect()
        assert len(got) == len(rows) and all(abs(r.ratio - want[r.pattern]) < 1e-6 for r in got)
        sums = {r.exon: (r.ratio, r.columns, r.coding) for r in C.exon_ratios(frame, tree, model).collect()}
        for e in (0, 1):
            own = sum(want[p] for x, p, _ in rows if x == e)
            assert abs(sums[e][0] - own) < 1e-6 and sums[e][1:] == (sum(x == e for x, *_ in rows), own + 0.5 > 0)


def test_classes_are_fitted(spark):
    """Columns drawn from two families: the fit finds their selection and tells them apart."""
    rng = np.random.default_rng(3)
    tree = parse_newick("(a:0.4,b:0.6,c:0.5);")
    true = {True: C.Family(0.1, 4.0, 1.0, tuple(rng.dirichlet(np.full(61, 5.0)).tolist())), False: C.Family(1.0, 4.0, 2.0, tuple([1 / 61] * 61))}
    rows = []
    for coding, f in true.items():
        for _ in range(1500):
            root = rng.choice(61, p=np.array(f.frequencies))
            leaf = [rng.choice(61, p=(m := C.branch_matrix(f.omega, f.kappa, f.frequencies, t * f.pace)[root]) / m.sum()) for t in (0.4, 0.6, 0.5)]
            rows.append((",".join(C.CODONS[x] for x in leaf), coding))
    frame = spark.createDataFrame(rows, "pattern string, coding boolean")
    model = C.fitted_classes(frame, tree)
    assert (model.coding.omega, model.coding.pace) == (0.1, 1.0) and model.other.omega in (0.7, 1.0, 1.5) and model.other.pace == 2.0 and abs(model.odds) < 0.01
    scored = C.codon_ratios(frame, tree, model).withColumn("right", (F.col("ratio") > 0) == F.col("coding"))
    # as well as the families that the columns were drawn from
    known = C.codon_ratios(frame, tree, C.TwoClasses(true[True], true[False], 0.0)).withColumn("right", (F.col("ratio") > 0) == F.col("coding"))
    fitted, best = (df.agg(F.avg(F.col("right").cast("int"))).first()[0] for df in (scored, known))
    assert best > 0.7 and fitted > best - 0.02
    only = C.fitted_classes(frame.where("coding"), tree, omegas=(0.1,), paces=(1.0,))
    assert only.other.omega == 1.0 and only.odds > 7
