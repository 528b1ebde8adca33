"""Gene ranges against brute force on random graphs and alignments."""

import itertools
import random
from collections import defaultdict

import pytest

from locusframe.operators import ranges

ROWS = "ali bigint, species string, seq string, strand string, start bigint, end bigint, len bigint, path int"


def random_rows(rng, n, species=4, seqs=2):
    out = []
    for a in range(n):
        at = rng.randrange(2000)
        for s in rng.sample(range(species), rng.randrange(1, species + 1)):
            start = at + rng.randrange(-60, 60) + 100
            size = rng.randrange(5, 60)
            out.append((a, f"s{s}", f"c{rng.randrange(seqs)}" if rng.random() < 0.2 else "c0", "+" if rng.random() < 0.9 else "-", start, start + size, rng.randrange(1, size + 1)))
    return out


def brute_edges(rows, max_gap, fraction):
    by, lines = defaultdict(dict), defaultdict(list)
    for a, sp, c, d, s, e, n in rows:
        by[a][sp] = (c, d, s, e, n)
        lines[sp, c, d].append((s, e, a))
    out = set()
    for line in lines.values():
        line.sort()
        for (*_, u), (*_, v) in itertools.pairwise(line):
            both = by[u].keys() & by[v].keys()
            bad = sum(by[u][x][:2] != by[v][x][:2] or not 0 <= by[v][x][2] - by[u][x][3] - 1 <= max_gap for x in both)
            if u != v and bad <= int((1 - fraction) * len(both) + 1e-9):
                out.add((u, v))
    return out


def test_edges(spark):
    rng = random.Random(1)
    rows = random_rows(rng, 120)
    got = {(r.u, r.v) for r in ranges.alignment_edges(spark.createDataFrame([(*r, 1) for r in rows], ROWS), 150, 0.6).collect()}
    assert got == brute_edges(rows, 150, 0.6) and len(got) > 30


def every_path(weights, edges):
    after = defaultdict(list)
    for u, v in edges:
        after[u].append(v)
    stack = [[v] for v in weights]
    while stack:
        path = stack.pop()
        yield path
        stack += [[*path, v] for v in after[path[-1]]]


def test_heaviest_paths_against_all_paths():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 9)
        weights = {v: rng.randrange(1, 30) for v in range(n)}
        edges = [(u, v) for u in range(n) for v in range(u + 1, n) if rng.random() < 0.35]
        whole = {v for v in weights if rng.random() < 0.7}
        exact = {v for v in whole if rng.random() < 0.7}
        covered, more = set(), sum(weights.values()) + 1
        paths = ranges.heaviest_paths(weights, edges, whole, exact)
        for path in [*paths, None]:
            value = lambda p: sum(weights[v] + (more if v in exact - covered else 0) for v in p)  # noqa: E731, B023
            top = max(map(value, every_path(weights, edges)))
            if path is None:
                # what ends the search is a heaviest path that covers nothing new
                assert any(value(p) == top and not (set(p) & whole) - covered for p in every_path(weights, edges))
            else:
                assert value(path) == top and all((u, v) in set(edges) for u, v in itertools.pairwise(path)) and (set(path) & whole) - covered
                covered |= set(path) & whole
        assert exact <= covered


def test_circles_are_cut():
    assert ranges.heaviest_paths({1: 5, 2: 5, 3: 5}, [(1, 2), (2, 3), (3, 1)], {1, 2, 3}, {1, 2, 3}) == [[1, 2, 3]]


def brute_pruned(paths):
    paths = {p: list(v) for p, v in paths.items()}
    while True:
        total = {p: sum(w for _, w in v) for p, v in paths.items()}
        cuts = {}
        for p, own in paths.items():
            for o, other in paths.items():
                if (total[o], -o) > (total[p], -p):
                    for turn, k in ((lambda x: x, 0), (lambda x: x[::-1], 1)):
                        a, b = turn(own), turn(other)
                        for i in range(len(b)):
                            n = 0
                            while n < len(a) and i + n < len(b) and a[n][0] == b[i + n][0] and b[i + n][1] >= a[n][1]:
                                n += 1
                            cuts.setdefault(p, [0, 0])[k] = max(cuts.get(p, [0, 0])[k], n)
        if not any(map(any, cuts.values())):
            return {p: [x for x, _ in v] for p, v in paths.items() if v}
        paths = {p: v[cuts.get(p, [0, 0])[0] : len(v) - cuts.get(p, [0, 0])[1]] if sum(cuts.get(p, [0, 0])) < len(v) else [] for p, v in paths.items()}
        paths = {p: v for p, v in paths.items() if v}


def test_pruned_paths(spark):
    rng = random.Random(3)
    paths = {}
    for p in range(40):
        own = sorted(rng.sample(range(14), rng.randrange(1, 9)))
        paths[p] = [(x, rng.choice([10, 10, 20])) for x in own]
    rows = [(p, 7, i, x, w) for p, v in paths.items() for i, (x, w) in enumerate(v)]
    found = defaultdict(dict)
    for r in ranges.pruned_paths(spark.createDataFrame(rows, "path bigint, sid bigint, pos bigint, ali bigint, weight bigint")).collect():
        found[r.path][r.pos] = r.ali
    assert {p: [v[i] for i in range(len(v))] for p, v in found.items()} == brute_pruned(paths)


def brute_ranges(rows, max_gap, fraction, most, mean):
    by = defaultdict(dict)
    for a, sp, c, d, s, e, n in rows:
        by[a][sp] = (c, d, s, e, n)
    sig = {a: frozenset((sp, c, d) for sp, (c, d, *_) in v.items()) for a, v in by.items()}
    text = lambda s: "\n".join(sorted("\t".join(x) for x in s))
    bases = defaultdict(int)
    for a, v in by.items():
        bases[sig[a]] += sum(x[4] for x in v.values())
    order = sorted(bases, key=lambda s: (-bases[s], text(s)))
    chosen = set(order[:most]) | {s for s in order if bases[s] >= mean * len({r[1] for r in rows})}
    edges = brute_edges(rows, max_gap, fraction)
    result = []
    for s in chosen:
        fits = {a: {x[0] for x in s if x in sig[a]} for a in by}
        nodes = {a: sum(by[a][x][4] for x in f) for a, f in fits.items() if len(f) >= 2}
        links = [(u, v) for u, v in edges if sum(0 <= by[v][x][2] - by[u][x][3] - 1 <= max_gap for x in fits[u] & fits[v]) >= 2]
        reach = {a: a for a in nodes}
        for _ in nodes:
            for u, v in links:
                reach[u] = reach[v] = min(reach[u], reach[v])
        for root in set(reach.values()):
            own = {a: nodes[a] for a in nodes if reach[a] == root}
            whole = {a for a in own if sig[a] <= s}
            result += [(s, p, own) for p in ranges.heaviest_paths(own, [(u, v) for u, v in links if u in own], whole, {a for a in own if sig[a] == s})]
    return by, result


def test_gene_ranges_cover_the_brute_force_paths(spark):
    rng = random.Random(4)
    rows = random_rows(rng, 80, species=3, seqs=1)
    frame = spark.createDataFrame([(*r, 1) for r in rows], ROWS)
    by, want = brute_ranges(rows, 200, 0.6, 5, 10**9)
    chosen = ranges.followed_signatures(frame, 5, 10**9)
    nodes, edges = ranges.projected(frame, ranges.alignment_edges(frame, 200, 0.6), chosen, 200)
    found = defaultdict(dict)
    for r in ranges.alignment_paths(nodes, edges).collect():
        found[r.path][r.pos] = (r.ali, r.weight)
    paths = sorted([v[i] for i in range(len(v))] for v in found.values())
    assert paths == sorted([(a, own[a]) for a in p] for _, p, own in want) and len(paths) > 10
    got = ranges.gene_ranges(frame, 200, 0.6, 5, 10**9).collect()
    assert got and all(r.start <= r.end for r in got)
    left = {a for v in brute_pruned({k: v for k, v in enumerate(paths)}).values() for a in v}
    assert left == {a for p in paths for a, _ in p}
    # every alignment of a path is inside a range of each of its fitting species
    for s, p, _ in want:
        for a in p:
            for sp, (c, d, b, e, _n) in by[a].items():
                if (sp, c, d) in s:
                    assert any((r.species, r.seq, r.strand) == (sp, c, d) and r.start <= b and e <= r.end for r in got)


def test_large_components_are_cut(spark):
    rows = [(a, f"s{s}", "c", "+", 100 * a + s, 100 * a + 50 + s, 50, 1) for a in range(25) for s in range(2)]
    frame = spark.createDataFrame(rows, ROWS)
    whole = ranges.gene_ranges(frame, 100).collect()
    assert sorted((r.species, r.start, r.end, r.n_alignments) for r in whole) == [("s0", 0, 2450, 25), ("s1", 1, 2451, 25)]
    parts = ranges.gene_ranges(frame, 100, most_nodes=10).where("species = 's0'").collect()
    assert sorted((r.start, r.n_alignments) for r in parts) == [(0, 10), (1000, 10), (2000, 5)]
    assert ranges.gene_ranges(frame.where("false")).count() == 0


def random_fragments(rng, ali, species=3):
    out = []
    for s in range(species):
        c = a = rng.randrange(20)
        for _ in range(rng.randrange(1, 12)):
            n = rng.randrange(1, 25)
            out.append((ali, f"s{s}", "c", "+", c, a, n, 1))
            a += n + rng.randrange(0, 6)
            c += n + rng.choice([0, 1, 3, 40, 90])
    return out


def brute_cuts(fragments, cap):
    """The same rule column by column."""
    base = {s: {} for s in {f[1] for f in fragments}}
    for _, s, _, _, c, a, n, _ in fragments:
        base[s].update({a + i: c + i for i in range(n)})
    begins = {f[5] for f in fragments}
    top = max(a + 1 for v in base.values() for a in v)
    start, cuts = min(begins), []
    while True:
        spans = lambda col: [max(x) - min(x) + 1 for v in base.values() if (x := [c for a, c in v.items() if start <= a < col])]  # noqa: E731, B023
        if max(spans(top), default=0) <= cap:
            return cuts
        latest = max(c for c in range(start + 1, top + 1) if max(spans(c), default=0) <= cap)
        head = {s: min((a for a in v if a >= start), default=None) for s, v in base.items()}
        early = min(min((a for a, c in v.items() if c >= v[head[s]] + 2 * cap // 3), default=top + 1) for s, v in base.items() if head[s] is not None)

        def gap(col):
            total = 0
            for v in base.values():
                a, b = [c for x, c in v.items() if x < col], [c for x, c in v.items() if x >= col]
                total += min(b) - max(a) - 1 if a and b else 0
            return total

        options = [c for c in begins if max(early, start) < c < latest] + [latest]
        start = max(options, key=lambda c: (gap(c), c))
        cuts.append(start)


@pytest.mark.parametrize("cap", [7, 40, 150])
def test_capped_alignments(spark, cap):
    rng = random.Random(cap)
    rows = [f for ali in range(25) for f in random_fragments(rng, ali)]
    got = ranges.capped_alignments(spark.createDataFrame(rows, "ali bigint, species string, seq string, strand string, chr_pos bigint, ali_pos bigint, len bigint, cuts int"), cap).collect()
    spans, bases = defaultdict(list), defaultdict(int)
    for r in got:
        spans[r.ali, r.piece, r.species] += [r.chr_pos, r.chr_pos + r.len - 1]
        for i in range(r.len):
            bases[r.ali, r.species, r.chr_pos + i, r.ali_pos + i] += 1
    assert max(max(v) - min(v) + 1 for v in spans.values()) <= cap
    assert bases == {(a, s, c + i, p + i): 1 for a, s, _, _, c, p, n, _ in rows for i in range(n)}
    for ali in range(25):
        own = [f for f in rows if f[0] == ali]
        cuts = brute_cuts(own, cap)
        assert {r.piece for r in got if r.ali == ali} <= set(range(len(cuts) + 1))
        for r in got:
            if r.ali == ali:
                assert r.piece == sum(c <= r.ali_pos for c in cuts) == sum(c <= r.ali_pos + r.len - 1 for c in cuts)


def brute_thinned(rows, most, penalty):
    rows = list(rows)

    def cost(kept):
        depth = defaultdict(int)
        for _, sp, c, s, e in kept:
            for x in range(s, e + 1):
                depth[sp, c, x] += 1
        return depth

    while True:
        depth, gain = cost(rows), defaultdict(float)
        for p, sp, c, s, e in rows:
            for x in range(s, e + 1):
                d = depth[sp, c, x]
                gain[p] += penalty if d > most else -1 if d == 1 else 0
        gain = {p: round(g, 6) for p, g in gain.items() if round(g, 6) > 0}
        if not gain:
            return sorted(rows)
        touch = lambda a, b: a[1:3] == b[1:3] and a[3] <= b[4] and b[3] <= a[4]
        beaten = {a[0] for a in rows for b in rows if a[0] in gain and b[0] in gain and a[0] != b[0] and (gain[b[0]], b[0]) > (gain[a[0]], a[0]) and touch(a, b)}
        rows = [r for r in rows if r[0] not in gain or r[0] in beaten]


def test_thinned_ranges(spark):
    rng = random.Random(6)
    rows = [(p, f"s{k}", f"c{rng.randrange(2)}", s, s + rng.randrange(1, 60)) for p in range(40) for k in range(2) for s in [rng.randrange(200)]]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "path bigint, species string, seq string, start bigint, end bigint, gain int")
    got = sorted(tuple(r) for r in ranges.thinned_ranges(frame, 3, 0.2, 64).collect())
    assert got == brute_thinned(rows, 3, 0.2) and len(got) < len(rows)
    assert ranges.thinned_ranges(frame.where("false")).count() == 0


@pytest.mark.parametrize("steps, most_pieces, width", [(1, 0, 16), (3, 0, 64), (2, 150, 1 << 14)])
def test_thinned_ranges_in_steps_of_bounds(spark, monkeypatch, steps, most_pieces, width):
    """Steps through bins and paths leave what the rounds leave, wherever one task takes over, and write no table for each round."""
    rng = random.Random(steps)
    rows = [(p, f"s{k}", f"c{rng.randrange(3)}", s, s + rng.randrange(90)) for p in range(-30, 60) for k in range(rng.randrange(1, 4)) for s in [rng.randrange(-100, 250)]]
    # equal ranges, ranges of one path that overlap, and one alone
    rows += [(p, "s0", "c0", 10, 60) for p in range(100, 108)] + [(7, "s0", "c1", 0, 40), (7, "s0", "c1", 20, 60), (200, "s9", "c0", 1, 5)]
    frame = spark.createDataFrame(rows, "path bigint, species string, seq string, start bigint, end bigint")
    names, keep = [], ranges.written
    monkeypatch.setattr(ranges, "written", lambda df, name: names.append(name) or keep(df, name))
    got = sorted(tuple(r) for r in ranges.thinned_ranges(frame, 3, 0.2, width, steps, most_pieces).collect())
    assert got == brute_thinned(rows, 3, 0.2) and len(got) < len(rows)
    assert "thinned-depth" not in names
    # ranges without a path stay, and count for the depth of others
    loose = spark.createDataFrame([(None, "s0", "c0", 1, 50)] * 3 + [(0, "s0", "c0", 1, 50)], frame.schema)
    assert sorted(r.path is None for r in ranges.thinned_ranges(loose, 3, 0.2, width, steps, most_pieces).collect()) == [True] * 3
