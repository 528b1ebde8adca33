import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from locusframe.llm import filter_audit, lm_scores, periodic_runs

from .helpers import SPACED, TO_LOWER, frame, messy, words_of

LABEL_SCHEMA = "doc_id bigint, quality int, toxic int, part string, mask int"


def brute_audit(docs, labels):
    """Every document through every order, one at a time.  ``docs``: (doc_id, text, source)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed = []
    for i, text, source in docs:
        t = text or ""
        w = SPACED.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        failed.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = defaultdict(lambda: [0] * 6), Counter()
    for part in {p for p, *_ in failed}:
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                row = out[part, "".join(order), step]
                for own, fails, is_good, is_toxic in failed:
                    if own == part:
                        first = next((g for g in order if g in fails), None)
                        gone = first == f
                        row[0] += not fails & set(order[:step])
                        row[1] += gone
                        row[2] += f in fails and not gone and bool(fails & set(order[: step - 1]))
                        row[3] += fails == {f}
                        row[4] += gone and is_good
                        row[5] += gone and is_toxic
                        shapley[part, f] += gone
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in rows}
    assert len(out) == len(rows)
    return out


def test_filter_audit(spark):
    rng = random.Random(3)
    rows = [*messy(), (None, "a b c"), (None, None), (52, "a b c"), (5, "again"), (70, words_of(rng, 250, 10**6)), (71, words_of(rng, 250, 10**6) + " #"), (72, "ABCDEF " + words_of(rng, 230, 10**6)), (73, words_of(rng, 250, 3))]
    docs = frame(spark, rows)
    labels = [(5, 1, 0), (5, 1, 1), (6, 1, 1), (70, 1, 0), (71, 0, 1), (72, None, 1), (None, 1, 1), (999, 1, 1), (73, 1, None)]
    got = audited(filter_audit.audit(docs, spark.createDataFrame([(*x, "p", 1) for x in labels], LABEL_SCHEMA)))
    want = brute_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], labels)
    assert got == want
    assert {v[3] for v in got.values()} != {0} and {v[5] for v in got.values()} != {0}


def test_filter_audit_of_nothing(spark):
    docs, labels = frame(spark, []), spark.createDataFrame([], LABEL_SCHEMA)
    assert filter_audit.audit(docs, labels).count() == 0
    assert len(audited(filter_audit.audit(frame(spark, [(1, None)]), labels))) == 600


def test_parity_sums_come_back_as_cells(spark):
    rng = random.Random(4)
    rows = [(p, rng.randrange(32), rng.random() < 0.3, rng.random() < 0.1) for p in ("", "x", "y") for _ in range(500)] + [("one", 31, True, False)]
    sums = filter_audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"))
    for r in filter_audit.mask_cells(sums).collect():
        own = [x for x in rows if x[0] == r["part"]]
        assert r["all"] == [sum(m == x[1] for x in own) for m in range(32)]
        assert r["good"] == [sum(m == x[1] and x[2] for x in own) for m in range(32)]
        assert r["toxic"] == [sum(m == x[1] and x[3] for x in own) for m in range(32)]


def brute_runs(words, min_length=24, min_periods=3):
    """Every period of every stretch, by definition."""

    def smallest_period(w):
        fail, k = [0], 0
        for i in range(1, len(w)):
            while k and w[i] != w[k]:
                k = fail[k - 1]
            k += w[i] == w[k]
            fail.append(k)
        return len(w) - fail[-1]

    out = []
    for q in range(1, len(words) // min_periods + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_periods * q) and smallest_period(words[i : j + q]) == q:
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out)


def planted_words(doc_id, text):
    w = SPACED.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def collapsed_words(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng):
    """Words of a small alphabet with repeats at several scales."""
    out = []
    while len(out) < rng.randrange(1, 300):
        kind = rng.randrange(4)
        if kind == 0:
            out += [rng.randrange(3) for _ in range(rng.randrange(1, 20))]
        elif kind == 1:
            unit = [rng.randrange(2) for _ in range(rng.randrange(1, 12))]
            out += unit * rng.randrange(2, 8) + unit[: rng.randrange(len(unit))]
        elif kind == 2 and out:
            out += out[-rng.randrange(1, len(out) + 1) :]
        else:
            out += [rng.randrange(1000)]
    return out


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (10, 4)])
def test_runs_against_definition(least, times):
    rng = random.Random(least)
    some = 0
    for _ in range(150):
        words = repetitive(rng)
        got = periodic_runs.runs_of(words, least, times)
        assert got == brute_runs(words, least, times)
        some += len(got)
    assert some > 100


def test_end_positions_keep_order():
    rng = random.Random(1)
    values = rng.sample(range(10**6), 5000)
    own, plain = periodic_runs.EndPositions(values[0]), [values[0]]
    for x in values[1:]:
        before, after = own.add(x)
        assert before == max((y for y in plain if y < x), default=-1) if len(plain) < 300 else True
        assert after == min((y for y in plain if y > x), default=-1) if len(plain) < 300 else True
        plain.append(x)
    assert list(own) == sorted(values) and own.size == len(values)


def test_op13_against_definition(spark, tmp_path):
    rng = random.Random(9)
    rows = [*messy()[:-5], (None, "a b " * 30), (50, "x " * 3000), (52, "a b c"), (52, "a b c")]
    rows += [(100 + i, words_of(rng, rng.randrange(1, 200))) for i in range(100)]
    rows += [(300 + i, " \t".join(f"W{x}é" for x in repetitive(rng)) + "\n") for i in range(40)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in rows:
        w = planted_words(i, t)
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed_words(w, runs))))
    got = [tuple(r) for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 30


def test_periodic_runs_of_nothing(spark):
    assert periodic_runs.periodic_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(frame(spark, []), min_periods=1)


def brute_scores(rows, folds):
    """The same model with dictionaries; also a function for its probabilities."""
    texts = [(i, [*SPACED.findall((t or "").translate(TO_LOWER)), None]) for i, t in rows]
    number = lambda i: zlib.crc32(str(i).encode())
    test = lambda i: i is None or number(i) % 7 == 2
    fold = lambda i: not test(i) and number(i) // 7 % folds == 0

    def counted(chosen):
        one, two = Counter(), Counter()
        for i, w in texts:
            if chosen(i):
                one.update(w)
                two.update(zip([None, *w], w, strict=False))
        return one, two

    (c1, c2), (e1, e2) = counted(lambda i: not test(i)), counted(lambda i: not test(i) and not fold(i))
    n, v = sum(c1.values()), len(c1)

    def parts(one, two, a, w):
        total = max(sum(one.values()), 1)
        return [two[a, w] / one[a] if one[a] else 0.0, one[w] / total, 1 / (v + 1)]

    held = Counter()
    for i, w in texts:
        if fold(i):
            held.update(zip([None, *w], w, strict=False))
    total = max(sum(e1.values()), 1)
    rows_ = [(e1[a].bit_length(), [e2[a, w] / e1[a] if e1[a] else 0.0, e1[w] / total, 1 / (v + 1)], k) for (a, w), k in held.items()]
    shares = {}

    def weights():
        whole = [sum(s[k] for s in shares.values()) for k in range(3)]
        out = {}
        for b in range(lm_scores.BUCKETS):
            s = list(shares.get(b, whole))
            s = s if sum(s) else [1.0, 1.0, 1.0]
            if b == 0:
                s = [0.0, *s[1:]] if s[1] + s[2] else [0.0, 1.0, 1.0]
            out[b] = [x / sum(s) for x in s]
        return out

    now, before = weights(), -math.inf
    for _ in range(lm_scores.ROUNDS):
        shares, ll = defaultdict(lambda: [0.0] * 3), 0.0
        for b, p, k in rows_:
            own = [x * y for x, y in zip(p, now[b], strict=True)]
            ll += k * math.log(sum(own))
            for j in range(3):
                shares[b][j] += k * own[j] / sum(own)
        now = weights()
        if not rows_ or ll - before <= lm_scores.ENOUGH * abs(ll):
            break
        before = ll

    def probability(a, w):
        p = [c2[a, w] / c1[a] if c1[a] else 0.0, c1[w] / max(n, 1), 1 / (v + 1)]
        return sum(x * y for x, y in zip(p, now[c1[a].bit_length()], strict=True))

    out = []
    for i, w in texts:
        base = sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w)
        out.append((i, test(i), len(w), sum(c1[x] > 0 for x in w), n, base, sum(math.log10(probability(a, x)) for a, x in zip([None, *w], w, strict=False))))
    return out, probability, c1


def rounded(rows):
    return sorted(repr([round(x, 5) if isinstance(x, float) else x for x in r]) for r in rows)


def scoring_rows():
    rng = random.Random(12)
    rows = [*messy()[:-5], (52, "a b c"), (52, "a b c"), (52, "other"), (None, "a b c"), (None, None), (None, None), (53, "A B C"), (54, "\r\n\x0b\x0c\x85 ")]
    pick = lambda: "w" + str(int(rng.paretovariate(0.5)) % 3000)
    return rows + [(100 + i, " ".join(pick() for _ in range(rng.randrange(300)))) for i in range(250)]


@pytest.mark.parametrize("tier", [lm_scores.TIER, 900, 20, 0])
def test_lm_scores(spark, tier):
    rows = scoring_rows()
    want, probability, counts = brute_scores(rows, 5)
    got = lm_scores.scores(frame(spark, rows), tier, 5)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert rounded(got.collect()) == rounded(want)
    assert sum(r[-1] for r in want if r[1]) > sum(r[-2] for r in want if r[1])
    if tier == 0:
        for a in (None, "w1", "w2999", "never"):
            assert abs(sum(probability(a, w) for w in counts) + probability(a, "never") - 1) < 1e-9


@pytest.mark.parametrize("rows", [[], [(None, "a b")], [(1, None)], [(1, "a b a"), (2, "a")]])
def test_lm_scores_of_few(spark, rows):
    assert rounded(lm_scores.scores(frame(spark, rows)).collect()) == rounded(brute_scores(rows, lm_scores.FOLDS)[0])
