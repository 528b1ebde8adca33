"""Messy documents, and plain re-implementations to compare with."""

import random
import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns with names that operators use inside.
CLASH = ", n_words int, cid int, tokens int, lf_id int, shard int, component_id int"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint" + CLASH


def words_of(rng, n, size=400):
    return " ".join("w" + str(rng.randrange(size)) for _ in range(n))


def messy():
    """Null and empty texts, odd letters, one word, repeats, near copies and a very long text."""
    rng = random.Random(5)
    base = words_of(rng, 120)
    swap = base.split()
    swap[60] = "other"
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ÉÀ ß 中文 İ two"), (5, base), (6, base), (7, base.upper()), (8, " ".join(swap)), (9, base + " tail"), (10, "a\n\nb\n" + "same line here\n" * 3)]
    rows += [(20 + i, words_of(rng, rng.randrange(1, 60))) for i in range(20)]
    rows += [(50, words_of(rng, 30_000, 10**6)), (51, "x" * 50_000), (52, "a b c"), (53, "A B C"), (54, "\r\n\x0b\x0c\x85 ")]
    return rows


def frame(spark, rows):
    full = [(i, t, None if k % 5 == 0 else "l" + str(k % 3), None if k % 4 == 0 else "s" + str(k % 2), None, 1, 2, 3, 4, 5, 6) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def shingle_set(text, size=4):
    w = SPACED.findall((text or "").translate(TO_LOWER))
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def jaccard_components(rows, size=4, percent=85):
    """``doc_id -> (n_shingles, component, links)`` by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for v in holders.values():
        for j in range(len(v)):
            for k in range(j):
                shared[v[k], v[j]] += 1
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = defaultdict(set)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
            if sets[a] != sets[b]:
                links[a].add(sets[b])
                links[b].add(sets[a])
    return {i: (len(s), find(i), len(links[i])) for i, s in sets.items()}
