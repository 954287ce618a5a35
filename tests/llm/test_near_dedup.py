"""op10 against brute force, with narrow and wide bands, and its parts."""

import random
import re

import numpy as np
import pytest

from palimpsest.llm import components as K
from palimpsest.llm import near_dedup as N

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = [bytes(x) for x in WORD.findall((text or "").encode())]
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return sorted((d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdEé") for _ in range(4))
    base = [[word() for _ in range(r.randint(3, 120))] for _ in range(12)]
    hot = [word() for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(hot if i % 3 == 0 else r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one"), (303, "ONE"), (304, "one two"), (305, "  one\ttwo "), (306, rows[0][1].upper()), (307, "x " * 20000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,wide,few", [(1, 48, 1 << 19), (2, 6, 0)])
def test_against_brute_force(spark, monkeypatch, seed, wide, few):
    monkeypatch.setattr(N, "WIDE", wide)
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "SALT", 8)
    monkeypatch.setattr(K, "FEW", few)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, key string")
    got = sorted(tuple(x) for x in N.near_duplicates(df, shingle=3, percent=85).collect())
    assert got == brute(rows, 3, 85)


@pytest.mark.parametrize("frequent", [256, 4, 0])
def test_prefixes_keep_every_pair(spark, monkeypatch, frequent):
    """Texts that share most of their words without being alike, some of them alike."""
    monkeypatch.setattr(N, "FREQUENT", frequent)
    monkeypatch.setattr(N, "WIDE", 20)
    r = random.Random(5)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for i in range(120):
        own = [f"o{i % 100}x{k}" for k in range(r.choice([5, 12, 30]))]
        w = common + own
        if i >= 100:
            w[r.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t, 3) for i, t in rows}
    numbers = {g: k for k, g in enumerate(sorted({g for s in sets.values() for g in s}))}
    got = N.prefixes(spark.createDataFrame([(i, [numbers[g] for g in s]) for i, s in sets.items()], "node long, s array<long>"), 85).collect()
    own = {i: {x.s for x in got if x.node == i} for i in sets}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                assert own[i] & own[j]
    assert sorted(tuple(x) for x in N.near_duplicates(df, shingle=3, percent=85).collect()) == brute(rows, 3, 85)


@pytest.mark.parametrize("few", [1 << 19, 0])
def test_components_of_hubs_and_chains(spark, monkeypatch, few):
    monkeypatch.setattr(K, "FEW", few)
    links = [(0, k) for k in range(1, 200)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5, 5), (3000, 2999), (2998, 3000)]
    got = {x.node: x.component for x in K.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(200)} | {1000 + k: 1000 for k in range(71)} | {2998: 2998, 2999: 2998, 3000: 2998}
    assert K.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_smallest_of_random_links():
    r = random.Random(9)
    for n, m in ((2, 1), (40, 25), (400, 380), (3000, 2500)):
        links = [(r.randrange(n) * 7 - n, r.randrange(n) * 7 - n) for _ in range(m)]
        parent = {x: x for link in links for x in link}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        a, b = np.array(links).T
        nodes, least = K.smallest(a, b)
        assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == {x: find(x) for x in parent}


def test_null_and_shared_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(None, t), (5, t), (5, "quite another text"), (7, t + " more"), (None, None), (7, t + " more"), (None, "lone text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in N.near_duplicates(df, shingle=3, percent=85).collect()), key=repr)
    assert got == sorted([(None, 58, 5, False), (5, 58, 5, True), (5, 1, 5, True), (7, 59, 5, False), (7, 59, 5, False), (None, 0, None, True), (None, 1, None, True)], key=repr)


def test_drop_keeps_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y")], "doc_id long, text string, kept string")
    assert [tuple(r) for r in N.drop_near_duplicates(df).collect()] == [(1, "a b c d e f", "x")]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_pruning_bound():
    least = N.least_matches(0.85, 1e-7)
    assert least == sorted(least) and len(least) == N.PERMS // N.BATCH
    rng = np.random.default_rng(1)
    a = rng.integers(0, 5, (2000, N.PERMS)).astype(np.uint32)
    b = np.where(rng.random(a.shape) < 0.85, a, a + 9).astype(np.uint32)
    assert len(N.survivors(a, b, least)) == 2000
    c = np.where(rng.random(a.shape) < 0.4, a, a + 9).astype(np.uint32)
    assert len(N.survivors(a, c, least)) < 20
