"""Batches of whole collections against plain sequential versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from palimpsest import scratch
from palimpsest.operators import covers, fragments, grammar, kernels
from palimpsest.plans import queries


def random_collections(seed):
    r = random.Random(seed)
    out = [[[r.choice("abcdef"[: r.randint(1, 6)]) for _ in range(r.randint(0, 60))] for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 5))]
    passage = [f"w{i}" for i in range(30)]
    return [*out, [["x", *passage, "y"], [*passage, "z", *passage[:11]], []], [["a"] * 37, ["a"] * 8 + ["b"] + ["a"] * 9], [[]]]


def flat(collections):
    versions = [v for c in collections for v in c]
    number = np.array([i for i, c in enumerate(collections) for _ in c])
    return pa.array([t for v in versions for t in v], pa.string()), np.concatenate([[0], np.cumsum([len(v) for v in versions])]), number


def test_grammars_of_a_batch():
    for seed in range(60):
        collections = random_collections(seed)
        at, *nodes = grammar.repair_batch(*flat(collections), 8)
        rows = list(zip(*(x.tolist() for x in nodes), strict=True))
        assert [rows[a:b] for a, b in zip(at, at[1:], strict=False)] == [n for c in collections for n in grammar.repair_nodes(c, 8)]


def test_whole_groups_are_bounded():
    keys = [k for k in range(40) for _ in range(1 + k % 5)]
    rows = pa.record_batch({"k": pa.array(keys), "n": pa.array([3] * len(keys), pa.int32())})
    got = list(kernels.whole_groups([rows.slice(a, 7) for a in range(0, len(keys), 7)], 20))
    assert [k for t in got for k in t.column("k").to_pylist()] == keys
    seen = [set(t.column("k").to_pylist()) for t in got]
    assert sum(map(len, seen)) == 40
    assert all(3 * t.num_rows <= 20 for t in got) and len(got) < 40
    assert [t.num_rows for t in kernels.whole_groups([rows], 1)] == [1 + k % 5 for k in range(40)]


def test_covers_of_a_batch():
    for seed in range(120):
        r = random.Random(seed)
        rows = set()
        for c in range(r.randint(1, 4)):
            for v in range(r.randint(1, 3)):
                toks = [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(1, 40))]
                for _ in range(r.randint(1, 60)):
                    a = r.randrange(len(toks))
                    rows.add((c, v, a, (run := "".join(toks[a : a + r.randint(1, 6)])), len(run)))
        rows = sorted(rows, key=lambda x: r.random())
        copies = {(c, v): 1 + (c + v) % 3 for c, v, *_ in rows}
        c, v, a, n = (np.array([x[i] for x in rows]) for i in (0, 1, 2, 4))
        # any numbers whose order is the text's
        names = sorted({x[3] for x in rows})
        high, low = (np.array([f(names.index(x[3])) for x in rows], np.uint64) for f in (lambda k: k // 3, lambda k: k % 3))
        weights, by_grammar = [0.01, 3.0, 40.0], seed % 2 == 0
        got = covers.cover_batch(c, v, np.array([copies[x[:2]] for x in rows]), a, n, high, low, weights, by_grammar)
        for w, (places, ranks) in zip(weights, got, strict=True):
            want = set()
            for k in set(c.tolist()):
                frags: dict = {}
                for x in rows:
                    if x[0] == k:
                        frags.setdefault(x[3], (x[4], []))[1].append((x[1], x[2]))
                want |= {(k, *x) for x in fragments.cover(frags, w, by_grammar, {vv: m for (cc, vv), m in copies.items() if cc == k})}
            assert {(rows[p][0], q, rows[p][3], *rows[p][1:3], rows[p][4]) for p, q in zip(places.tolist(), ranks.tolist(), strict=True)} == want


def test_faults_are_told(spark):
    toks = "a b c d".split()
    h = lambda a, n: hashlib.md5(" ".join(toks[a : a + n]).encode()).hexdigest()
    good = [(1.0, 0, h(0, 2), 0, 2, True), (1.0, 1, h(2, 2), 2, 2, True)]
    cases = {"right": good, "gap": good[:1], "overlap": [*good, (1.0, 2, h(1, 2), 1, 2, True)], "hash": [good[0], (1.0, 1, "x", 2, 2, True)], "outside": [good[0], (1.0, 1, h(2, 2), 2, 3, True)], "none": []}
    df = spark.createDataFrame([(c, 0, toks, apps) for c, apps in cases.items()], f"collection string, version long, toks array<string>, apps {covers.APPS}")
    got = {x.collection: (x.n_apps, x.covered, x.faults) for x in covers.checked(df).collect()}
    assert got == {"right": (2, 4, 0), "gap": (1, 2, 1), "overlap": (3, 6, 1), "hash": (2, 4, 1), "outside": (2, 5, 2)}


def test_large_collections_have_the_same_covers(spark):
    r = random.Random(4)
    base = [f"t{r.randrange(9)}" for _ in range(90)]
    rows = [(c, v, base[: 60 + 10 * (v % 3)] if c else base[v:]) for c in range(2) for v in range(5)] + [(2, 0, [])]
    df = spark.createDataFrame(rows, "collection long, version long, toks array<string>")
    for by_grammar in (False, True):
        small, large = (sorted(map(tuple, covers.applications(covers.covers(df, [1.0, 9.0], by_grammar, n)).collect())) for n in (10**6, 60))
        assert small == large and sum(x[-1] for x in small) < len(small)


def test_copied_runs():
    r = random.Random(6)
    for n in (1, 2, 5):
        pairs = [([r.choice("ab") for _ in range(r.randint(0, 30))], [r.choice("abc") for _ in range(r.randint(0, 30))]) for _ in range(40)]
        pairs += [(list("xabcdefy"), list("abcdefabcdef")), ([], list("abc"))]
        kind = pa.list_(pa.string())
        at, *cols = kernels.copied_runs(pa.array([a for a, _ in pairs], kind), pa.array([b for _, b in pairs], kind), n)
        rows = list(zip(*(c.tolist() for c in cols), strict=True))
        for k, (toks, reference) in enumerate(pairs):
            first: dict = {}
            for p in range(len(reference) - n + 1):
                first.setdefault(tuple(reference[p : p + n]), p)
            hits = {(p, first[g]) for p in range(len(toks) - n + 1) if (g := tuple(toks[p : p + n])) in first}
            want = set()
            for p, q in hits:
                if (p - 1, q - 1) not in hits:
                    m = 0
                    while (p + m, q + m) in hits:
                        m += 1
                    want.add((q, p, m + n - 1))
            assert len(rows[at[k] : at[k + 1]]) == len(want) and set(rows[at[k] : at[k + 1]]) == want


def test_chosen_fragments_of_batches_and_rounds(spark):
    """products() by one batch, by folding a collection that its copies make large, and by rounds; sizes count copies."""
    r = random.Random(6)
    base = [r.choice("abcdefgh") for _ in range(40)]
    collections = {"a": [base] * 5 + [base[:25] + ["x"] + base[25:]], "b": [[r.choice("pqr") for _ in range(30)]], "c": [[]]}
    df = spark.createDataFrame([(c, v, t) for c, vs in collections.items() for v, t in enumerate(vs)], "collection string, version long, toks array<string>")
    want = set()
    for c, vs in collections.items():
        own = {v: vs.index(t) for v, t in enumerate(vs)}
        lead, frags = sorted(set(own.values())), {}
        for v, nodes in zip(lead, grammar.repair_nodes([vs[v] for v in lead], 8), strict=True):
            for a, b in {(a, b) for _, a, b in nodes}:
                frags.setdefault(hashlib.md5(" ".join(vs[v][a:b]).encode()).hexdigest(), (b - a, []))[1].append((v, a))
        copies, ranks = {v: list(own.values()).count(v) for v in lead}, {}
        for rank, h, v, o, n in fragments.cover(frags, 1.0, True, copies):
            ranks.setdefault((rank, h, n), []).append((v, o))
        want |= {(c, 1.0, k, h, n, sum(copies[v] for v, _ in apps), *min(apps), 0) for (k, h, n), apps in ranks.items()}
    assert any(x[5] > 5 for x in want)
    for limit in (1_000_000, 100, 50):
        assert {tuple(x) for x in covers.products(df, [1.0], True, limit).collect()} == want, limit


def test_chosen_fragments_exchange_texts_once(spark):
    """No application is exchanged or grouped: the plan's one exchange deals texts to whole collections."""
    plan = queries.QUERIES["cover_grammar_choice"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert sum(line.lstrip(" :+-*()0123456789").startswith("Exchange") for line in plan.splitlines()) == 1, plan


def test_rounds_keep_few_tables_and_small_broadcasts(spark):
    tables = []
    for k in range(20):
        tables = scratch.collected([*tables, scratch.table(spark.range(k, k + 1), "t")], "t")
        assert len(tables) <= scratch.MANY_TABLES
    (one,) = scratch.collected(tables, "t", True)
    assert sorted(x.id for x in one.collect()) == list(range(20))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    with scratch.lean(spark):
        assert spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() == scratch.BROADCAST_BYTES
    spark.conf.set(key, "-1")
    try:
        with scratch.lean(spark):
            assert spark.conf.get(key) == "-1"
    finally:
        spark.conf.set(key, before)
