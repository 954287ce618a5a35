"""Work in rounds and sweeps against plain sequential versions."""

import hashlib
import os
import random
import re

import duckdb
import pytest

from palimpsest.operators import fragments, grammar, intervals
from palimpsest.plans import oracle
from palimpsest.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def random_places(r, collection, versions, n_tokens, alphabet):
    """Candidate blocks of random versions on several levels, with their tokens as hash."""
    rows = set()
    for v in range(versions):
        toks = [r.choice(alphabet) for _ in range(n_tokens)]
        cuts = sorted({0, n_tokens, *(r.randrange(n_tokens) for _ in range(n_tokens // 3))})
        base = list(zip(cuts, cuts[1:], strict=False))
        for k in range(3):
            for (a, _), (_, b) in zip(base, base[k:], strict=False):
                rows.add((collection, "".join(toks[a:b]), v, a, b - a))
    return sorted(rows)


@pytest.mark.parametrize("grammar", [False, True])
def test_cover_in_rounds_equals_the_sequential_choice(spark, grammar):
    r = random.Random(5 + grammar)
    rows = random_places(r, "one", 4, 30, "ab") + random_places(r, "two", 3, 40, "abcdef") + random_places(r, "three", 1, 25, "xyz")
    # runs of one letter overlap themselves; some versions stand for several
    rows += sorted({("four", "a" * n, 0, o, n) for n in (1, 2, 3) for o in range(0, 12 - n)} | {("four", "a", 0, 11, 1)})
    copies = [(c, v, 1 + (v % 3) * 2) for c in ("one", "two", "three", "four") for v in range(4)]
    cut = spark.createDataFrame([(c, h, v, o, o + n, n) for c, h, v, o, n in rows], "collection string, hash string, version int, start int, end int, len int")
    many = spark.createDataFrame(copies, "collection string, version int, copies long")
    weights = [0.01, 3.0]
    got = {tuple(x) for x in fragments.select_covers(cut, weights, grammar, many, group_places=0).collect()}
    want = set()
    for c in ("one", "two", "three", "four"):
        frags: dict = {}
        for cc, h, v, o, n in rows:
            if cc == c:
                frags.setdefault(h, (n, []))[1].append((v, o))
        for w in weights:
            want |= {(c, w, *x) for x in fragments.cover(frags, w, grammar, {v: k for cc, v, k in copies if cc == c})}
    assert got == want
    # the bounded groups give the same, and so do both kinds side by side
    assert {tuple(x) for x in fragments.select_covers(cut, weights, grammar, many).collect()} == want
    assert {tuple(x) for x in fragments.select_covers(cut, weights, grammar, many, group_places=60).collect()} == want


def test_sweep_against_all_pairs(spark):
    r = random.Random(2)
    rows = []
    for version in range(6):
        for _ in range(r.choice([0, 1, 60])):
            a = r.randrange(100)
            rows.append((version % 2, version, a, a + r.choice([1, 2, 5, 40, 200]), len(rows)))
    rows += [(None, 9, 0, 5, 900), (None, 9, 4, 6, 901), (0, 0, 10, 20, 902), (0, 0, 10, 20, 903)]
    df = spark.createDataFrame(rows, "c int, v int, start int, end int, id int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((min(x["a_id"], x["b_id"]), max(x["a_id"], x["b_id"])) for x in intervals.overlapping(df, ("c", "v"), "id").collect())
        inside = sorted((x["a_id"], x["b_id"]) for x in intervals.containing(df, ("c", "v"), "id").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same = [(x, y) for x in rows for y in rows if x[:2] == y[:2] and x[4] != y[4]]
    assert got == sorted((x[4], y[4]) for x, y in same if x[4] < y[4] and x[2] < y[3] and y[2] < x[3])
    assert inside == sorted((x[4], y[4]) for x, y in same if x[2] <= y[2] and x[3] >= y[3])


def test_grammar_in_rounds_equals_the_sequential_grammar(spark):
    r = random.Random(9)
    collections = {}
    for c in range(14):
        letters = "abcdef"[: r.randint(1, 6)]
        collections[c] = [[r.choice(letters) for _ in range(r.randint(0, 40))] for _ in range(r.randint(1, 4))]
    # a passage that occurs in several versions, runs, an empty collection
    passage = [f"w{i}" for i in range(30)]
    collections[50] = [["x", *passage, "y"], [*passage, "z", *passage[:11]], []]
    collections[51] = [["a"] * 37, ["a"] * 8 + ["b"] + ["a"] * 9]
    collections[52] = [[]]
    df = spark.createDataFrame([(c, v, t) for c, vs in collections.items() for v, t in enumerate(vs)], "collection long, version long, toks array<string>")
    want = {(c, v, k, i, a, b) for c, vs in collections.items() for v, nodes in enumerate(grammar.repair_nodes(vs, 8)) for i, (k, a, b) in enumerate(nodes)}
    assert {tuple(x) for x in grammar.repair_cut(df, 8, group_tokens=0).collect()} == want
    assert {tuple(x) for x in grammar.repair_cut(df, 8, group_tokens=60).collect()} == want
    assert {tuple(x) for x in grammar.repair_cut(df, 8).collect()} == want


def fixture_dir(spark, tmp_path):
    """Two passages that versions share, runs, single documents and empty ones."""
    r = random.Random(1)
    shared = " ".join(r.choice(["ab", "cd", "ef", "gh"]) for _ in range(40))
    head = " ".join(f"h{k}" for k in range(10))
    texts = [f"{head} {shared} x{k} {shared[: 30 + k]}" for k in range(4)] + [head + " " + "z " * 25, "q w e", "", None, "lone " * 12]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), texts


def test_grammar_queries_on_a_fixture(spark, tmp_path):
    """repair_dictionary and cover_grammar_choice from sequential grammars and covers."""
    at, texts = fixture_dir(spark, tmp_path)
    collections = {}
    for t in texts:
        toks = re.findall("[a-z0-9]+", (t or "").lower())
        grams = [hashlib.md5(" ".join(toks[i : i + 10]).encode()).hexdigest() for i in range(len(toks) - 9)]
        collections.setdefault(min(grams, default=hashlib.md5(" ".join(toks).encode()).hexdigest()), []).append(toks)
    assert max(map(len, collections.values())) > 1
    size, chosen = set(), set()
    for c, versions in collections.items():
        frags = {}
        for v, nodes in enumerate(grammar.repair_nodes(versions, 8)):
            for a, b in {(a, b) for _, a, b in nodes}:
                frags.setdefault(hashlib.md5(" ".join(versions[v][a:b]).encode()).hexdigest(), (b - a, []))[1].append((v, a))
        size |= {(c, h, n, len(apps)) for h, (n, apps) in frags.items()}
        ranks = {}
        for rank, h, v, o, n in fragments.cover(frags, 1.0, True):
            ranks.setdefault((rank, h, n), []).append((v, o))
        chosen |= {(c, rank, h, n, len(apps), *min(apps), 0) for (rank, h, n), apps in ranks.items()}
    assert {tuple(x) for x in QUERIES["repair_dictionary"](spark, at).select("collection", "hash", "len", "size").collect()} == size
    cols = ("collection", "rank", "hash", "len", "size", "version", "offset", "faults")
    assert {tuple(x) for x in QUERIES["cover_grammar_choice"](spark, at).select(*cols).collect()} == chosen


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_sweep_against_sequential_sql(spark):
    """sweep_tradeoff at three of its weights, chosen one fragment at a time by a recursion in DuckDB."""
    weights = [0.01, 5, 50]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(
        oracle.recursive(*oracle._CUT, oracle.levels(3), *oracle.greedy_cover(weights), select="SELECT collection, w, sum(size)::BIGINT, count(*), sum(len)::BIGINT, sum(size * len)::BIGINT, 0 FROM chosen GROUP BY collection, w")
    ).fetchall()
    rows = QUERIES["sweep_tradeoff"](spark, SF)
    assert rows.select("w").distinct().count() == len(oracle.SWEEP)
    got = rows.where(rows["w"].isin([float(w) for w in weights])).select("collection", "w", "n_apps", "n_frags", "n_postings", "covered", "faults")
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
