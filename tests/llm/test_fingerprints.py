"""op11 against DuckDB SQL, and the search against all pairs."""

import os
import random
import re

import duckdb
import numpy as np
import pytest

from palimpsest.llm import _text as T
from palimpsest.llm import fingerprints as K

SF = "/root/testdata/sf0.001"


def plain_components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = K.op11_fingerprints(spark, SF)
    want = con.execute(K.OP11_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("tile", [4, 2048])
def test_search_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(K, "TILE", tile)
    monkeypatch.setattr(K, "SMALL", 8)
    r = random.Random(3)
    prints = []
    for _ in range(12):
        base = r.getrandbits(128)
        for _ in range(r.randint(1, 25)):
            v = base
            for _ in range(r.randint(0, 6)):
                v ^= 1 << r.randrange(128)
            prints.append(v)
    # one class that shares most blocks, and copies
    prints += [prints[0] ^ (1 << r.randrange(16)) for _ in range(40)] + [prints[0]] * 30 + [0, 0]
    ids = list(range(len(prints)))
    r.shuffle(ids)
    rows = [(i, bytearray(p.to_bytes(16, "big"))) for i, p in zip(ids, prints, strict=True)]
    got = {bytes(x["fp"]): (x["n_near"], x["component_id"]) for x in K.near_fingerprints(spark.createDataFrame(rows, "doc_id long, fp binary")).collect()}
    by_id = dict(zip(ids, prints, strict=True))
    n = len(ids)
    links = [(a, b) for a in range(n) for b in range(a) if (by_id[a] ^ by_id[b]).bit_count() <= K.RADIUS]
    near = [sum(a in link for link in links) for a in range(n)]
    root = plain_components(n, links)
    assert all(got[p.to_bytes(16, "big")] == (near[i], root[i]) for i, p in by_id.items())


def test_every_radius_has_its_first_table():
    for radius in (1, 3, 6):
        first = K.first_tables(radius)
        for mask in range(1 << K.BLOCKS):
            want = next((k for k, c in enumerate(K.tables(radius)) if all(mask >> b & 1 for b in c)), -1)
            assert first[mask] == want


def test_fingerprint_against_plain():
    import hashlib

    texts = ["a b a c\tB", "", "x" * 5000 + " y y y", "é É ß 　 z", "the " * 300 + "end"]
    for _, _, buf, offs in T.blocks(None, __import__("pyarrow").array(texts)):
        got = K.fingerprints(buf, offs)
    for text, fp in zip(texts, got, strict=True):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        votes = np.zeros(128, int)
        for w in set(words):
            h = int.from_bytes(hashlib.md5(w.encode()).digest(), "big")
            votes += np.array([1 if h >> (127 - b) & 1 else -1 for b in range(128)]) * words.count(w).bit_length()
        assert fp.tobytes() == np.packbits(votes > 0).tobytes()


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and ids, one row per range, clashing names."""
    long = "word " * 100_000
    rows = [(5, "b c", 1), (5, "a", 2), (None, "z z", 3), (None, None, 4), (7, long, 5), (7, long, 6), (1, None, 7), (2, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumnRenamed("fp", "n_near")
    got = sorted(map(tuple, K.fingerprint_documents(df).select("doc_id", "n_chars", "edited_sha256", "n_near", "component_id").collect()), key=repr)
    order = [(1, ""), (2, ""), (5, "a"), (5, "b c"), (7, long), (7, long), (None, ""), (None, "z z")]
    import hashlib

    # rows of equal ids follow each other by a hash of their texts
    from pyspark.sql import functions as F

    tie = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in order], "t string").distinct().select("t", F.xxhash64("t").alias("h")).collect()}
    order.sort(key=lambda x: (x[0] is None, x[0] or 0, tie[x[1]]))
    want = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    assert [g[:3] for g in got] == sorted(want, key=repr)
    same = {g[0]: g[3:] for g in got if g[0] == 7 or g[1] == 0}
    assert same[7] == (1, 7) and same[1] == same[2] == (2, 1)
    assert K.fingerprint_documents(df.limit(0)).count() == 0
    one = K.fingerprint_documents(spark.createDataFrame([(3, "abcd efgh")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["n_near"] == 0
