"""op12 against DuckDB SQL and a plain Lloyd; heaps do less than a full scan."""

import os
import random

import duckdb
import numpy as np
import pytest

from palimpsest.llm import code_compression as K

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = K.op12_vector_codes(spark, SF)
    want = con.execute(K.OP12_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def plain(rows, parts, entries, rounds):
    """Lloyd by full scans, in Python's integers."""
    import math
    from hashlib import sha256

    dim = next(len(v) for i, v, _ in sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0])) if all(x is not None and math.isfinite(x) for x in v))
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = dim // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (d(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, v, _ in kept]
        if k == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    error = [sum(d(cut(v, p), books[p][c[p]]) for p in range(parts)) for (_, v, _), c in zip(kept, codes, strict=True)]
    total = {}
    for (_, _, label), x in zip(kept, error, strict=True):
        total[label] = total.get(label, 0) + x
    digest = sha256(",".join(str(x) for b in books for row in b for x in row).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e in c), x, total[label], digest) for (i, _, label), c, x in zip(kept, codes, error, strict=True)), key=repr)


@pytest.mark.parametrize("scale", [0.001, 1.0, 30_000.0])
def test_against_plain(spark, monkeypatch, scale):
    """Ties (few distinct values), repeated vectors and ids, nulls, other lengths, clashing names; several chunks."""
    monkeypatch.setattr(K, "CHUNK", 40)
    r = random.Random(int(scale * 10))
    rows = [(i // 2 if i < 20 else i, [r.choice([-1, -0.5, 0, 0.25, 1]) * scale * r.random() if i % 3 else r.choice([-1.0, 0.0, 1.0]) * scale for _ in range(16)], r.choice([None, 1, 2])) for i in range(160)]
    rows += [(500 + i, rows[3][1], 1) for i in range(60)]
    rows += [(-1, None, 1), (-2, [None] + [0.0] * 15, 1), (-3, [float("nan")] * 16, 2), (-4, [float("inf")] * 16, 2), (900, [1.0] * 8, 1), (901, [], 1), (None, [0.5] * 16, None)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = sorted(map(tuple, K.compress(df, parts=4, entries=5, rounds=4).collect()), key=repr)
    assert got == plain(rows, 4, 5, 4)


def test_few_vectors_and_empty(spark):
    df = spark.createDataFrame([(2, [1.0, 2.0], 1), (1, [3.0, 4.0], None)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, K.compress(df, parts=2).collect()))
    assert [g[:4] for g in got] == [(1, "0000", 0, 0), (2, "0101", 0, 0)]
    assert K.compress(df.limit(0)).count() == 0
    assert K.compress(df.where("vec_id = 1"), parts=2).first()["code"] == "0000"
    with pytest.raises(Exception, match="overflow"):
        K.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], df.schema)).collect()


def test_heaps_skip_most_pieces(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(16, 16))
    x = centres[r.integers(0, 16, 4000)] + r.normal(size=(4000, 16)) * 0.02
    df = spark.createDataFrame([(i, row.tolist(), 0) for i, row in enumerate(x)], "id long, vector array<double>, label long").select("id", "label", "vector")
    _, _, scanned = K.learn(df, 16, 4, 16, 8)
    assert scanned[0] == 4 * 4000
    assert scanned[-1] < scanned[0] / 10
