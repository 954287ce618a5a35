"""The versioned index: few exchanges, and the same tables as from plain fragment rows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import fusion, index, kernels, segments, versioned

WINDOWS = (2, 5, 9)


@pytest.fixture(scope="module")
def arrays(spark):
    r = random.Random(4)
    text = lambda n: [f"w{r.randrange(40)}" for _ in range(n)]
    rows = [(f"{k:06x}", 0, text(n)) for k, n in enumerate([0, 1, 9, 10, 11, 30, 200, 400])]
    base = text(150)
    rows += [("00ff00", v, base[: 10 * v] + text(v) + base[10 * v :]) for v in range(8)] + [("00ff01", v, base) for v in range(4)] + [("00ff02", 0, []), ("00ff02", 1, text(70) * 3)]
    return spark.createDataFrame(rows, "collection string, version long, toks array<string>").cache()


def rows(df, *cols):
    return sorted(tuple(map(str, x)) for x in df.select(*cols).collect())


def test_same_tables_as_from_fragment_rows(spark, arrays):
    got, want = versioned.build(arrays, WINDOWS), versioned.build_cut(arrays, versioned.fragment_rows(arrays, WINDOWS))
    for name, cols in (("chosen", ["collection", "w"]), ("dictionary", ["frag_id", "collection", "hash", "len", "size", "first"]), ("metadata", ["frag_id", "collection", "version", "offset"]), ("postings", ["term", "block", "freq", "n_docs", "postings"])):
        assert rows(getattr(got, name), *cols) == rows(getattr(want, name), *cols), name
    for found in (got, fusion.fuse(got)):
        assert rows(versioned.restore(found), "collection", "version", "toks") == rows(arrays.where(F.size("toks") > 0), "collection", "version", "toks")


def test_postings_are_in_no_exchange(spark, arrays):
    found = versioned.build(arrays, WINDOWS)
    for one in (found, fusion.fuse(found)):
        plan = one.postings._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
        assert dealt and not any("hashpartitioning(term" in line for line in dealt), plan


def test_kernels_take_bounded_slices(spark, arrays, monkeypatch):
    keys = ("collection", "version")
    whole = rows(kernels.with_fragments(arrays, WINDOWS, *keys), *keys, "frags")
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4, 5], "x": [[1] * 3, [], [2] * 9, [3], [4] * 2]})
    monkeypatch.setattr(kernels, "BATCH_VALUES", 4)
    parts = list(kernels.bounded(batch))
    assert [p.column("k").to_pylist() for p in parts] == [[1, 2], [3], [4, 5]] and not list(kernels.bounded(batch.slice(0, 0)))
    got = [x for p in parts for x in kernels.lists(p.column("x"))[0].to_pylist()]
    assert got == [1] * 3 + [2] * 9 + [3] + [4] * 2
    assert rows(kernels.with_fragments(arrays.repartition(1), WINDOWS, *keys), *keys, "frags") == whole


def test_level_counts_are_those_of_the_levels(spark):
    base = spark.createDataFrame([("c", n, k, k, k + 1) for n in range(1, 20) for k in range(n)], "collection string, version long, idx int, start int, end int")
    for total, sliding in ((3, 1 << 30), (3, 6), (2, 0)):
        want = rows(segments.levels(base, total, sliding, "collection", "version").groupBy("version").agg(F.count(F.lit(1)).alias("n")), "version", "n")
        got = base.groupBy("version").agg(F.count(F.lit(1)).alias("b")).select("version", segments.level_counts(F.col("b"), total, sliding).alias("n"))
        assert rows(got, "version", "n") == want


def test_index_of_texts_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 4)
    texts = spark.createDataFrame([(k, [f"t{k % 3}", "x", f"t{k % 3}"]) for k in range(11)], "id long, toks array<string>")
    got, want = index.build_texts(texts, "id", 11), index.build(index.term_rows(texts, "id"), "id")
    cols = ("term", "block", "freq", "n_docs", "postings")
    assert rows(got, *cols) == rows(want, *cols)
    assert rows(index.texts(got), "docid", "toks") == rows(texts, "id", "toks")
