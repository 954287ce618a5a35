"""Long versions in parts: the same boundaries and radii as whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import features, kernels, parts


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_parts_equal_whole_versions(spark, size):
    r = random.Random(size)
    rows = [(c, v, [r.choice("abcdefgh"[: r.randint(1, 8)]) for _ in range(r.choice([0, 9, 10, 11, 12, 30, 200]))]) for c in range(5) for v in range(4)]
    rows += [(9, 0, ["a"] * 150), (9, 1, [str(k) for k in range(150)]), (None, 0, [r.choice("xyz") for _ in range(80)])]
    df = spark.createDataFrame(rows, "collection long, version int, toks array<string>").where("collection is not null").cache()
    keys = ("collection", "version")
    for w in (1, 5, 20):
        got = sorted(tuple(x) for x in parts.winnow_in_parts(df, w, *keys, size=size).collect())
        assert got == sorted(tuple(x) for x in features.cuts(df, w, *keys).collect())
    cut = parts.radii_in_parts(df, *keys, size=size)
    flat = cut.select(*keys, "begin", F.posexplode("radius").alias("i", "radius")).select(*keys, (F.col("begin") + F.col("i")).alias("pos"), "radius")
    assert sorted(tuple(x) for x in flat.collect()) == sorted(tuple(x) for x in features.radii(df, *keys).collect())
    if size == 7:
        assert cut.groupBy(*keys).count().agg(F.max("count")).first()[0] > 20


def test_rolling_is_the_kernels(spark):
    assert len(kernels.rolling(kernels.term_bytes(__import__("pyarrow").array(["a"] * 9)))) == 0
