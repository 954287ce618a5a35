"""Cutters by name: built-in ones against the plain functions, and one of a user's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import cutters, features, fragments, segments, versioned


def halves():
    """A local class travels to the workers by value."""

    class Halves(cutters.Cutter):
        """Cuts in two; its merges take triples that share a block."""

        name = "halves"
        levels = 2

        def cut(self, f):
            return np.array([f.length // 2, f.length // 4])

        def merge(self, start, end, level):
            return start[::2][: (len(end) - 1) // 2], end[2::2]

    return Halves()


@pytest.fixture(scope="module")
def arrays(spark):
    words = [f"w{k % 17}" for k in range(60)]
    rows = [("a", 0, words), ("a", 1, words[:30] + ["x"] * 12 + words[30:]), ("b", 0, ["p", "q"]), ("b", 1, []), ("c", 0, words[5:45])]
    return spark.createDataFrame(rows, "collection string, version long, toks array<string>").cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_own_cutter_in_sql_sweep_and_index(spark, arrays):
    call = cutters.register(spark, halves())
    cutters.features_of(arrays).createOrReplaceTempView("test_features")
    got = rows(spark.sql(f"SELECT * FROM {call}(TABLE(test_features))"), "collection", "version", "level", "start", "end")
    assert [g[2:] for g in got if g[:2] == ("a", 0)] == [(0, 0, 15), (0, 15, 30), (0, 30, 60), (1, 0, 60)]
    assert [g[2:] for g in got if g[:2] == ("b", 0)] == [(0, 0, 1), (0, 1, 2)] and not [g for g in got if g[:2] == ("b", 1)]
    covers = fragments.select_covers(cutters.candidates(arrays, "halves"), [0.5, 5.0])
    assert fragments.coverage_faults(covers, arrays).count() == 0 and fragments.hash_faults(covers, arrays).count() == 0
    found = versioned.build(arrays, (), cut=cutters.fragments_of(arrays, "halves"))
    assert rows(versioned.restore(found), "collection", "version", "toks") == rows(arrays.where(F.size("toks") > 0), "collection", "version", "toks")
    with pytest.raises(KeyError, match="halves"):
        cutters.blocks_of(arrays, "thirds")


def test_built_in_cutters_equal_the_functions(spark, arrays):
    keys = ("collection", "version")
    long = arrays.where(F.size("toks") > 10)
    freq = features.frequency_rows(long, *keys)
    given = features.frequency_arrays(long, *keys)
    given = given.join(features.radius_arrays(given, *keys), list(keys))
    want = {
        "winnow_5": features.cuts(long, 5, *keys), "tree_2": segments.tree_cut(freq, *keys, jump=2), "jump": segments.jump_cut(given.select(*keys, "len", "freq", "radius")),
        "threshold_3": segments.threshold_cut(features.radii(long, *keys), long.select(*keys, F.size("toks").alias("len")), 3, *keys),
    }
    for cutter in (cutters.Winnow(5), cutters.Tree(2), cutters.Jump(), cutters.Threshold(3)):
        cutters.register(spark, cutter)
        # a boundary at the very end begins no block
        inside = want[cutter.name].join(long.select(*keys, F.size("toks").alias("n")), list(keys)).where("pos < n")
        assert rows(cutters.blocks_of(long, cutter.name).withColumnRenamed("start", "pos"), *keys, "pos") == rows(inside.select(*keys, F.col("pos").cast("int").alias("pos")), *keys, "pos")
