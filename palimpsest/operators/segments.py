"""Segmentation: boundaries of versions and the blocks between them.

A cutter is a function from one version's features to its boundaries.  Those
that a column can express are joins and windows; the greedy ones run per version
in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.hashing import NGRAM
from palimpsest.operators import intervals


def threshold_cut(radius_rows: DataFrame, lengths: DataFrame, w: int, *keys: str) -> DataFrame:
    """keys, pos: 0, and positions up to len - NGRAM - w + 1 with a radius of at least w."""
    inner = radius_rows.join(lengths, [*keys]).where((F.col("radius") >= w) & (F.col("pos") <= F.col("len") - NGRAM - w + 1))
    return inner.select(*keys, "pos").union(lengths.select(*keys, F.lit(0).alias("pos"))).distinct()


def tree_cut(freq_rows: DataFrame, *keys: str, jump: int = 10) -> DataFrame:
    """keys, pos: 0, and pos + NGRAM where the n-gram frequency jumps by at least ``jump`` to the next."""
    at = Window.partitionBy(*keys).orderBy("pos")
    gap = F.abs(F.lead("freq").over(at) - F.col("freq"))
    inner = freq_rows.withColumn("gap", gap).where(F.col("gap") >= jump).select(*keys, (F.col("pos") + NGRAM).alias("pos"))
    return inner.union(freq_rows.select(*keys, F.lit(0).alias("pos"))).distinct()


def spaced(accepted: set, pos: int, length: int) -> bool:
    """No accepted boundary in [pos - NGRAM, min(pos + NGRAM, length))."""
    return not any(q in accepted for q in range(pos - NGRAM, min(pos + NGRAM, length)))


def jump_boundaries(freq, radius, length: int, threshold: int = 1, max_block: int | None = None, relative: bool = False) -> list[int]:
    """Boundaries at jumps of n-gram frequency, strongest first, equal ones by position.

    relative: jumps are counted in multiples of the smaller frequency.  Gaps over
    max_block are refined where the radius is at least NGRAM and the n-gram repeats.
    """
    freq = [int(f) for f in freq]
    jumps = []
    for i in range(min(len(freq) - 1, length - NGRAM)):
        d = freq[i] - freq[i + 1]
        if relative:
            d = math.trunc(d / min(freq[i], freq[i + 1]))
        if abs(d) > threshold:
            jumps.append((-abs(d), i + NGRAM if d > 0 else i + 1))
    accepted: set[int] = set()
    for _, pos in sorted(jumps):
        if pos < length and spaced(accepted, pos, length):
            accepted.add(pos)
    bounds = sorted(accepted | {0})
    if max_block:
        more = []
        for a, b in zip(bounds, [*bounds[1:], length], strict=True):
            if b - a > max_block:
                more += [i for i in range(a + NGRAM + 1, min(b - NGRAM, len(freq))) if radius[i] >= NGRAM and freq[i] > 1]
        bounds = sorted({*bounds, *more})
    return bounds


def jump_cut(features: DataFrame, threshold: int = 1, max_block: int | None = None, relative: bool = False) -> DataFrame:
    """collection, version, pos: jump_boundaries of each version; features: collection, version, len, freq, radius (arrays)."""

    def run(frames):
        for df in frames:
            rows = [(c, v, p) for c, v, n, f, r in zip(df.collection, df.version, df.len, df.freq, df.radius, strict=True) for p in (jump_boundaries(f, r, n, threshold, max_block, relative) if n else [])]
            yield pd.DataFrame(rows, columns=["collection", "version", "pos"])

    kind = features.schema["collection"].dataType.simpleString()
    return features.select("collection", "version", "len", "freq", "radius").mapInPandas(run, f"collection {kind}, version long, pos int")


def blocks(bounds: DataFrame, lengths: DataFrame, *keys: str) -> DataFrame:
    """keys, idx, start, end: the half-open blocks between boundaries; empty versions have none."""
    at = Window.partitionBy(*keys).orderBy("pos")
    rows = bounds.join(lengths.where("len > 0"), [*keys])
    return rows.select(*keys, (F.row_number().over(at) - 1).alias("idx"), F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(at), F.col("len")).alias("end"))


def merge_level(level: DataFrame, skip: bool, *keys: str) -> DataFrame:
    """The next level of blocks: sliding pairs (n - 1 blocks), or with skip triples that share one block."""
    at = Window.partitionBy(*keys).orderBy("idx")
    if not skip:
        return level.withColumn("end", F.lead("end").over(at)).where("end is not null")
    wide = level.withColumn("end", F.lead("end", 2).over(at)).where("end is not null and idx % 2 = 0")
    return wide.withColumn("idx", F.expr("idx div 2"))


def levels(base: DataFrame, total: int, sliding_from: int, *keys: str) -> DataFrame:
    """All levels with their number: sliding merges once a version has fewer than ``sliding_from`` blocks, else skipping ones."""
    at = Window.partitionBy(*keys).orderBy("idx")
    level, out = base, base.withColumn("level", F.lit(0))
    for k in range(1, total + 1):
        # both merges from one window, so the plan doesn't branch at each level
        rows = level.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("e1", F.lead("end").over(at)).withColumn("e2", F.lead("end", 2).over(at))
        slides = F.col("n") < sliding_from
        end = F.when(slides, F.col("e1")).otherwise(F.when(F.col("idx") % 2 == 0, F.col("e2")))
        level = rows.select(*keys, F.when(slides, F.col("idx")).otherwise(F.expr("idx div 2")).cast("int").alias("idx"), "start", end.alias("end")).where("end is not null")
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out


def level_counts(blocks: Column, total: int, sliding_from: int) -> Column:
    """How many blocks levels() makes of so many on all levels, without making them."""
    n, out = blocks.cast("long"), blocks.cast("long")
    for _ in range(total):
        n = F.greatest(F.when(n < sliding_from, n - 1).otherwise(F.floor((n - 1) / 2)), F.lit(0)).cast("long")
        out = out + n
    return out


def _inside(level_rows: DataFrame, *keys: str) -> DataFrame:
    """keys, level, idx, p_level, parent: blocks and the blocks of other levels that hold them, by a sweep (``intervals``)."""
    pairs = intervals.containing(level_rows, keys, "level", "idx").where("a_level != b_level")
    return pairs.select(*keys, F.col("b_level").alias("level"), F.col("b_idx").alias("idx"), F.col("a_level").alias("p_level"), F.col("a_idx").alias("parent"))


def contained(level_rows: DataFrame, *keys: str) -> DataFrame:
    """keys, level, idx, parent: each block of a level and the block of the next coarser one that holds it."""
    return _inside(level_rows, *keys).where("p_level = level + 1").select(*keys, "level", "idx", "parent")


def tree_conflicts(level_rows: DataFrame, *keys: str) -> DataFrame:
    """keys, level, idx, other_level, other_idx: the ancestors and descendants of each block of a hierarchy (levels from fine to coarse)."""
    up = _inside(level_rows, *keys).where("p_level > level")
    pairs = up.select(*keys, "level", "idx", F.col("p_level").alias("other_level"), F.col("parent").alias("other_idx"))
    return pairs.unionByName(up.select(*keys, F.col("p_level").alias("level"), F.col("parent").alias("idx"), F.col("level").alias("other_level"), F.col("idx").alias("other_idx")))


def hierarchy(tree: DataFrame, levels: int, *keys: str) -> DataFrame:
    """keys, level, idx, start, end, parent: the blocks of ``kernels.with_tree`` and the one of the next coarser level that holds each, null on the last."""
    out = None
    for k in range(levels):
        up = F.col(f"ups{k}_{k + 1}") if k + 1 < levels else F.transform(f"starts{k}", lambda _: F.lit(None).cast("int"))
        one = F.arrays_zip(F.col(f"starts{k}").alias("start"), F.col(f"ends{k}").alias("end"), up.alias("parent"))
        rows = tree.select(*keys, F.lit(k).alias("level"), F.posexplode(one).alias("idx", "b")).select(*keys, "level", "idx", "b.start", "b.end", "b.parent")
        out = rows if out is None else out.unionByName(rows)
    return out


def tree_pairs(tree: DataFrame, levels: int, *keys: str) -> DataFrame:
    """tree_conflicts() of ``kernels.with_tree``: both directions of each pair of a block and an ancestor."""
    # all lists of a version are read at once, so the tree is made once
    each = [F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.col(f"ups{k}_{p}").alias("up")) for k in range(levels) for p in range(k + 1, levels)]
    found = tree.select(*keys, F.explode(F.array(*each)).alias("x")).select(*keys, "x.k", "x.p", F.posexplode("x.up").alias("idx", "up"))
    both = F.array(*(F.struct(F.col(a).alias("level"), F.col(b).alias("idx"), F.col(c).alias("other_level"), F.col(d).alias("other_idx")) for a, b, c, d in (("k", "idx", "p", "up"), ("p", "up", "k", "idx"))))
    return found.select(*keys, F.explode(both).alias("y")).select(*keys, "y.*")


def blocks_between(bounds: str, length: str = "len") -> Column:
    """Array of (idx, start, end) between the boundaries of an ascending array column."""
    return F.transform(bounds, lambda x, i: F.struct(i.alias("idx"), x.alias("start"), F.coalesce(F.get(bounds, i + 1), F.col(length)).alias("end")))


def refining_levels(bounds: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """keys, level, idx, start, end: one level per boundary column, fine to coarse; a level also cuts where any coarser one does.

    So each level refines the next, whatever the columns hold.
    """
    out = None
    for k in range(len(columns)):
        here = F.array_sort(F.array_distinct(F.concat(*columns[k:])))
        rows = bounds.select(*keys, "len", here.alias("_b")).select(*keys, F.explode(blocks_between("_b")).alias("x")).select(*keys, F.lit(k).alias("level"), "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def overfull(candidates: DataFrame, limit: int, *keys: str) -> DataFrame:
    """keys, n: versions with more candidate blocks than ``limit``; callers stop, or leave them out."""
    return candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def cut_with(cutters: dict[str, Callable[[DataFrame], DataFrame]], arrays: DataFrame) -> DataFrame:
    """cutter, collection, version, pos: the boundaries of each cutter, a function from token arrays to (collection, version, pos)."""
    out = None
    for name, cutter in cutters.items():
        rows = cutter(arrays).select(F.lit(name).alias("cutter"), "collection", "version", F.col("pos").cast("int").alias("pos"))
        out = rows if out is None else out.unionByName(rows)
    return out


def cut_lengths(block_rows: DataFrame, *keys: str) -> DataFrame:
    """length, n: histogram of block lengths, each version's last block left out."""
    last = F.max("idx").over(Window.partitionBy(*keys))
    return block_rows.withColumn("last", last).where("idx < last").groupBy((F.col("end") - F.col("start")).alias("length")).agg(F.count(F.lit(1)).alias("n"))
