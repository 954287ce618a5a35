"""Cutters as an extension point: a class with ``cut`` and ``merge``, taken by name by SQL, sweep and index.

    class Halves(Cutter):
        name = "halves"
        def cut(self, f):
            return np.array([0, f.length // 2])

    register(spark, Halves())
    spark.sql("SELECT * FROM cut_halves(TABLE(features))")       -- collection, version, level, idx, start, end
    candidates(arrays, "halves")                                  -- hashed, for fragments.select_covers
    versioned.build(arrays, (), cut=fragments_of(arrays, "halves"))

A registered cutter is a table function of Spark: an Arrow UDTF that gets batches of versions with their
features as arrays.  ``cut`` tells a version's boundaries, ``merge`` the next level of candidate blocks from one level; by
default each block is joined with the one behind it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import scratch
from palimpsest.functions.hashing import NGRAM
from palimpsest.operators import features, fragments, kernels, segments

KEYS = ("collection", "version")
BLOCKS = "collection string, version long, level int, idx int, start int, end int"


@dataclass
class Features:
    """A version's tokens and n-grams: hash, frequency in the collection and radius of each n-gram, by position."""

    length: int
    h: np.ndarray
    freq: np.ndarray
    radius: np.ndarray


class Cutter:
    """levels: how many levels of merged blocks follow the cut."""

    name = ""
    levels = 0

    def cut(self, f: Features) -> np.ndarray:
        """Ascending boundaries; 0 is added, and what lies outside the version left out."""
        raise NotImplementedError

    def merge(self, start: np.ndarray, end: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of level ``level`` from those of the level below."""
        return start[:-1], end[1:]


class Winnow(Cutter):
    def __init__(self, w: int, levels: int = 0):
        self.name, self.w, self.levels = f"winnow_{w}", w, levels

    def cut(self, f: Features) -> np.ndarray:
        return kernels.winnowed(f.h, np.array([0, len(f.h)]), np.array([f.length]), self.w)[0]


class Threshold(Cutter):
    """Where the radius is at least w."""

    def __init__(self, w: int):
        self.name, self.w = f"threshold_{w}", w

    def cut(self, f: Features) -> np.ndarray:
        at = np.flatnonzero(f.radius >= self.w)
        return at[at <= f.length - NGRAM - self.w + 1]


class Tree(Cutter):
    """Behind the n-gram where the frequency jumps."""

    def __init__(self, jump: int):
        self.name, self.jump = f"tree_{jump}", jump

    def cut(self, f: Features) -> np.ndarray:
        return np.flatnonzero(np.abs(np.diff(f.freq)) >= self.jump) + NGRAM


class Jump(Cutter):
    """At the strongest jumps first, see segments.jump_boundaries."""

    def __init__(self, threshold: int = 1, max_block: int | None = None, relative: bool = False, name: str = "jump"):
        self.name, self.options = name, (threshold, max_block, relative)

    def cut(self, f: Features) -> np.ndarray:
        return np.array(segments.jump_boundaries(f.freq, f.radius, f.length, *self.options), np.int64)


_known: dict[str, Cutter] = {}


def _levels(cutter: Cutter, f: Features):
    """(level, starts, ends) of one version."""
    if not f.length:
        return
    bounds = np.unique(np.append(0, np.asarray(cutter.cut(f), np.int64)))
    start = bounds[(bounds >= 0) & (bounds < f.length)]
    end = np.append(start[1:], f.length)
    yield 0, start, end
    for level in range(1, cutter.levels + 1):
        start, end = cutter.merge(start, end, level)
        if not len(start):
            return
        yield level, start, end


def _function(cutter: Cutter):
    class Cut:
        def eval(self, batch: pa.RecordBatch):
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            arrays = {c: kernels.lists(col[c]) for c in ("h", "freq", "radius")}
            values = {c: (v.to_numpy(zero_copy_only=False), o) for c, (v, o) in arrays.items()}
            rows, level, idx, starts, ends = [], [], [], [], []
            for i, n in enumerate(col["len"].to_pylist()):
                own = {c: v[o[i] : o[i + 1]] for c, (v, o) in values.items()}
                for k, start, end in _levels(cutter, Features(n, own["h"], own["freq"], own["radius"])):
                    rows.append(np.full(len(start), i))
                    level.append(np.full(len(start), k))
                    idx.append(np.arange(len(start)))
                    starts.append(start)
                    ends.append(end)
            flat = lambda x, kind: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), kind)
            take = flat(rows, pa.int64())
            yield pa.table({"collection": col["collection"].take(take), "version": col["version"].take(take), "level": flat(level, pa.int32()), "idx": flat(idx, pa.int32()), "start": flat(starts, pa.int32()), "end": flat(ends, pa.int32())})

    return F.arrow_udtf(Cut, returnType=BLOCKS)


def register(spark: SparkSession, cutter: Cutter) -> str:
    """Make a cutter known by its name, and its function ``cut_<name>`` to SQL; the function's name."""
    _known[cutter.name] = cutter
    spark.udtf.register(f"cut_{cutter.name}", _function(cutter))
    return f"cut_{cutter.name}"


def features_of(arrays: DataFrame) -> DataFrame:
    """collection (as text), version, len, h, freq, radius: what the functions take as their table."""
    rows = scratch.table(features.frequency_arrays(arrays, *KEYS), "features")
    both = rows.join(features.radius_arrays(rows, *KEYS), [*KEYS])
    return both.select(F.col("collection").cast("string").alias("collection"), F.col("version").cast("long").alias("version"), "len", "h", "freq", "radius")


def blocks_of(arrays: DataFrame, name: str) -> DataFrame:
    """collection, version, level, idx, start, end by the cutter of that name."""
    if name not in _known:
        raise KeyError(f"no cutter {name!r} is registered; there are {sorted(_known)}")
    return _function(_known[name])(features_of(arrays).asTable())


def candidates(arrays: DataFrame, name: str) -> DataFrame:
    """Candidate fragments of all levels, hashed, for fragments.select_covers and the sweep."""
    return fragments.cut_tokens(blocks_of(arrays, name), arrays, *KEYS)


def fragments_of(arrays: DataFrame, name: str) -> DataFrame:
    """collection, version, w, idx, start, end, hash of the cut itself, for versioned.build."""
    return candidates(arrays, name).where("level = 0").select(*KEYS, F.lit(1.0).alias("w"), "idx", "start", "end", "hash")
