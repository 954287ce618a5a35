"""Winnowing and radii of long versions, cut into parts so that no task needs a whole version.

A part holds so many n-grams and the tokens behind them that its last ones need.

**Winnowing** has windows of fixed size: a part's halo is one window, and parts tell the boundaries of the windows that begin in them.

**Radii** reach as far as the data say.  Inside a part they are found at once; open are only n-grams
that are smaller than all before them, or all behind them, in their part.  These are also the only ones at which
a search from another part can end.  So the open n-grams of all parts, usually a logarithmic
number, are brought together per version, and the searches are finished on them alone.
Falling or rising hashes all the way would leave every n-gram open; then a version's n-grams meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import scratch
from palimpsest.functions.hashing import NGRAM
from palimpsest.operators import kernels
from palimpsest.operators.features import reach

#: n-grams of a part.
PART = 1 << 16


def parts(arrays: DataFrame, keys: tuple[str, ...], size: int, halo: int) -> DataFrame:
    """keys, part, begin, origin (the same), toks: each part's tokens, with those that ``halo`` more n-grams need; versions without n-grams have none."""
    grams = F.size("toks") - NGRAM + 1
    cut = F.transform(F.sequence(F.lit(0), F.floor((grams - 1) / size).cast("int")), lambda k: F.struct(k.alias("part"), (k * size).alias("begin"), (k * size).alias("origin"), F.slice("toks", k * size + 1, F.lit(size + halo + NGRAM - 1)).alias("toks")))
    return arrays.where(F.size("toks") > NGRAM).select(*keys, F.explode(cut).alias("p")).select(*keys, "p.*")


def _hashes(toks: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of parts; a part of ten tokens has one, its version is longer."""
    values, offs = kernels.lists(toks)
    h = kernels.rolling(kernels.term_bytes(values))
    size = np.maximum(np.diff(offs) - NGRAM + 1, 0)
    return h[kernels.ranges(offs[:-1], size)], np.concatenate([[0], np.cumsum(size)])


def winnow_in_parts(arrays: DataFrame, w: int, *keys: str, size: int = PART) -> DataFrame:
    """keys, pos: features.cuts of versions that are cut into parts."""

    def body(begin, toks):
        h, offs = _hashes(toks)
        at = begin.to_numpy()
        top = (1 << 31) - 1
        least = kernels.sliding_min((h << 31) | (top - np.arange(len(h))), w)
        # windows that begin in the part; the first n-gram of a version begins none
        first = np.where(at == 0, 1, 0)
        n = np.maximum(np.minimum(np.diff(offs) - w + 1, size) - first, 0)
        part = np.repeat(np.arange(len(n)), n)
        place = top - (least[kernels.ranges(offs[:-1] + first, n)] & top)
        pos = place - offs[:-1][part] + at[part]
        return [kernels.to_lists(pos.astype(np.int32), np.concatenate([[0], np.cumsum(n)]), pa.int32())]

    found = kernels._passed(parts(arrays, keys, size, w - 1), keys, body, "at array<int>", ("origin", "toks"))
    inner = found.select(*keys, F.explode(F.array_distinct("at")).alias("pos"))
    return inner.unionByName(arrays.where(F.size("toks") > 0).select(*keys, F.lit(0).alias("pos"))).distinct()


def last_not_greater(values: np.ndarray, limit: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each query the last index before ``limit`` whose value is at most ``most``; -1 if there is none."""
    tables = [values]
    while 2 << (len(tables) - 1) <= len(values):
        half = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][: len(values) - 2 * half + 1], tables[-1][half : len(values) - half + 1]))
    at = limit.copy()
    for k in range(len(tables) - 1, -1, -1):
        step = 1 << k
        own = np.flatnonzero(at >= step)
        own = own[tables[k][at[own] - step] > most[own]] if len(tables[k]) else own[:0]
        at[own] -= step
    return at - 1


def _finished(keys: tuple[str, ...]):
    """Of one version: where the searches of its parts' open n-grams end."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("begin")
        begin = table.column("begin").to_numpy()
        sides = {}
        for side in ("left", "right"):
            pos, offs = kernels.lists(table.column(f"{side}_pos"))
            h, _ = kernels.lists(table.column(f"{side}_h"))
            sides[side] = pos.to_numpy().astype(np.int64), h.to_numpy(), offs
        out = []
        for side, other in (("left", "right"), ("right", "left")):
            pos, h, offs = sides[side]
            there, values, ends = sides[other]
            part = np.repeat(np.arange(len(begin)), np.diff(offs))
            if side == "left":
                found = last_not_greater(values, ends[part], h)
                end = np.where(found >= 0, there[np.maximum(found, 0)] if len(there) else -1, -1)
            else:
                # the same from the other end
                found = len(values) - 1 - last_not_greater(values[::-1], len(values) - ends[part + 1], h)
                end = np.where(found < len(values), there[np.minimum(found, len(values) - 1)] if len(there) else -1, -1)
            out.append(kernels.to_lists(end.astype(np.int64), offs, pa.int64()))
        cols = [table.column(k).combine_chunks() for k in keys]
        return pa.Table.from_arrays([*cols, pa.array(begin), *out], names=[*keys, "begin", "left_end", "right_end"])

    return run


def radii_in_parts(arrays: DataFrame, *keys: str, size: int = PART) -> DataFrame:
    """keys, begin, radius: features.radius_arrays of versions that are cut into parts, an array per part."""
    kinds = {f.name: f.dataType.simpleString() for f in arrays.schema}

    def body(begin, toks):
        h, offs = _hashes(toks)
        n = np.diff(offs)
        lo, hi = np.repeat(offs[:-1], n), np.repeat(offs[1:], n)
        left, right = reach(h, lo, hi) if len(h) else (h, h)
        at = np.arange(len(h))
        place = at - lo + np.repeat(begin.to_numpy(), n)
        out = [kernels.to_lists(left, offs, pa.int64()), kernels.to_lists(right, offs, pa.int64())]
        for open_ in (at - left == lo, at + right + 1 == hi):
            ends = np.concatenate([[0], np.cumsum(open_)])[offs]
            out += [kernels.to_lists(place[open_], ends, pa.int64()), kernels.to_lists(h[open_], ends, pa.int64())]
        return out

    lists = "left array<bigint>, right array<bigint>, left_pos array<bigint>, left_h array<bigint>, right_pos array<bigint>, right_h array<bigint>"
    found = scratch.table(kernels._passed(parts(arrays, keys, size, 0), (*keys, "begin"), body, lists, ("origin", "toks")), "parts")
    ddl = ", ".join(f"{k} {kinds[k]}" for k in keys)
    ends = found.select(*keys, "begin", "left_pos", "left_h", "right_pos", "right_h").groupBy(*keys).applyInArrow(_finished(keys), f"{ddl}, begin int, left_end array<bigint>, right_end array<bigint>")

    def settle(begin, left, right, left_pos, right_pos, left_end, right_end):
        (before, offs), (behind, _) = ((v.to_numpy().copy(), o) for v, o in map(kernels.lists, (left, right)))
        for side, pos, end in ((before, left_pos, left_end), (behind, right_pos, right_end)):
            p, at = kernels.lists(pos)
            e, _ = kernels.lists(end)
            p, e = p.to_numpy(), e.to_numpy()
            part = np.repeat(np.arange(len(at) - 1), np.diff(at))
            index = p - begin.to_numpy()[part] + offs[:-1][part]
            known = e >= 0
            side[index] = np.where(known, p - e - 1, p) if side is before else np.where(known, e - p - 1, 1 << 40)
        return [kernels.to_lists(np.minimum(before, behind), offs, pa.int64())]

    both = found.select(*keys, "begin", F.col("begin").alias("origin"), "left", "right", "left_pos", "right_pos").join(ends, [*keys, "begin"])
    # behind the last n-gram the version's end bounds a radius as well
    total = arrays.where(F.size("toks") > NGRAM).select(*keys, (F.size("toks") - NGRAM + 1).alias("_n"))
    near = kernels._passed(both, (*keys, "begin"), settle, "radius array<bigint>", ("origin", "left", "right", "left_pos", "right_pos", "left_end", "right_end"))
    capped = F.transform("radius", lambda x, i: F.least(x, F.col("_n") - 1 - F.col("begin") - i).cast("int"))
    return near.join(total, list(keys)).select(*keys, "begin", capped.alias("radius"))
