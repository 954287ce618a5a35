"""Per-position features of token streams: hashes, n-gram frequencies, radii, winnowed minima."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.hashing import NGRAM, ngram_hash, with_word_hash
from palimpsest.operators import kernels
from palimpsest.sources.corpus import word_id


def hashed_tokens(token_rows: DataFrame) -> DataFrame:
    """Adds wid and b, the one-byte word hash, to token rows."""
    return with_word_hash(token_rows.withColumn("wid", word_id()))


def ngrams(token_rows: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, h: the rolling hash of the n tokens from pos on; only versions longer than n have any."""
    at = Window.partitionBy(*keys).orderBy("pos")
    ahead = [F.lead("b", k).over(at) if k else F.col("b") for k in range(NGRAM)]
    rows = hashed_tokens(token_rows).select(*keys, "pos", *(a.alias(f"b{k}") for k, a in enumerate(ahead)), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("len"))
    return rows.where((F.col("len") > NGRAM) & F.col(f"b{NGRAM - 1}").isNotNull()).select(*keys, "pos", ngram_hash(lambda k: F.col(f"b{k}")).alias("h"))


def gram_rows(arrays: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, h: ngrams() of token arrays, computed by a kernel without a shuffle."""
    return kernels.with_grams(arrays, *keys).select(*keys, F.posexplode("h").alias("pos", "h"))


def frequency_arrays(arrays: DataFrame, collection: str, version: str) -> DataFrame:
    """collection, version, len, h, freq: n-gram hashes and how often each occurs in all versions of its collection, by position.

    A collection of one version needs no shuffle for it.  Elsewhere each version sends its
    distinct hashes once, with their counts; these are summed, map-side first, and joined
    back to the versions, so a hash has one row per version that holds it, however often it repeats there.
    """
    keys = (collection, version)
    counted = arrays.select(*keys, "toks").join(arrays.groupBy(collection).agg(F.count(F.lit(1)).alias("n_versions")), collection)
    single = kernels.own_counts(kernels.with_grams(counted.where("n_versions = 1"), *keys), *keys)
    several = kernels.with_grams(counted.where("n_versions > 1"), *keys)
    own = kernels.distinct_counts(several, *keys)
    each = own.select(*keys, F.explode(F.arrays_zip("gram", "n")).alias("x")).select(*keys, F.col("x.gram").alias("gram"), F.col("x.n").alias("n"))
    total = each.groupBy(collection, "gram").agg(F.sum("n").alias("total"))
    told = each.select(*keys, "gram").join(total, [collection, "gram"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("gram", "total"))).alias("told"))
    blank = F.expr("cast(array() as array<bigint>)")
    both = several.join(told.select(*keys, F.col("told.gram").alias("gram"), F.col("told.total").alias("total")), [*keys], "left")
    both = both.select(*keys, "len", "h", F.coalesce("gram", blank).alias("gram"), F.coalesce("total", blank).alias("total"))
    return single.unionByName(kernels.looked_up(both, *keys))


def frequency_rows(arrays: DataFrame, collection: str, version: str) -> DataFrame:
    """collection, version, pos, freq, diff: frequencies by position, and their difference to the next one (0 at the end)."""
    nxt = F.concat(F.slice("freq", 2, F.greatest(F.size("freq") - 1, F.lit(0))), F.slice("freq", -1, 1))
    rows = frequency_arrays(arrays, collection, version).where(F.size("freq") > 0)
    each = rows.select(collection, version, F.posexplode(F.arrays_zip(F.col("freq"), nxt.alias("nxt"))).alias("pos", "x"))
    return each.select(collection, version, "pos", "x.freq", (F.col("x.nxt") - F.col("x.freq")).alias("diff"))


def cuts(arrays: DataFrame, w: int, *keys: str) -> DataFrame:
    """keys, pos: winnowed boundaries of token arrays; a version without n-grams is one block, an empty one has none."""
    return kernels.with_bounds(arrays, (w,), *keys).select(*keys, F.explode(f"bounds{w}").alias("pos"))


def _rank() -> Column:
    """One number that orders by hash, then by position from the right: a long compares faster than a struct."""
    return F.col("h") * (1 << 31) + (((1 << 31) - 1) - F.col("pos"))


def _place(rank: Column) -> Column:
    return (F.lit((1 << 31) - 1) - rank.bitwiseAND((1 << 31) - 1)).cast("int").alias("pos")


def winnow(grams: DataFrame, w: int, *keys: str) -> DataFrame:
    """keys, pos: boundaries by winnowing of n-gram rows, 0 and the rightmost minimum of each full window of w from position 1 on."""
    at = Window.partitionBy(*keys).orderBy("pos")
    least = F.min(_rank()).over(at.rowsBetween(0, w - 1))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    picked = grams.withColumn("least", least).withColumn("n", n).where(F.col("pos").between(1, F.col("n") - w)).select(*keys, _place(F.col("least")))
    return picked.union(grams.select(*keys, F.lit(0).alias("pos"))).distinct()


def reach(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many values directly before and behind each one are greater than it, inside [lo[i], hi[i]).

    Minima of runs of 1, 2, 4, ... values are tabled; each side grows by the longest run first
    that holds greater values only, so no value is visited one by one.
    """
    n = len(h)
    tables = [h]
    longest = int((hi - lo).max(initial=1))
    while 2 << (len(tables) - 1) <= longest:
        half = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][: max(0, n - 2 * half + 1)], tables[-1][half : n - half + 1]))
    first, last = np.arange(n), np.arange(1, n + 1)
    for k in range(len(tables) - 1, -1, -1):
        step, t = 1 << k, tables[k]
        at = np.flatnonzero(first - step >= lo)
        at = at[t[first[at] - step] > h[at]]
        first[at] -= step
        at = np.flatnonzero(last + step <= hi)
        at = at[t[last[at]] > h[at]]
        last[at] += step
    place = np.arange(n)
    return place - first, last - place - 1


def radii_of(h: np.ndarray, offs: np.ndarray | None = None) -> np.ndarray:
    """Largest r with h[i] < h[i +- k] for all k up to r, both sides inside; of one version, or of many with their offsets."""
    offs = np.array([0, len(h)]) if offs is None else offs
    if not len(h):
        return np.zeros(0, np.int64)
    size = np.diff(offs)
    return np.minimum(*reach(h, np.repeat(offs[:-1], size), np.repeat(offs[1:], size)))


def radius_arrays(grams: DataFrame, *keys: str) -> DataFrame:
    """keys, radius: the radius of every n-gram of a version, by position, from arrays h.

    The frame depends on the data, which no window can say; all versions of an
    Arrow batch are handled at once.
    """

    def body(h):
        values, offs = kernels.lists(h)
        return [kernels.to_lists(radii_of(values.to_numpy(), offs).astype(np.int32), offs, pa.int32())]

    return kernels._passed(grams, keys, body, "radius array<int>", ("h",))


def radii(arrays: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, radius of every n-gram of token arrays."""
    return radius_arrays(kernels.with_grams(arrays, *keys), *keys).select(*keys, F.posexplode("radius").alias("pos", "radius"))
