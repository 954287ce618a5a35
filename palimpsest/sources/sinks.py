"""Tables that the engine writes and reads again: corpora, features, fragment metadata, copy lists, parameter files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import kernels


def write_corpus(arrays: DataFrame, path: str, *keys: str) -> None:
    """keys, n_tokens, toks: versions in key order inside ranges of the first key."""
    arrays.select(*keys, F.size("toks").alias("n_tokens"), "toks").repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    """One row per version with its feature arrays, each by position."""
    features.write.mode("overwrite").parquet(path)


def write_metadata(fragments: DataFrame, path: str) -> None:
    """frag_id, len, apps array<struct<version, offset>> of fragment rows (frag_id, len, version, offset)."""
    gathered(fragments).write.mode("overwrite").parquet(path)


def gathered(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("frag_id").agg(F.first("len").alias("len"), F.array_sort(F.collect_list(F.struct("version", "offset"))).alias("apps"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """frag_id, len, version, offset."""
    return spark.read.parquet(path).select("frag_id", "len", F.explode("apps").alias("a")).select("frag_id", "len", "a.version", "a.offset")


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each): 7-bit groups, least significant first, the high bit set while more follow."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        own = size > k
        group = (v[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[own] + k] = group.astype(np.uint8) | np.where(size[own] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def unpack_numbers(code: np.ndarray) -> np.ndarray:
    """The numbers of pack_numbers."""
    if not len(code):
        return np.zeros(0, np.int64)
    last = code < 128
    which = np.concatenate([[0], np.cumsum(last)[:-1]])
    first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    shift = (np.arange(len(code)) - first[which]) * 7
    return np.add.reduceat((code & 127).astype(np.uint64) << shift.astype(np.uint64), first).astype(np.int64)


def write_metadata_varbyte(fragments: DataFrame, path: str) -> None:
    """frag_id, code: per fragment the variable-length code of len, count, and (version, offset) of each application."""
    flat = F.concat(F.array(F.col("len").cast("long"), F.size("apps").cast("long")), F.flatten(F.transform("apps", lambda a: F.array(a["version"].cast("long"), a["offset"].cast("long")))))

    def body(numbers):
        values, offs = kernels.lists(numbers)
        code, size = pack_numbers(values.to_numpy())
        at = np.concatenate([[0], np.cumsum(size)])[offs]
        return [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(code.tobytes())]).cast(pa.binary())]

    rows = gathered(fragments).select("frag_id", flat.alias("numbers"))
    kernels._passed(rows, ("frag_id",), body, "code binary", ("numbers",)).write.mode("overwrite").parquet(path)


def read_metadata_varbyte(spark: SparkSession, path: str) -> DataFrame:
    """frag_id, len, version, offset of write_metadata_varbyte."""

    def body(code):
        raw = np.frombuffer(b"".join(code.to_pylist()), np.uint8)
        numbers = unpack_numbers(raw)
        ends = np.cumsum([len(c) for c in code.to_pylist()])
        done = np.cumsum(raw < 128)
        return [kernels.to_lists(numbers, np.concatenate([[0], done[ends - 1]]), pa.int64())]

    rows = kernels._passed(spark.read.parquet(path), ("frag_id",), body, "numbers array<long>", ("code",))
    apps = F.transform(F.sequence(F.lit(0), (F.col("numbers")[1] - 1).cast("int")), lambda k: F.struct(F.get("numbers", 2 + 2 * k).alias("version"), F.get("numbers", 3 + 2 * k).alias("offset")))
    return rows.select("frag_id", F.col("numbers")[0].alias("len"), F.explode(apps).alias("a")).select("frag_id", "len", "a.version", "a.offset")


def append_copies(ranges: DataFrame, path: str) -> None:
    """Adds copy ranges (collection, version, rstart, vstart, len), one list per version, to a copy-list index."""
    lists = F.array_sort(F.collect_list(F.struct("vstart", "rstart", "len")))
    ranges.groupBy("collection", "version").agg(lists.alias("copies")).write.mode("append").parquet(path)


def restore_copies(spark: SparkSession, path: str) -> DataFrame:
    """All ranges of a copy-list index."""
    return spark.read.parquet(path).select("collection", "version", F.explode("copies").alias("c")).select("collection", "version", "c.rstart", "c.vstart", "c.len")


def write_catalog_tsv(catalog: DataFrame, path: str) -> None:
    """Lines ``id TAB - TAB n_versions``."""
    catalog.select(F.concat_ws("\t", F.col("collection").cast("string"), F.lit("-"), F.col("n_versions").cast("string"))).write.mode("overwrite").text(path)


def write_doubles(rows: DataFrame, path: str, name: str = "w") -> None:
    """One number per line."""
    rows.select(F.col(name).cast("string")).write.mode("overwrite").text(path)
