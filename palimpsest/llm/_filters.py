"""A filter of bounded size in front of a shuffle join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25
ROW = 1 << 15  # bits of one bitmap_construct_agg


def marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows with _maybe: false where the key can't be among wanted[key].

    The bitmap of hashed keys takes at most BITS / 8 = 4 MB however many keys
    there are, so it may be broadcast; when it is full, all rows are marked.
    """
    at = F.pmod(F.xxhash64(key), F.lit(BITS))
    maps = wanted.select(at.alias("at")).groupBy(F.expr(f"at div {ROW}").alias("_part")).agg(F.expr(f"bitmap_construct_agg(at % {ROW})").alias("_map"))
    bit = (F.pmod(F.xxhash64(key), F.lit(BITS)) % ROW).cast("int")
    both = rows.withColumn("_part", F.expr(f"pmod(xxhash64({key}), {BITS}) div {ROW}")).withColumn("_bit", bit).join(F.broadcast(maps), "_part", "left")
    lit = F.expr("(cast(conv(hex(substring(_map, _bit div 8 + 1, 1)), 16, 10) as int) & shiftleft(1, _bit % 8)) != 0")
    return both.withColumn("_maybe", F.coalesce(lit, F.lit(False))).drop("_part", "_bit", "_map")


def only_wanted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is among wanted[key] (distinct), by a shuffle join of what a bitmap lets through."""
    return marked(rows, key, wanted).where("_maybe").drop("_maybe").join(wanted, key)


def replaced(rows: DataFrame, key: str, changes: DataFrame, value: str) -> DataFrame:
    """rows with ``value`` in place of their key where changes (key, value) has it; others aren't shuffled."""
    told = marked(rows, key, changes)
    same = told.where(~F.col("_maybe")).drop("_maybe")
    new = told.where("_maybe").drop("_maybe").join(changes.select(key, value), key, "left").withColumn(key, F.coalesce(value, key)).select(*rows.columns)
    return same.select(*rows.columns).unionByName(new)


def without(docs: DataFrame, keys: dict[str, Column], gone: DataFrame) -> DataFrame:
    """docs without the rows whose keys are in ``gone`` (columns of the same names; nulls equal each other).

    All columns of docs come back, whatever their names: they travel as one
    struct.  Only rows that the bitmap can't tell from those that go are shuffled.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), *(c.alias(k) for k, c in keys.items()))
    told = marked(rows.withColumn("_key", F.xxhash64(*keys)), "_key", gone.select(F.xxhash64(*keys).alias("_key")))
    away = gone.select(*(F.col(k).alias(f"_gone_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in keys]
    rest = told.where("_maybe").join(away, reduce(lambda a, b: a & b, same), "left_anti")
    return told.where(~F.col("_maybe")).select("_doc.*").unionByName(rest.select("_doc.*"))
