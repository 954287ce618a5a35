"""Exact de-duplication with a heavy-hitter split; DataFrame functions only.

Texts are equal when identical after white space runs become one space; equal
SHA-256 stands for equal text.  Texts are read once; ids and digests are written
to the shared folder and all steps read those.

1. A frequent-items sketch (Misra-Gries counters, Spark's ``approx_top_k``
   family) is kept per group of input partitions; sketches are merged in levels
   of ``MERGE_GROUPS``, so no task merges more than so many of them.
2. The sketch's candidates are counted exactly, map-side: a broadcast join
   against at most ``max_winners`` digests, then a sum.  Those with at least
   ``min_copies`` rows are the verified winners, with count and smallest id.
3. Winners are broadcast once more; their rows get their answer without a
   shuffle.  All other digests are shuffled once, 48 bytes a row.

The broadcast holds at most ``max_winners`` rows of 60 bytes, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import scratch as _scratch
from palimpsest.llm._filters import without

SKETCH_ITEMS = 8192
MERGE_GROUPS = 64


def normalised(text) -> Column:
    """White space runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"))


def heavy_hitters(rows: DataFrame, max_winners: int = 2000, min_copies: int = 50) -> DataFrame:
    """Verified winners: digest, keep_id, group_size; at most max_winners rows."""
    sketched = (
        rows.groupBy(F.expr(f"spark_partition_id() div {MERGE_GROUPS}").alias("g"))
        .agg(F.expr(f"approx_top_k_accumulate(base64(digest), {SKETCH_ITEMS})").alias("s"))
        .groupBy(F.expr(f"g div {MERGE_GROUPS}").alias("g"))
        .agg(F.expr(f"approx_top_k_combine(s, {SKETCH_ITEMS})").alias("s"))
        .groupBy(F.expr(f"g div {MERGE_GROUPS}").alias("g"))
        .agg(F.expr(f"approx_top_k_combine(s, {SKETCH_ITEMS})").alias("s"))
        # a group that always exists: the combining step can't take an empty partition's buffer
        .groupBy(F.lit(0).alias("all"))
        .agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {SKETCH_ITEMS}), {max_winners})").alias("top"))
    )
    candidates = sketched.select(F.explode("top").alias("t")).where(F.col("t.count") >= min_copies).select(F.unbase64("t.item").alias("digest"))
    return (
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= min_copies)
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_winners: int = 2000, min_copies: int = 50) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest id among rows of equal text; the row with it stays.
    A null text counts as empty; a null id loses to any other, and a group of
    null ids only has a null keep_id and keeps them; rows with the same id and
    equal text are kept or dropped alike; other columns are ignored; an empty
    table gives an empty result.
    """
    done, rest = _split(docs, id_col, text, max_winners, min_copies)[1:]
    return done.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _split(docs: DataFrame, id_col: str, text: str, max_winners: int, min_copies: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(winners, rows of winners, all other rows), rows as doc_id, digest, keep_id, group_size."""
    rows = _scratch.table(digests(docs, id_col, text), "digests")
    winners = _scratch.table(heavy_hitters(rows, max_winners, min_copies), "winners")
    hot = F.broadcast(winners.withColumnRenamed("digest", "w"))
    marked = rows.join(hot, rows["digest"] == F.col("w"), "left")
    done = marked.where(F.col("w").isNotNull()).select("doc_id", "digest", "keep_id", "group_size")
    cold = marked.where(F.col("w").isNull()).select("doc_id", "digest")
    # groups are summed map-side, so a digest that is frequent without being a winner is no large group of one task
    groups = cold.groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rest = cold.join(groups, F.col("digest") == F.col("d")).select("doc_id", "digest", "keep_id", "group_size")
    return winners, done, rest


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_winners: int = 2000, min_copies: int = 50) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged, whatever their names.

    Decided per (id, text): rows with equal text and the same id all stay or go
    together (see exact_groups); other texts of a null or repeated id are rows
    of their own.  Null and empty texts are equal; texts of any length count whole; an empty table stays empty.
    Copies of winners are removed map-side, by the broadcast; of the others only rows that a
    bitmap of those that go can't rule out are shuffled.
    """
    winners, _, rest = _split(docs, id_col, text, max_winners, min_copies)
    gone = _scratch.table(rest.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")), "gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(id_col).cast("long").alias("_id"), F.unhex(F.sha2(normalised(text), 256)).alias("_digest"))
    told = rows.join(F.broadcast(winners.select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"), F.lit(True).alias("_hot"))), "_digest", "left")
    left = told.where(F.col("_hot").isNull() | F.col("_id").eqNullSafe(F.col("_keep"))).select("_doc", "_id", "_digest")
    return without(left, {"_gone_id": F.col("_id"), "_gone_digest": F.col("_digest")}, gone.select(F.col("_id").alias("_gone_id"), F.col("_digest").alias("_gone_digest"))).select("_doc.*")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact copies among all `documents`, after white space is normalised."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
