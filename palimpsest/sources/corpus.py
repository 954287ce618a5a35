"""Corpus sources: documents, versions, catalogues, posting files, parameter lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import kernels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenize(text) -> Column:
    """Lower-cased runs of a-z and 0-9, as an array; null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, toks of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", tokenize("text").alias("toks"))


def tokens(arrays: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, term: one row per token."""
    return arrays.select(*keys, F.posexplode("toks").alias("pos", "term"))


def word_id(term="term") -> Column:
    """Stable 32-bit word id of a term, the same on every machine and at every scale."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long")


def collection_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, collection of version_texts(), not numbered and in no exchange."""
    # tokens hold no spaces, and one text is a third of their array in an exchange
    return kernels.with_collection(token_arrays(spark, sf_dir), "doc_id")


def version_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collection, version, doc_id, text: documents grouped to collections of near copies, their tokens joined by spaces.

    The key is the smallest MD5 of a document's n-grams (short texts: of all
    tokens), so copies and near copies meet.  Equal texts make large
    collections; what works on a collection as one group folds them first.
    """
    order = Window.partitionBy("collection").orderBy("doc_id")
    return collection_texts(spark, sf_dir).select("collection", (F.row_number().over(order) - 1).alias("version"), "doc_id", "text")


def joined_tokens(text="text") -> Column:
    """The tokens that single spaces join in a text."""
    return F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collection, version, doc_id, toks of version_texts()."""
    return version_texts(spark, sf_dir).select("collection", "version", "doc_id", joined_tokens().alias("toks"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collection, version, toks: a conversation is a document, its turns are the versions."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("collection"), F.col("turn").alias("version"), tokenize("text").alias("toks"))


def catalog(version_rows: DataFrame) -> DataFrame:
    """collection, n_versions."""
    return version_rows.groupBy("collection").agg(F.count(F.lit(1)).alias("n_versions"))


def read_catalog_tsv(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_versions from lines ``id TAB ignored TAB n_versions``; shorter or malformed lines are skipped."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(F.size(parts) >= 3)
    ids = lines.select(F.expr("try_cast(split(value, '\t')[0] AS BIGINT)").alias("doc_id"), F.expr("try_cast(split(value, '\t')[2] AS INT)").alias("n_versions"))
    return ids.where("doc_id is not null and n_versions is not null")


def read_doubles(spark: SparkSession, path: str, name: str = "w") -> DataFrame:
    """One row per white-space separated number of a text file (parameter lists, samples)."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("x")).where("x != ''")
    return words.select(F.col("x").cast("double").alias(name))


def encode_postings(version_rows: DataFrame, *keys: str) -> DataFrame:
    """Per version its terms with their positions: keys, terms array<struct<wid, positions>>."""
    rows = version_rows.select(*keys, F.posexplode("toks").alias("pos", "term")).withColumn("wid", word_id())
    lists = rows.groupBy(*keys, "wid").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return lists.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("wid", "positions"))).alias("terms"))


def decode_postings(encoded: DataFrame, *keys: str) -> DataFrame:
    """keys, wid, pos: the flat postings of nested posting lists."""
    return encoded.select(*keys, F.explode("terms").alias("t")).select(*keys, F.col("t.wid").alias("wid"), F.explode("t.positions").alias("pos"))


def vocabulary(token_rows: DataFrame) -> DataFrame:
    """term, freq, term_id: dense ids in term order.

    Ranked within two-letter prefixes and shifted by the prefixes' counts, so no
    task sorts all terms.
    """
    terms = token_rows.groupBy("term").agg(F.count(F.lit(1)).alias("freq")).withColumn("prefix", F.substring("term", 1, 2))
    sizes = terms.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    # at most 36 + 36 * 36 prefixes
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("prefix", "base")
    own = Window.partitionBy("prefix").orderBy("term")
    return terms.withColumn("rank", F.row_number().over(own)).join(F.broadcast(base), "prefix").select("term", "freq", (F.col("base") + F.col("rank") - 1).alias("term_id"))
