"""The corpus pipeline: toxicity, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before
kept, and returns a DataFrame that is written as Parquet and read again for the
next.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest import scratch as _scratch
from palimpsest.llm.decontaminate import drop_contaminated
from palimpsest.llm.exact_dedup import drop_exact_duplicates
from palimpsest.llm.near_dedup import drop_near_duplicates
from palimpsest.llm.packing import pack
from palimpsest.llm.toxicity import drop_toxic, fit
from palimpsest.session import ship


_tables: list[str] = []


def _stage_tables(spark: SparkSession):
    """Tables of the stage that begins; those of earlier stages, whose results are written, go."""
    _scratch.release(spark, _tables)
    return _scratch.owned(_tables)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the scores are learned from labelled rows that aren't held out.

    Decided row by row, so rows that repeat go or stay alike, and ties don't matter.  Null and empty texts score 0
    and stay, as does all without a label to learn from; texts of any length are scored whole; null ids
    are scored but never learned from; an empty table stays empty; columns of any name are passed on.
    """
    ship(spark)
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the smallest id.

    Rows with equal text and the same id all stay or go; a null id loses to any other, and a group
    of null ids only stays whole.  Null and empty texts are equal, so one of them stays; texts of any
    length count whole; an empty table stays empty; columns of any name are passed on.
    """
    with _stage_tables(spark):
        return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id: five-word shingles, similarity 0.8.

    Null and empty texts have no shingles and stay; shorter texts are one shingle; rows with the same
    id are documents of their own unless they repeat the text as well; a group of null ids only stays whole; texts of any length are
    compared whole; an empty table stays empty; columns of any name are passed on.
    """
    ship(spark)
    with _stage_tables(spark):
        return drop_near_duplicates(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Decided row by row; null and empty texts and null ids stay; texts of any length are searched whole; of ties between alignments
    any one decides alike; items without a word match nothing; an empty benchmark keeps all; an empty table stays empty; columns of any name are passed on.
    """
    ship(spark)
    with _stage_tables(spark):
        return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents, tokenised and packed into sequences of at most 4096 tokens.

    Null and empty texts are one end token; rows that repeat, and null ids, are packed one by one; documents of equal
    length are taken in order of id and text; texts of any length are cut into pieces; an empty table gives no pieces; other columns are left out.
    """
    import public_tokenizers

    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Toxicity scores and token ids are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{_scratch.folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
