"""Index blocks from a stream of documents, and their compaction (an extension of the batch engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import index
from palimpsest.operators.runs import Runs
from palimpsest.sources.corpus import tokenize


def append_blocks(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of (doc_id, text) becomes one index under ``path``, keyed by its batch id.

    A batch that runs again after a failure overwrites its own files, so every
    document is indexed exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = index.term_rows(batch.select("doc_id", tokenize("text").alias("toks")), "doc_id")
        index.write(index.build(rows), f"{path}/run={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_runs(stream: DataFrame, runs: Runs, checkpoint: str, fanout: int | None = None) -> StreamingQuery:
    """Each micro-batch of (doc_id, text) becomes a run of ``runs``, which are compacted as their levels fill.

    A run is named by its batch, so a batch that runs again after a failure adds
    nothing, also where its run was merged in the meantime; readers see whole batches only.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = index.term_rows(batch.select("doc_id", tokenize("text").alias("toks")), "doc_id")
        runs.append(index.build(rows), f"batch-{number}")
        runs.compact(fanout)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, path: str) -> DataFrame:
    """All runs merged to one index: term, block, freq, n_docs, postings in document order."""
    runs = spark.read.parquet(path)
    lists = F.array_sort(F.flatten(F.collect_list("postings")))
    return runs.groupBy("term", "block").agg(F.sum("freq").alias("freq"), F.sum("n_docs").alias("n_docs"), lists.alias("postings"))
