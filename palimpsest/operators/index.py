"""Inverted indexes in blocks: build, merge, write, read, restore, look up.

An index has one row per (term, block): freq, n_docs and the postings (docid,
pos) of one range of documents, in order.  So no list grows with the corpus; a
frequent term has many blocks, and its lexicon row sums them up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import scratch
from palimpsest.operators import kernels

#: Documents per block.
BLOCK_DOCS = 4096
#: Blocks of short documents that a task builds.
TASK_BLOCKS = 16
#: Tokens up to which a block is built and restored as a whole by one call, and those of the blocks taken together.
BLOCK_TOKENS, BATCH_TOKENS = 1 << 22, 1 << 19


def block_of(doc) -> Column:
    return F.floor((F.col(doc) if isinstance(doc, str) else doc) / BLOCK_DOCS).cast("long")


def term_rows(arrays: DataFrame, *keys: str) -> DataFrame:
    """keys, term, positions: each distinct term of a document once; grouped inside the map, before any shuffle."""
    return kernels.with_terms(arrays, *keys).select(*keys, F.explode("terms").alias("t")).select(*keys, "t.term", "t.positions")


def build(rows: DataFrame, doc: str = "doc_id", block: Column | None = None, parts: int | None = None) -> DataFrame:
    """term, block, freq, n_docs, postings; rows: doc, term, positions.

    Rows that repeat a document and term give their positions each; a null
    document is in a null block of its own.  parts: so many partitions by term and block, as the
    buckets of ``runs`` want them.
    """
    placed = rows.select(F.col(doc).alias("docid"), "term", "positions", (block_of(doc) if block is None else block).alias("block"))
    if parts:
        placed = placed.repartition(parts, "term", "block")
    lists = F.array_sort(F.collect_list(F.struct("docid", "positions")))
    grouped = placed.groupBy("term", "block").agg(F.sum(F.size("positions")).alias("freq"), F.count(F.lit(1)).alias("n_docs"), lists.alias("l"))
    flat = F.flatten(F.transform("l", lambda d: F.transform(d["positions"], lambda p: F.struct(d["docid"].alias("docid"), p.alias("pos")))))
    return grouped.select("term", "block", "freq", "n_docs", flat.alias("postings"))


def partial(arrays: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The lists of slices of documents, grouped inside the map; gathered() makes an index of them.  arrays: doc (long), toks, each document in one row."""
    return kernels.packed_postings(arrays, doc, BLOCK_DOCS)


def gathered(lists: DataFrame, in_order: bool = False) -> DataFrame:
    """term, block, freq, n_docs, postings from the lists of several slices; in_order: each partition in order of term and block."""
    every = F.sort_array(F.flatten(F.collect_list("packed")))
    grouped = lists.groupBy("term", "block").agg(F.sum("n_docs").alias("n_docs"), every.alias("packed"))
    if in_order:
        grouped = grouped.sortWithinPartitions("term", "block")
    first = F.col("block") * BLOCK_DOCS
    flat = F.transform("packed", lambda p: F.struct((first + F.shiftright(p, 32)).alias("docid"), p.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos")))
    return grouped.select("term", "block", F.size("packed").cast("long").alias("freq"), "n_docs", flat.alias("postings"))


def build_arrays(arrays: DataFrame, doc: str = "doc_id", parts: int | None = None) -> DataFrame:
    """build() of whole documents (doc, toks), without a row per document and term."""
    lists = partial(arrays, doc)
    return gathered(lists.repartition(parts, "term", "block") if parts else lists)


def build_texts(texts: DataFrame, doc: str, n_docs: int) -> DataFrame:
    """The index of short documents (doc, toks), n_docs in all, with ids from 0 on.

    The texts are dealt by block, so that a task holds all documents of its blocks and lists need no exchange of postings.
    """
    n = max(texts.sparkSession.sparkContext.defaultParallelism, n_docs // (BLOCK_DOCS * TASK_BLOCKS))
    dealt = texts.select(F.col(doc).alias("docid"), block_of(doc).alias("block"), "toks").repartition(n, "block")
    rows = dealt.select("docid", "block", F.posexplode("toks").alias("pos", "term"))
    grouped = rows.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("docid", "pos"))).alias("postings"))
    size = F.size("postings").cast("long")
    return grouped.select("term", "block", size.alias("freq"), F.size(F.array_distinct("postings.docid")).cast("long").alias("n_docs"), "postings")


def texts(index: DataFrame) -> DataFrame:
    """docid, toks: documents rebuilt from the lists; all lists of a document are in one block."""
    flat = index.select("block", "term", F.explode("postings").alias("p")).select("block", "p.docid", "p.pos", "term")
    return restore(flat, "block", "docid").drop("block")


def build_blocks(texts: DataFrame, doc: str, n_docs: int) -> DataFrame:
    """build_texts() of (doc, text, n), tokens joined by spaces and their number, for blocks of at most BLOCK_TOKENS tokens each.

    Whole blocks leave a kernel side by side, so block_texts() can turn them to documents again where they are.
    """
    n = max(texts.sparkSession.sparkContext.defaultParallelism, n_docs // (BLOCK_DOCS * TASK_BLOCKS))
    dealt = texts.select(block_of(doc).alias("block"), F.col(doc).alias("docid"), "n", "text").repartition(n, "block").sortWithinPartitions("block", "docid")

    def run(batches):
        for table in kernels.whole_groups(batches, BATCH_TOKENS):
            values, offs = kernels.lists(pc.split_pattern(table.column("text").combine_chunks(), " "))
            block, docid = table.column("block").to_numpy(), table.column("docid").to_numpy()
            coded = values.dictionary_encode()
            row = np.repeat(np.arange(len(docid)), np.diff(offs))
            # blocks ascend
            group = (np.cumsum(np.diff(block, prepend=block[:1]) != 0) * len(coded.dictionary))[row] + coded.indices.to_numpy()
            order = np.argsort(group, kind="stable")
            new = np.diff(group[order], prepend=-1) != 0
            head, doc_row = np.flatnonzero(new), row[order]
            ends = np.append(head, len(order))
            n_docs = np.add.reduceat((new | (np.diff(doc_row, prepend=-1) != 0)).astype(np.int64), head)
            pos = (np.arange(len(row)) - offs[:-1][row])[order].astype(np.int32)
            one = pa.StructArray.from_arrays([pa.array(docid[doc_row]), pa.array(pos)], names=["docid", "pos"])
            cols = [coded.dictionary.take(coded.indices.take(pa.array(order[head]))), pa.array(block[doc_row[head]]), pa.array(np.diff(ends)), pa.array(n_docs), kernels.to_lists(one, ends, None)]
            yield pa.RecordBatch.from_arrays(cols, names=["term", "block", "freq", "n_docs", "postings"])

    return dealt.mapInArrow(run, "term string, block long, freq long, n_docs long, postings array<struct<docid: long, pos: int>>")


def block_texts(index: DataFrame) -> DataFrame:
    """docid, text: documents rebuilt from the lists of build_blocks(), whose blocks stand whole side by side."""
    src = index.select("block", F.size("postings").alias("n"), "term", "postings")

    def run(batches):
        for table in kernels.whole_groups(batches, BATCH_TOKENS):
            values, offs = kernels.lists(table.column("postings"))
            docid, pos = values.field(0).to_numpy(), values.field(1).to_numpy()
            row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
            order = np.lexsort((pos, docid))
            head = np.flatnonzero(np.concatenate([[True], np.diff(docid[order]) != 0])) if len(order) else order
            words = table.column("term").combine_chunks().take(pa.array(row[order]))
            yield pa.RecordBatch.from_arrays([pa.array(docid[order[head]]), pc.binary_join(kernels.to_lists(words, np.append(head, len(order)), None), " ")], names=["docid", "text"])

    return src.mapInArrow(run, "docid long, text string")


def lexicon(index: DataFrame) -> DataFrame:
    """term, freq, n_docs, n_blocks: one row per term, without its lists."""
    return index.groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("n_blocks"))


def merge(*runs: DataFrame) -> DataFrame:
    """One index from several with disjoint documents; lists of an equal term and block follow each other in run order."""
    every = runs[0].withColumn("run", F.lit(0))
    for k, r in enumerate(runs[1:], 1):
        every = every.unionByName(r.withColumn("run", F.lit(k)))
    lists = F.array_sort(F.collect_list(F.struct("run", "postings")))
    return every.groupBy("term", "block").agg(F.sum("freq").alias("freq"), F.sum("n_docs").alias("n_docs"), F.flatten(F.transform(lists, lambda x: x["postings"])).alias("postings"))


def write(index: DataFrame, path: str) -> None:
    """The index as files that hold ranges of terms, each in order of term and block."""
    index.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(path)


def write_arrays(arrays: DataFrame, path: str, doc: str = "doc_id") -> None:
    """write() of build_arrays(): the lists of slices go to their range of terms, and are gathered there."""
    lists = scratch.table(partial(arrays, doc), "lists")  # ranges are found by a first reading
    gathered(lists.repartitionByRange("term", "block"), True).write.mode("overwrite").parquet(path)
    scratch.drop(lists)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """An index of write(); a filter on terms reads only the row groups that may hold them."""
    return spark.read.parquet(path)


def read(index: DataFrame) -> DataFrame:
    """term, docid, pos: the flat postings."""
    return index.select("term", F.explode("postings").alias("p")).select("term", "p.docid", "p.pos")


def restore(postings: DataFrame, *keys: str, word: str = "term") -> DataFrame:
    """keys, toks: token arrays rebuilt from flat postings."""
    return postings.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", word)))[word].alias("toks"))


def documents(index: DataFrame) -> DataFrame:
    """docid, toks: restore() of a whole index; lists are turned to documents inside the map, without a row per posting."""
    # lists of the same documents side by side, so that a slice holds many words of each
    words = kernels.by_document(index.sortWithinPartitions("block", "term")).repartition("docid")
    return words.groupBy("docid").agg(F.sort_array(F.flatten(F.collect_list("words")))["term"].alias("toks"))


def all_terms(index: DataFrame, terms: list[str]) -> DataFrame:
    """docid of documents that hold every term."""
    wanted = sorted(set(terms))
    hits = read(index.where(F.col("term").isin(wanted))).select("term", "docid").distinct()
    return hits.groupBy("docid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("docid")


def phrase(rows: DataFrame, terms: list[str], *keys: str) -> DataFrame:
    """keys, pos: places where the terms follow each other; rows: keys, term, pos."""
    which = F.explode(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(terms))), lambda x: x["t"] == F.col("term")))
    hits = rows.where(F.col("term").isin(terms)).select(*keys, "pos", which.alias("w")).select(*keys, (F.col("pos") - F.col("w.k")).alias("pos"), "w.k").where("pos >= 0")
    return hits.distinct().groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select(*keys, "pos")
