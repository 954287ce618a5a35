"""Stream blocks and their compaction equal the batch index."""

from palimpsest.operators import index
from palimpsest.sources.corpus import tokenize
from palimpsest.streaming import index_stream


def test_blocks_merge_to_the_batch_index(spark, tmp_path):
    rows = [(i, f"a{i % 3} b c{i} b") for i in range(12)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k in range(3):
        df.where(f"doc_id % 3 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    index_stream.append_blocks(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sorted(map(tuple, index_stream.compact(spark, str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, index.build(index.term_rows(df.select("doc_id", tokenize("text").alias("toks")), "doc_id")).collect()))
    assert got == want


def test_stream_of_runs_equals_the_batch_index(spark, tmp_path):
    """Files one by one, levels of two, and a batch that is written again."""
    from palimpsest.operators.runs import Runs

    docs = [(k, f"word{k % 3} common {'x' * (k % 4)}") for k in range(12)]
    for k in range(4):
        spark.createDataFrame(docs[k::4], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    runs = Runs(spark, f"{tmp_path}/runs", 4)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    index_stream.append_runs(stream, runs, f"{tmp_path}/check", fanout=2).awaitTermination()
    rows = index.term_rows(spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", tokenize("text").alias("toks")), "doc_id")
    content = lambda df: sorted((r["term"], r["block"], r["freq"], r["n_docs"], sorted(tuple(p) for p in r["postings"])) for r in df.collect())
    assert content(runs.read()) == content(index.build(rows))
    assert len(runs.state()["runs"]) < 4 and sorted(h for r in runs.state()["runs"] for h in r["holds"]) == [f"batch-{k}" for k in range(4)]
    before = runs.state()
    runs.append(index.build(rows), "batch-0")
    assert runs.state() == before
