"""What queries on large corpora exchange, and the kernels that save it, against plain versions."""

import hashlib
import random

from pyspark.sql import functions as F

from palimpsest.operators import index, intervals, kernels, segments
from palimpsest.plans import queries
from palimpsest.sources import layouts

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    """Exchanges in the plan of a result, without what runs before it is returned."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" :+-*()0123456789").startswith("Exchange") for line in plan.splitlines())


def wid(term: str) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16)


def test_word_lists_and_words(spark, tmp_path):
    """Lists by word id are those of the tokens, and give them back, also through posting files."""
    r = random.Random(3)
    docs = [(k // 3, k % 3, [r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.choice([0, 1, 7, 300]))]) for k in range(60)]
    df = spark.createDataFrame(docs, "doc long, version long, toks array<string>").repartitionByRange(3, "doc").sortWithinPartitions("doc", "version")
    lists = kernels.with_word_lists(df, "doc", "version")
    got = {(x.doc, x.version): [(t.wid, t.positions) for t in x.terms] for x in lists.collect()}
    assert got == {(d, v): sorted((wid(w), [i for i, t in enumerate(toks) if t == w]) for w in set(toks)) for d, v, toks in docs}
    layouts.register(spark)
    at = str(tmp_path / "p")
    lists.write.format("posting_files").mode("overwrite").save(at)
    back = kernels.with_words(spark.read.format("posting_files").load(at), "doc", "version")
    assert sorted(map(tuple, back.collect())) == [(d, v, [wid(t) for t in toks]) for d, v, toks in docs]


def test_versions_are_written_as_they_were_grouped(spark):
    """Numbering the versions takes the one exchange that groups them."""
    df = queries.numbered_versions(spark, SF)
    assert exchanges(df) == 1
    # each document in one partition, in order
    rows = df.select(F.spark_partition_id().alias("p"), "doc", "version").collect()
    assert len({(x.p, x.doc) for x in rows}) == len({x.doc for x in rows})
    assert all((a.doc, a.version) < (b.doc, b.version) for a, b in zip(rows, rows[1:], strict=False) if a.p == b.p)


def test_indexes_of_whole_documents(spark, tmp_path):
    """Lists grouped by slices in the map are those of single rows, and the files of an index give its documents back."""
    r = random.Random(9)
    ids = [*range(-20, 20), *range(4090, 4100), 2**40, None]
    r.shuffle(ids)
    docs = [(d, [r.choice("abcdefghij") for _ in range(r.choice([0, 1, 7, 300]))] if d is not None else ["a", "b", "a"]) for d in ids]
    df = spark.createDataFrame(docs, "doc_id long, toks array<string>").repartition(5)
    plain = lambda rows: sorted(((x.term, x.block, x.freq, x.n_docs, [tuple(p) for p in x.postings]) for x in rows.collect()), key=repr)
    before, kernels.BATCH_VALUES = kernels.BATCH_VALUES, 500
    try:
        want = plain(index.build(index.term_rows(df, "doc_id")))
        assert plain(index.build_arrays(df)) == want
        assert plain(index.build_arrays(df, parts=3)) == want
        at = str(tmp_path / "i")
        index.write_arrays(df, at)
    finally:
        kernels.BATCH_VALUES = before
    held = index.open_index(spark, at)
    assert plain(held) == want and held.dtypes == index.build(index.term_rows(df, "doc_id")).dtypes
    files = {}
    for x in held.select("term", "block", F.col("_metadata.file_path").alias("f")).collect():
        files.setdefault(x.f, []).append((x.term, -(2**60) if x.block is None else x.block))
    assert all(v == sorted(v) for v in files.values())
    assert {x.docid: x.toks for x in index.documents(held).collect()} == {d: t for d, t in docs if t}


def test_tree_of_boundaries(spark):
    """Ancestors by search are those of the sweep over intervals, from one reading of the versions."""
    r = random.Random(5)
    docs = [(str(k % 7), k, [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.choice([0, 1, 9, 10, 11, 60, 400]))]) for k in range(50)]
    df = spark.createDataFrame(docs, "c string, v long, toks array<string>").repartition(3)
    windows, keys = (5, 20, 40), ("c", "v")
    tree = kernels.with_tree(df, windows, *keys)
    levels = segments.refining_levels(kernels.with_bounds(df, windows, *keys), [f"bounds{w}" for w in windows], *keys)
    plain = lambda rows: sorted(map(tuple, rows.collect()), key=repr)
    blocks = segments.hierarchy(tree, 3, *keys)
    assert plain(blocks.drop("parent")) == plain(levels)
    assert plain(blocks.where("parent is not null").select(*keys, "level", "idx", "parent")) == plain(segments.contained(levels, *keys))
    assert plain(segments.tree_pairs(tree, 3, *keys)) == plain(segments.tree_conflicts(levels, *keys))
    assert exchanges(queries.tree_conflicts(spark, SF)) == 1


def test_containment_sweeps_once(spark):
    df = spark.createDataFrame([(0, 0, 5, 1), (0, 0, 5, 2), (0, 1, 3, 3)], "c long, start long, end long, id long")
    got = intervals.containing(df, ("c",), "id")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((x.a_id, x.b_id) for x in got.collect()) == [(1, 2), (1, 3), (2, 1), (2, 3)]
