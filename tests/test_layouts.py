"""Binary layouts: files of other programs, round trips, partitions, commits."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.sources import layouts


def ints(path, *x):
    path.write_bytes(struct.pack(f"<{len(x)}I", *x))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def formats(spark):
    layouts.register(spark)
    return spark


def test_files_of_other_programs(formats, tmp_path):
    """Files as the layouts say, written byte by byte."""
    top = tmp_path / "corpus"
    top.mkdir()
    ints(top / "numv", 2, 2, 1)
    ints(top / "word_size", 3, 3, 0, 2)
    ints(top / "completeFile", 7, 8, 4_000_000_000, 9, 9)
    assert rows(formats.read.format("corpus_files").load(str(top)), "doc", "version", "toks") == [(0, 0, [7, 8, 4_000_000_000]), (0, 1, []), (1, 0, [9, 9])]
    ints(top / "url.idx", 2, 12, 2, 44, 1)
    assert rows(formats.read.format("corpus_files").load(f"file://{top}"), "doc", "version") == [(12, 0), (12, 1), (44, 0)]

    top = tmp_path / "postings"
    top.mkdir()
    ints(top / "url.idx", 2, 12, 3, 44, 1)
    ints(top / "12", 2, 5, 2, 0, 3, 6, 1, 1, 0, 1, 5, 1, 2)
    ints(top / "44", 1, 9, 1, 0)
    got = [(d, v, [(t["wid"], t["positions"]) for t in x]) for d, v, x in rows(formats.read.format("posting_files").load(str(top)), "doc", "version", "terms")]
    assert got == [(12, 0, [(5, [0, 3]), (6, [1])]), (12, 1, []), (12, 2, [(5, [2])]), (44, 0, [(9, [0])])]

    top = tmp_path / "index"
    top.mkdir()
    (top / "postings.idx").write_bytes(struct.pack("<qiI", 0, 2, 5) + struct.pack("<qiI", 16, 1, 8))
    ints(top / "postings.dat", 1, 0, 1, 4, 3, 9)
    df = formats.read.format("index_files").load(str(top))
    assert [(w, [tuple(p) for p in x]) for w, x in rows(df, "wid", "postings")] == [(5, [(1, 0), (1, 4)]), (8, [(3, 9)])]

    top = tmp_path / "fragments"
    top.mkdir()
    ints(top / "fragments", 0, 4, 2, 10, 0, 11, 3, 1, 2, 1, 10, 4)
    df = formats.read.format("fragment_files").load(str(top))
    assert [(i, n, [tuple(a) for a in x]) for i, n, x in rows(df, "frag_id", "len", "apps")] == [(0, 4, [(10, 0), (11, 3)]), (1, 2, [(10, 4)])]


def test_round_trips_in_small_ranges(formats, tmp_path):
    r = random.Random(4)
    versions = [(d * 3, v, [r.randrange(2**32) for _ in range(r.choice([0, 1, 5, 90]))]) for d in range(40) for v in range(r.randint(1, 4))]
    df = formats.createDataFrame(versions, "doc long, version long, toks array<long>").repartitionByRange(3, "doc").sortWithinPartitions("doc", "version")
    at = str(tmp_path / "c")
    df.write.format("corpus_files").mode("overwrite").save(at)
    assert rows(formats.read.format("corpus_files").load(at), "doc", "version", "toks") == versions
    # the planner's ranges: several per part, together every document once
    reader = layouts.CorpusReader(at)
    layouts.RANGE_BYTES, before = 500, layouts.RANGE_BYTES
    try:
        parts = reader.partitions()
        assert len(parts) > 10
        got = [row for p in parts for b in reader.read(p) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    finally:
        layouts.RANGE_BYTES = before
    assert got == versions

    terms = df.select("doc", "version", F.expr("transform(array_distinct(toks), w -> struct(w as wid, transform(filter(sequence(0, size(toks) - 1), i -> size(toks) > 0 and toks[i] = w), i -> int(i)) as positions))").alias("terms"))
    at = str(tmp_path / "p")
    terms.sortWithinPartitions("doc", "version").write.format("posting_files").mode("overwrite").save(at)
    assert rows(formats.read.format("posting_files").load(at), "doc", "version", "terms") == rows(terms, "doc", "version", "terms")

    index = formats.createDataFrame([(w, [(d, p) for d in range(w % 7 + 1) for p in range(3)]) for w in range(500)], "wid long, postings array<struct<docid: long, pos: long>>")
    at = str(tmp_path / "i")
    index.repartitionByRange(4, "wid").sortWithinPartitions("wid").write.format("index_files").mode("overwrite").save(at)
    assert rows(formats.read.format("index_files").load(at), "wid", "postings") == rows(index, "wid", "postings")
    # pushed filters read only the lists asked for
    one = layouts.IndexReader(at)
    assert not list(one.pushFilters([layouts.In(("wid",), (3, 77)), layouts.EqualTo(("wid",), 77)]))
    assert [b.column(0).to_pylist() for p in one.partitions() for b in one.read(p)] == [[77]]


def test_overwrite_append_and_failure(formats, tmp_path):
    at = str(tmp_path / "f")
    frags = lambda a, b: formats.createDataFrame([(i, 2, [(i, 0)]) for i in range(a, b)], "frag_id long, len long, apps array<struct<version: long, offset: long>>")
    frags(0, 5).write.format("fragment_files").mode("overwrite").save(at)
    frags(5, 9).write.format("fragment_files").mode("append").save(at)
    have = lambda: [x[0] for x in rows(formats.read.format("fragment_files").load(at), "frag_id")]
    assert have() == list(range(9))
    frags(20, 22).write.format("fragment_files").mode("overwrite").save(at)
    assert have() == [20, 21]
    # a job that fails leaves what was there
    corpus = str(tmp_path / "c")
    good = formats.createDataFrame([(1, 0, [1])], "doc long, version long, toks array<long>")
    good.write.format("corpus_files").mode("overwrite").save(corpus)
    bad = formats.createDataFrame([(2, 0, [1]), (2, 0, [2])], "doc long, version long, toks array<long>").coalesce(1)
    with pytest.raises(Exception, match="sorted by doc"):
        bad.write.format("corpus_files").mode("overwrite").save(corpus)
    assert rows(formats.read.format("corpus_files").load(corpus), "doc") == [(1,)]
    # an empty table is an empty folder of parts
    empty = str(tmp_path / "e")
    good.limit(0).write.format("corpus_files").mode("overwrite").save(empty)
    assert formats.read.format("corpus_files").load(empty).count() == 0
