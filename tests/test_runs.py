"""Runs of an index: merging without an exchange, levels, snapshots, repeated and competing writers."""

import bisect
import random

import pytest

from palimpsest.operators import index
from palimpsest.operators.runs import Conflict, Runs


def batch(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, toks array<string>")
    return index.build(index.term_rows(df, "doc_id"))


def content(df):
    return sorted((r["term"], r["block"], r["freq"], r["n_docs"], sorted(tuple(p) for p in r["postings"])) for r in df.collect())


def test_appends_and_compactions_equal_a_batch_build(spark, tmp_path):
    r = random.Random(6)
    docs = [(d, [r.choice("abcdefgh") for _ in range(r.randint(0, 12))]) for d in range(9000, 9000 + 60)] + [(5, ["a", "z"]), (4200, ["a"])]
    r.shuffle(docs)
    starts = [sum(len(docs[j::7]) for j in range(k)) for k in range(7)]
    held = Runs(spark, str(tmp_path / "x"), 4)
    assert content(held.read()) == []
    for k in range(7):
        held.append(batch(spark, docs[k::7]), f"b{k}")
        if k % 2:
            held.compact(2)
        seen = [d for j in range(k + 1) for d in docs[j::7]]
        if k in (1, 6):
            assert content(held.read()) == content(batch(spark, seen))
    # lists are in the order in which documents were appended
    order = {d: k for k, (d, _) in enumerate(d for j in range(7) for d in docs[j::7])}
    for r in held.read().collect():
        run_of = [order[p["docid"]] for p in r["postings"]]
        assert [bisect.bisect_right(starts, k) for k in run_of] == sorted(bisect.bisect_right(starts, k) for k in run_of)
    levels = [x["level"] for x in held.state()["runs"]]
    assert max(levels) >= 2 and all(levels.count(k) < 2 for k in levels if k)
    # a run that was appended, and merged since, isn't added again
    held.append(batch(spark, docs[0::7]), "b0")
    assert content(held.read()) == content(batch(spark, docs))
    # the same index, opened anew
    assert content(Runs(spark, str(tmp_path / "x")).read()) == content(batch(spark, docs))


def test_merge_has_no_exchange(spark, tmp_path):
    held = Runs(spark, str(tmp_path / "x"), 4)
    for k in range(3):
        held.append(batch(spark, [(k, ["a", "b"]), (k + 10, ["b", "c"])]))
    plan = held.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_snapshots_and_conflicts(spark, tmp_path):
    held = Runs(spark, str(tmp_path / "x"), 4)
    held.append(batch(spark, [(1, ["a"])]), "one")
    before, old = held.read(), held.state()["number"]
    held.append(batch(spark, [(2, ["a"])]), "two")
    held.compact(2)
    assert content(before) == content(held.read(old)) == [("a", 0, 1, 1, [(1, 0)])]
    assert content(held.read()) == [("a", 0, 2, 2, [(1, 0), (2, 0)])]
    # a writer that began from an older state fails and leaves nothing to see
    with pytest.raises(Conflict):
        held._publish(held.state()["number"], held.state())
    assert content(held.read()) == [("a", 0, 2, 2, [(1, 0), (2, 0)])]
    held.vacuum()
    assert content(held.read()) == [("a", 0, 2, 2, [(1, 0), (2, 0)])]
    assert len([n for n in held._files(f"{held.path}/runs") if n.startswith("run=")]) == 1


def test_run_dealt_by_bucket_has_one_exchange(spark, tmp_path):
    rows = spark.createDataFrame([(d, f"t{(d * k) % 11}", [k]) for d in range(60) for k in range(3)], "doc_id long, term string, positions array<int>")
    held = Runs(spark, str(tmp_path / "dealt"), 8)
    dealt = index.build(rows, parts=8)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    held.append(dealt, "one", dealt=True)
    (stored,) = (tmp_path / "dealt" / "runs").glob("run=*")
    buckets = [f.name.split("_")[-1].split(".")[0] for f in stored.glob("*.parquet")]
    assert len(buckets) == len(set(buckets)) <= 8
    plain = lambda df: sorted((x.term, x.block, x.freq, x.n_docs, [tuple(p) for p in x.postings]) for x in df.collect())
    assert plain(held.read()) == plain(index.build(rows))
