"""Chains of fragments: found in batches of whole collections, in rounds of joins, and one by one."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import fusion, grammar, index, versioned
from palimpsest.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(8)
    text = lambda n: [f"w{r.randrange(60)}" for _ in range(n)]
    rows = [(f"{k:06x}", 0, text(n)) for k, n in enumerate([0, 1, 9, 11, 300])]
    base = text(260)
    rows += [("c0", v, base[: 20 * v] + text(v) + base[20 * v :]) for v in range(6)] + [("c1", v, base) for v in range(9)] + [("c1", 9, base[:130]), ("c2", 0, text(90) * 3), (None, 0, text(80))]
    return spark.createDataFrame([(c, v, " ".join(t), len(t)) for c, v, t in rows], "collection string, version long, text string, n int").cache()


def walked(cut) -> set:
    """(collection, head, id, rank, n) of the chains, from lists of neighbours; cut: (collection, version, start, hash)."""
    sides, seqs = {}, {}
    for c, v, _, h in sorted(cut, key=lambda x: (str(x[0]), x[1], x[2])):
        seqs.setdefault((c, v), []).append(h)
    for (c, _), seq in seqs.items():
        for k, h in enumerate(seq):
            before, after = sides.setdefault((c, h), (set(), set()))
            before.add(seq[k - 1] if k else None)
            after.add(seq[k + 1] if k + 1 < len(seq) else None)
    right = {}
    for (c, h), (_, after) in sides.items():
        (x, *more) = after
        if not more and x is not None and sides[c, x][0] == {h}:
            right[c, h] = x
    tails = {(c, x) for (c, _), x in right.items()}
    out = set()
    for c, h in sides:
        if (c, h) in right and (c, h) not in tails:
            chain = [h]
            while (c, chain[-1]) in right:
                chain.append(right[c, chain[-1]])
            out |= {(c, h, x, k, len(chain)) for k, x in enumerate(chain)}
    return out


@pytest.mark.parametrize("limit", [1_000_000, 700, 0])
def test_chains_of_batches_and_rounds(spark, texts, monkeypatch, limit):
    monkeypatch.setattr(fusion, "GROUP_TOKENS", limit)
    monkeypatch.setattr(fusion, "BATCH_TOKENS", 500)
    rows = texts.select("collection", "version", grammar.toks_of().alias("toks"))
    cut = {(x.collection, x.version, x.start, x.hash) for x in versioned.fragment_rows(rows, (20,)).collect()}
    # joins on the key leave a null collection out
    keep = texts if limit > 700 else texts.where("collection is not null")
    got = fusion.window_groups(keep, 20).collect()
    want = {x for x in walked(cut) if limit > 700 or x[0] is not None}
    assert len(got) == len(want) and {tuple(x) for x in got} == want and any(x[4] > 2 for x in want)


def test_copies_make_no_collection_large(spark, texts):
    """A collection whose distinct texts are few is one batch, whatever its copies."""
    small, large = grammar.folded_by_size(texts, 700)
    assert {(x.version, x.copies) for x in small.where("collection = 'c1'").collect()} == {(0, 9), (9, 1)}
    assert {x.collection for x in large.collect()} == {"c0"}
    assert small.where("collection != 'c1'").agg(F.max("copies")).first()[0] == 1


def test_fused_groups_exchange_texts_once(spark):
    """No fragment is exchanged: the plan's one exchange deals texts to whole collections."""
    plan = queries.QUERIES["fused_groups"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum(line.lstrip(" :+-*()0123456789").startswith("Exchange") for line in plan.splitlines()) == 1


@pytest.mark.parametrize(("limit", "block_tokens"), [(1 << 40, 1 << 22), (700, 1 << 22), (1 << 40, 100)])
def test_fused_index_from_batches(spark, texts, monkeypatch, limit, block_tokens):
    """The tables of an index that is built fused are those of one that is fused afterwards, for large collections and long texts too."""
    monkeypatch.setattr(index, "BLOCK_DOCS", 8)
    monkeypatch.setattr(index, "BLOCK_TOKENS", block_tokens)
    rows = texts.where("collection is not null and n > 0")
    arrays = rows.select("collection", "version", grammar.toks_of().alias("toks"))
    want = fusion.fuse(versioned.build(arrays, (5, 20, 9)))
    small, large = grammar.by_size(rows, limit)
    got = fusion.build(small.repartition("collection").sortWithinPartitions("collection", "version"), large, (5, 20, 9))
    assert (large is None) == (limit > 700) and got.whole == (block_tokens > 100)
    for name in ("chosen", "dictionary", "metadata", "postings"):
        cols = sorted(getattr(want, name).columns)
        assert sorted(getattr(got, name).columns) == cols
        a, b = (sorted(tuple(map(str, x)) for x in getattr(one, name).select(*cols).collect()) for one in (got, want))
        assert a == b, name
    back = {(x.collection, x.version): x.text for x in versioned.restored_texts(got).collect()}
    assert back == {(x.collection, x.version): x.text for x in rows.collect()}


def test_fused_index_has_no_rows_of_tokens(spark):
    """Postings are built and turned to texts in kernels: the plan explodes applications only."""
    plan = queries.QUERIES["fused_round_trip"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate" in line]
    assert made and all("explode(apps" in line for line in made), plan
