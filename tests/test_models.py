"""Recurrences and greedy steps against plain models and fixed examples."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import hashing as H
from palimpsest.operators import features, fragments, grammar, kernels, optimise, segments, versioned
from palimpsest.sources import corpus, sinks


def test_word_hash_fixed_values(spark):
    keys = [0, 1, 2, 3, 10, 12345, 2147483648, 4294967295]
    df = spark.createDataFrame([(k,) for k in keys], "wid long")
    assert [r.b for r in H.with_word_hash(df).collect()] == [80, 69, 139, 209, 243, 173, 73, 15]
    assert [r.b for r in df.select(H.word_hash(F.col("wid")).alias("b")).collect()] == [80, 69, 139, 209, 243, 173, 73, 15]


def test_ngram_hash_fixed_values(spark):
    df = spark.createDataFrame([(list(range(s, s + 10)),) for s in (1, 2, 3)], "x array<long>")
    got = [r.h for r in df.select(H.ngram_hash(lambda k: F.col("x")[k]).alias("h")).collect()]
    assert got == [3536575543, 2644972353, 1753434699]


def test_radius_fixed_values():
    assert features.radii_of(np.array([7, 5, 9, 2, 8, 8, 6, 1, 4, 3, 9, 2])).tolist() == [0, 1, 0, 3, 0, 0, 0, 4, 0, 1, 0, 0]


def test_radius_against_plain():
    r = random.Random(1)
    for _ in range(200):
        h = [r.randrange(6) for _ in range(r.randint(1, 25))]
        want = []
        for i in range(len(h)):
            k = 0
            while i - k - 1 >= 0 and i + k + 1 < len(h) and h[i] < h[i - k - 1] and h[i] < h[i + k + 1]:
                k += 1
            want.append(k)
        assert features.radii_of(np.array(h)).tolist() == want


def test_winnow_fixed_values(spark):
    h = [7, 5, 9, 2, 8, 8, 6, 1, 4, 3, 9, 2]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(h)], "d long, pos int, h long")
    assert {r.pos for r in features.winnow(df, 3, "d").collect()} == {0, 3, 6, 7, 9, 11}
    assert {r.pos for r in features.winnow(df, 5, "d").collect()} == {0, 3, 7}
    for w, want in ((3, [0, 3, 6, 7, 9, 11]), (5, [0, 3, 7])):
        bounds, at = kernels.winnowed(np.array(h), np.array([0, len(h)]), np.array([len(h) + 9]), w)
        assert bounds.tolist() == want and at.tolist() == [0, len(want)]


def test_kernels_equal_the_columns(spark):
    r = random.Random(7)
    rows = [(k, 0, [r.choice("abcdefgh") + r.choice(["", "x", "0"]) for _ in range(r.choice([0, 1, 9, 10, 11, 12, 30, 200]))]) for k in range(60)]
    df = spark.createDataFrame(rows, "c long, v long, toks array<string>").repartition(3)
    keys = ("c", "v")
    grams = features.ngrams(corpus.tokens(df, *keys), *keys)
    assert sorted(map(tuple, features.gram_rows(df, *keys).collect())) == sorted(map(tuple, grams.collect()))
    for w in (1, 5, 20):
        want = set(map(tuple, features.winnow(grams, w, *keys).collect())) | {(c, v, 0) for c, v, t in rows if t}
        assert sorted(map(tuple, features.cuts(df, w, *keys).collect())) == sorted(want)
    plain = {c: min((hashlib.md5(" ".join(t[i : i + 10]).encode()).hexdigest() for i in range(len(t) - 9)), default=hashlib.md5(" ".join(t).encode()).hexdigest()) for c, _, t in rows}
    assert {x.c: x.collection for x in kernels.with_collection(df, "c").collect()} == plain
    for x in kernels.with_fragments(df, (5, 20), *keys).collect():
        toks = rows[x.c][2]
        for w in (5.0, 20.0):
            own = [f for f in x.frags if f.w == w]
            assert [f.idx for f in own] == list(range(len(own)))
            assert [t for f in own for t in toks[f.start : f.end]] == toks
            assert all(f.hash == hashlib.md5(" ".join(toks[f.start : f.end]).encode()).hexdigest() for f in own)
    for x in kernels.with_terms(df, *keys).collect():
        toks = rows[x.c][2]
        assert {t.term: t.positions for t in x.terms} == {w: [i for i, t in enumerate(toks) if t == w] for w in set(toks)} and len(x.terms) == len(set(toks))
    assert kernels.with_fragments(df.limit(0), (5,), *keys).count() == 0


def test_frequencies_count_all_versions(spark):
    r = random.Random(8)
    rows = [(c, v, [r.choice("ab") for _ in range(r.choice([0, 5, 11, 40]))]) for c in range(6) for v in range(1 if c < 3 else 4)]
    df = spark.createDataFrame(rows, "c long, v long, toks array<string>")
    grams = features.ngrams(corpus.tokens(df, "c", "v"), "c", "v").collect()
    count = collections.Counter((g.c, g.h) for g in grams)
    want = {(g.c, g.v, g.pos): count[g.c, g.h] for g in grams}
    got = features.frequency_rows(df, "c", "v").collect()
    assert {(x.c, x.v, x.pos): x.freq for x in got} == want
    assert all(x["diff"] == want.get((x.c, x.v, x.pos + 1), x.freq) - x.freq for x in got)


def test_numbers_in_variable_length(spark, tmp_path):
    r = random.Random(9)
    x = np.array([0, 1, 127, 128, 140, 1231311237, (1 << 62) + 5, *(r.randrange(1 << r.randint(1, 62)) for _ in range(300))], np.int64)
    code, size = sinks.pack_numbers(x)
    assert sinks.unpack_numbers(code).tolist() == x.tolist() and code[size[:4].sum() :][:2].tolist() == [140, 1]
    assert sinks.unpack_numbers(sinks.pack_numbers(x[:0])[0]).tolist() == []
    rows = [(f, 3, r.randrange(1 << 40), r.randrange(9000)) for f in range(40) for _ in range(r.randint(1, 6))]
    df = spark.createDataFrame(sorted(set(rows)), "frag_id long, len long, version long, offset long")
    sinks.write_metadata_varbyte(df, str(tmp_path / "m"))
    assert sorted(map(tuple, sinks.read_metadata_varbyte(spark, str(tmp_path / "m")).collect())) == sorted(set(rows))


def test_prefix_sums(spark):
    r = random.Random(10)
    rows = [(f"{r.randrange(1 << 32):08x}", r.randint(1, 9)) for _ in range(300)]
    df = spark.createDataFrame(sorted(set(rows)), "k string, n long")
    got = {x.k: x.base for x in versioned.prefix_sums(df, "k", "n", F.substring("k", 1, 1), F.substring("k", 1, 2)).collect()}
    at, want = 0, {}
    for k, n in sorted(set(rows)):
        want[k] = at
        at += n
    assert got == want


def test_folded_versions_have_the_same_cover(spark):
    r = random.Random(11)
    texts = [[r.choice("ab") for _ in range(r.randint(1, 60))] for _ in range(4)]
    rows = [(c, v, r.choice(texts)) for c in range(5) for v in range(7)]
    df = spark.createDataFrame(rows, "collection long, version long, toks array<string>")

    def cut(arrays):
        both = kernels.with_fragments(arrays, (3, 9), "collection", "version").select("collection", "version", F.explode("frags").alias("f")).select("collection", "version", "f.*")
        return both.withColumn("len", F.col("end") - F.col("start"))

    folded, members = fragments.fold(df)
    assert folded.groupBy("collection").count().agg(F.max("count")).first()[0] <= 4
    for w in (0.1, 3.0):
        whole = fragments.select_covers(cut(df), [w])
        parts = fragments.unfold(fragments.select_covers(cut(folded), [w], copies=folded), members)
        assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.select(parts.columns).collect()))


def test_jump_cut_fixed_values():
    freq = [4] * 12 + [1] * 10 + [4] * 9
    assert segments.jump_boundaries(freq, [0] * 31, 40, threshold=1) == [0, 21]


def test_level_merge_fixed_values(spark):
    df = spark.createDataFrame([(1, i, i, i + 1) for i in range(9)], "d long, idx int, start int, end int")
    got = lambda x: sorted((r.start, r.end) for r in x.collect())
    assert got(segments.merge_level(df, False, "d")) == [(i, i + 2) for i in range(8)]
    assert got(segments.merge_level(df, True, "d")) == [(0, 3), (2, 5), (4, 7), (6, 9)]
    assert got(segments.merge_level(df.where("idx < 2"), True, "d")) == []


def test_varbyte(spark):
    numbers = [0, 1, 127, 128, 140, 1231311237, 2**28, 2**40 + 5]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    for high in (True, False):
        rows = df.select("n", H.varbyte_encode(F.col("n"), high).alias("c")).withColumn("back", H.varbyte_decode(F.col("c"), high)).collect()
        assert all(r.back == r.n for r in rows)
    code = {r.n: r.c for r in df.select("n", H.varbyte_encode(F.col("n")).alias("c")).collect()}
    assert code[140] == [140, 1] and code[1231311237] == [133, 163, 145, 203, 4]
    bits = spark.createDataFrame([([1, 0, 31],)], "v array<long>").select(H.write_bits(F.col("v"), 5).alias("b")).withColumn("v", H.read_bits(F.col("b"), 5)).first()
    assert bits.b == "000010000011111" and bits.v == [1, 0, 31]


def test_cover_is_exact_and_greedy():
    r = random.Random(2)
    for _ in range(150):
        frags, versions = {}, {}
        for v in range(r.randint(1, 4)):
            text = "".join(r.choice("ab") for _ in range(r.randint(1, 14)))
            cuts = sorted({0, len(text), *(r.randrange(len(text) + 1) for _ in range(4))})
            base = list(zip(cuts, cuts[1:], strict=False))
            versions[v] = len(text)
            for a, b in base + [(base[i][0], base[i + 1][1]) for i in range(len(base) - 1)]:
                f = text[a:b]
                frags.setdefault(f, (b - a, []))
                if (v, a) not in frags[f][1]:
                    frags[f][1].append((v, a))
        got = fragments.cover(frags, r.choice([0.01, 1.0, 10.0]))
        for v, n in versions.items():
            held = sorted((o, k) for _, _, w, o, k in got if w == v)
            at = 0
            for o, k in held:
                assert o == at
                at += k
            assert at == n


def test_scores(spark):
    df = spark.createDataFrame([(4.0, 3.0, 1.0)], "n double, s double, w double")
    r = df.select(fragments.score(F.col("n"), F.col("s"), F.col("w")).alias("a"), fragments.grammar_score(F.col("n"), F.col("s"), F.col("w")).alias("b")).first()
    assert round(r.a, 6) == 1.333333 and round(r.b, 6) == 2.4


def test_frontier_fixed_values(spark):
    rows = [("d", float(k), a, 1, p) for k, (a, p) in enumerate([(1, 10), (2, 10), (3, 7), (3, 9), (5, 7), (6, 2)])]
    df = spark.createDataFrame(rows, "collection string, w double, n_apps long, n_frags long, n_postings long")
    assert sorted((r.n_apps, r.n_postings) for r in optimise.frontier(df).collect()) == [(1, 10), (3, 7), (6, 2)]


def plain_budget(points, budget, jumps):
    """The greedy choice, all steps looked at anew each time; a document whose step doesn't fit stops, a jump that doesn't fit is out."""
    points = {d: sorted(p) for d, p in points.items()}
    at, left, out = dict.fromkeys(points, 0), budget - sum(p[0][0] for p in points.values()), set()
    while True:
        can = []
        for d, p in points.items():
            for k in range(at[d] + 1, len(p) if jumps else min(at[d] + 2, len(p))):
                if (d, at[d], k) not in out and (jumps or d not in out):
                    can.append((-(p[at[d]][1] - p[k][1]) / (p[k][0] - p[at[d]][0]), d, k))
        if not can:
            return {d: points[d][k] for d, k in at.items()}
        _, d, k = min(can)
        extra = points[d][k][0] - points[d][at[d]][0]
        if extra <= left:
            left -= extra
            at[d] = k
        else:
            out.add((d, at[d], k) if jumps else d)


def frontier_of(r):
    apps, post, out = r.randint(1, 4), r.randint(60, 120), []
    for k in range(r.randint(1, 6)):
        out.append((apps, post, float(k)))
        apps, post = apps + r.randint(1, 4), post - r.randint(1, 12)
    return out


def test_budgets_against_plain():
    r = random.Random(12)
    for _ in range(150):
        points = {f"d{k}": frontier_of(r) for k in range(r.randint(1, 6))}
        least = sum(min(p)[0] for p in points.values())
        for budget in range(least, least + 25, r.randint(1, 5)):
            assert optimise.spend_marginal(points, budget) == plain_budget(points, budget, False)
            assert optimise.spend_pairs(points, budget) == plain_budget(points, budget, True)
        with pytest.raises(ValueError):
            optimise.spend_marginal(points, least - 1)


def budget_rows(spark, points):
    return spark.createDataFrame([(d, w, a, 1, p) for d, ps in points.items() for a, p, w in ps], "collection string, w double, n_apps long, n_frags long, n_postings long")


def test_every_budget(spark):
    points = {"a": [(1, 100, 1.0), (2, 50, 2.0), (5, 20, 3.0)], "b": [(1, 80, 1.0), (3, 70, 2.0)], "c": [(2, 9, 1.0)]}
    df = budget_rows(spark, points).cache()
    with pytest.raises(ValueError):
        optimise.spend(df, 3)
    for budget in range(4, 21):
        for jumps, plain in ((False, optimise.spend_marginal), (True, optimise.spend_pairs)):
            got = {x.collection: x.w for x in optimise.spend(df, budget, jumps=jumps).collect()}
            assert got == {d: p[2] for d, p in plain(points, budget).items()}
    assert optimise.spend(df.limit(0), 5).count() == 0


def test_budget_rounds_over_tables(spark):
    """Many documents, small and large budgets."""
    r = random.Random(13)
    for k in range(4):
        points = {f"d{i}": frontier_of(r) for i in range(30)}
        least = sum(min(p)[0] for p in points.values())
        budget = least + (3, 25, 90, 500)[k]
        for jumps, plain in ((False, optimise.spend_marginal), (True, optimise.spend_pairs)):
            got = {x.collection: x.w for x in optimise.spend(budget_rows(spark, points), budget, jumps=jumps).collect()}
            assert got == {d: p[2] for d, p in plain(points, budget).items()}


def test_repair_blocks_cover_the_text():
    r = random.Random(3)
    for _ in range(100):
        toks = [r.choice("abc") for _ in range(r.randint(0, 40))]
        for down in (0, 1, 3):
            at = 0
            for a, b in grammar.repair_blocks(toks, down):
                assert a == at < b
                at = b
            assert at == len(toks)
    assert grammar.repair_blocks(list("abab"), 0) == [(0, 2), (2, 4)]


def tokens_of(x):
    return sum(map(tokens_of, x)) if isinstance(x, tuple) else 1


def called(x):
    return grammar.pair_name(*map(called, x)) if isinstance(x, tuple) else grammar.token_name(x)


def plain_repair(versions):
    """RePair the slow way: counts all pairs anew for each symbol; the final sequences as nested pairs."""
    seqs = [list(v) for v in versions]
    while True:
        count = {}
        for seq in seqs:
            last = {}
            for i, pair in enumerate(zip(seq, seq[1:])):
                if last.get(pair) != i - 1:
                    count[pair] = count.get(pair, 0) + 1
                    last[pair] = i
        best = min(count, key=lambda p: (-count[p], tokens_of(p), called(p)), default=None)
        if best is None or count[best] < 2:
            return seqs
        for k, seq in enumerate(seqs):
            out, i = [], 0
            while i < len(seq):
                take = tuple(seq[i : i + 2]) == best
                out.append(best if take else seq[i])
                i += 1 + take
            seqs[k] = out


def test_repair_grammar_spans_all_versions(spark):
    def levels(seq, down):
        size = lambda x: sum(map(size, x)) if isinstance(x, tuple) else 1
        at, level, out = 0, [], []
        for x in seq:
            level.append((x, at))
            at += size(x)
        for k in range(down + 1):
            out += [(k, p, p + size(x)) for x, p in level]
            level = [c for x, p in level if isinstance(x, tuple) for c in ((x[0], p), (x[1], p + size(x[0])))]
        return out

    r = random.Random(4)
    for _ in range(300):
        versions = [[r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 30))] for _ in range(r.randint(1, 4))]
        for down in (0, 1, 8):
            assert grammar.repair_nodes(versions, down) == [levels(seq, down) for seq in plain_repair(versions)]
    # a run that occurs once per version is one symbol of the collection's grammar
    run = [f"w{i}" for i in range(12)]
    df = spark.createDataFrame([(1, 0, ["a", *run, "b"]), (1, 1, ["c", *run, "d", "e"]), (2, 0, run)], "collection long, version long, toks array<string>")
    got = {(x.collection, x.version, x.start, x.end) for x in grammar.repair_cut(df, 8).collect() if x.level == 0}
    assert {(1, 0, 1, 13), (1, 1, 1, 13)} <= got and (2, 0, 0, 1) in got
    covers = fragments.select_covers(fragments.cut_tokens(grammar.repair_cut(df, 8), df, "collection", "version"), [1.0], grammar=True)
    assert fragments.coverage_faults(covers, df).count() == 0
    assert sorted((x.version, x.offset) for x in covers.where("collection = 1 and len = 12").collect()) == [(0, 1), (1, 1)]


def test_catalog_and_parameter_files(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tx\t5\n2\ty\n7\tz\t9\textra\nbad\tq\t1\n")
    assert sorted(map(tuple, corpus.read_catalog_tsv(spark, str(tmp_path / "c.tsv")).collect())) == [(1, 5), (7, 9)]
    (tmp_path / "options").write_text("0.01 0.05\n\n10\n")
    assert sorted(r.w for r in corpus.read_doubles(spark, str(tmp_path / "options")).collect()) == [0.01, 0.05, 10.0]
