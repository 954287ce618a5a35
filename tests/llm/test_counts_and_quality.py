"""op8 and op6 against plain versions."""

import math
import random
import re
from collections import Counter as Tally
from collections import defaultdict

import numpy as np

from palimpsest.llm import quality as Q
from palimpsest.llm import token_counts as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = {p: -math.log(i + 2) for i, p in enumerate(["▁", "▁a", "b", "ab", "▁ab", "a", "c", "bc", "abc", "é", "éa", "▁é", "cc", "ca"])}


def plain_count(word):
    s = "▁" + word
    best = [(0.0, 0)] + [None] * len(s)
    for e in range(1, len(s) + 1):
        n = len(s[e - 1].encode())
        opts = [(best[e - 1][0] + n * K.BYTE_SCORE, best[e - 1][1] + n)]
        opts += [(best[b][0] + PIECES[s[b:e]], best[b][1] + 1) for b in range(e) if s[b:e] in PIECES]
        best[e] = max(opts, key=lambda o: (o[0], -o[1]))
    return best[-1][1]


def test_counts_against_plain(spark, monkeypatch):
    r = random.Random(1)
    text = lambda: "".join(r.choice("aaabbccéx \n") for _ in range(r.randint(0, 400)))
    rows = [(i, text()) for i in range(60)] + [(100, None), (101, ""), (102, "a" * 3000), (None, "ab ab"), (100, "zz")]
    monkeypatch.setattr(K, "CACHE_WORDS", 200)
    counter, got = K.Counter(PIECES), []
    import pyarrow as pa

    from palimpsest.llm import _text as T

    for lo, hi, buf, offs in T.blocks(None, pa.array([t for _, t in rows]), 700):
        n, tokens = counter.block(buf, offs)
        got += zip(n.tolist(), tokens.tolist(), strict=True)
    want = [(len(w := WORD.findall(t or "")), sum(map(plain_count, w))) for _, t in rows]
    assert got == want


def test_counts_query(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, "the house", 5), (None, None, 6), (2, "", 7), (1, "the house", 5), (3, "the house " * 20_000, 0)], "doc_id long, text string, n_words int")
    got = sorted(map(tuple, K.token_counts(df, public_tokenizers.path("piece_bpe_32k.model")).collect()), key=repr)
    assert got == [(1, 2, 2, 9), (1, 2, 2, 9), (2, 0, 0, 0), (3, 40_000, 40_000, 200_000), (None, 0, 0, 0)]
    assert K.token_counts(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def plain_model(texts):
    """Modified Kneser-Ney over bytes, the slow way: a function (history, byte) -> probability."""
    n = Q.ORDER
    pad = bytes([Q.START]) * (n - 1)
    counts = [Tally()]
    for t in texts:
        b = pad + t
        counts[0].update(b[i - n + 1 : i + 1] for i in range(n - 1, len(b)))
    for _ in range(n - 1):
        counts.append(Tally(g[1:] for g in counts[-1]))
    levels = []
    for c in counts:
        cc = Tally(v for v in c.values() if v <= 4)
        y = cc[1] / (cc[1] + 2 * cc[2])
        d = [1 - 2 * y * cc[2] / cc[1], 2 - 3 * y * cc[3] / cc[2] if cc[2] else 1.0, 3 - 4 * y * cc[4] / cc[3] if cc[3] else 1.0]
        d = [min(max(x, 0), k + 1) for k, x in enumerate(d)]
        total, free = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            free[g[:-1]] += d[min(v, 3) - 1]
        levels.append((c, d, total, free))

    def p(gram, level=0):
        if level == n:
            return 1 / 256
        c, d, total, free = levels[level]
        low = p(gram[1:], level + 1)
        h = gram[:-1]
        if h not in total:
            return low
        v = c.get(gram, 0)
        return (max(v - d[min(v, 3) - 1], 0) if v else 0) / total[h] + free[h] / total[h] * low

    return p


def test_perplexity_against_plain(spark):
    r = random.Random(4)
    text = lambda: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 60)))
    rows = [(i, text() if i % 7 else " x\n\t y  z ", "en") for i in range(50)] + [(60, None, "en"), (61, "", None), (None, "abc", "de"), (62, "!!" * 50, "en")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, n_bytes int")
    trusted = spark.createDataFrame([(i,) for i in range(0, 50, 2)] + [(None,), (999,), (0,)], "doc_id long")
    clean = lambda t: re.sub(rb"[\x20\x09-\x0D]+", b" ", (t or "").encode())
    p = plain_model([clean(t) for i, t, _ in rows if i is not None and i < 50 and i % 2 == 0])
    pad = bytes([Q.START]) * (Q.ORDER - 1)
    assert abs(sum(p(b"ab ac"[:4] + bytes([x])) for x in range(256)) - 1) < 1e-9
    got = {x.doc_id: x for x in Q.perplexities(docs, trusted).collect()}
    for i, t, _ in rows:
        b = clean(t)
        assert got[i].n_bytes == len(b)
        if not b:
            assert got[i].perplexity is None
            continue
        s = pad + b
        nll = -sum(math.log(p(s[k - Q.ORDER + 1 : k + 1])) for k in range(Q.ORDER - 1, len(s))) / len(b)
        assert math.isclose(got[i].perplexity, math.exp(nll), rel_tol=1e-4)
    kept = {x.doc_id: x.keep for x in Q.classify(docs, trusted).collect()}
    assert len(kept) == len(rows) and not kept[60] and not kept[62] and not kept[61]
    assert sum(kept[i] for i in range(0, 50, 2)) >= 22
    assert Q.classify(docs.limit(0), trusted).count() == 0
    free = {x.doc_id: x.keep for x in Q.classify(docs, trusted.limit(0)).collect()}
    assert free[62] and not free[60]


def test_frames_change_nothing(spark, monkeypatch):
    from palimpsest.llm import _chunks

    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choice("abcde") for _ in range(3)) for _ in range(20))) for i in range(80)]
    docs, trusted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    want = sorted(map(tuple, Q.perplexities(docs, trusted).collect()))
    monkeypatch.setattr(_chunks, "FAN", 3)
    assert sorted(map(tuple, Q.perplexities(docs, trusted).collect())) == want


def test_threshold_is_the_quantile(spark):
    r = random.Random(8)
    rows = [(i, " ".join("".join(r.choice("abcde") for _ in range(3)) for _ in range(30)), "en") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in Q.classify(docs, docs.select("doc_id")).collect()}
    limits = {x.threshold for x in got.values()}
    assert len(limits) == 1
    # with a quantile of 0.99 and some 30 held out, the threshold is the largest of their perplexities
    assert limits <= {x.perplexity for x in got.values()}
    assert all(x.keep == (x.perplexity <= x.threshold) for x in got.values())


def test_each_language_has_its_own_quantile(spark):
    r = random.Random(9)
    langs = [("en", "abcde"), ("de", "abcdefghijklmnop"), ("fr", "xyz"), (None, "qrst")]
    rows = [(i, " ".join("".join(r.choice(a) for _ in range(4)) for _ in range(r.randint(5, 40))), lang) for i in range(160) for lang, a in [langs[i % 4 if i > 3 else 0]]] + [(900, "xyzzy " * 9, "es"), (901, None, "en"), (902, "", None), (903, "ab cd " * 3000, "en"), (5, "again", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = docs.where("doc_id < 160").select("doc_id")
    held = {x.doc_id for x in docs.where("pmod(xxhash64(doc_id, 6), 4) = 0 and doc_id < 160").collect()}
    for q in (0.5, 0.99):
        got = Q.classify(docs, trusted, q).collect()
        assert len(got) == len(rows)
        per = {}
        for x in got:
            if x.doc_id in held and x.perplexity is not None:
                per.setdefault(x.lang, []).append(x.perplexity)
        every = sorted(p for v in per.values() for p in v)
        for x in got:
            own = sorted(per.get(x.lang, every))
            assert x.threshold == own[math.ceil(q * len(own)) - 1]
            assert x.keep == (x.perplexity is not None and x.perplexity <= x.threshold)


def test_keys_hold_the_bytes_before():
    buf = np.frombuffer(b"ab  \ncd", np.uint8)
    key, at = Q.grams(buf, np.array([0, 5, 5, 7]))
    assert at.tolist() == [0, 3, 3, 5]
    as_bytes = [int(k).to_bytes(5, "big") for k in key]
    assert as_bytes == [b"\2\2\2\2a", b"\2\2\2ab", b"\2\2ab ", b"\2\2\2\2c", b"\2\2\2cd"]
