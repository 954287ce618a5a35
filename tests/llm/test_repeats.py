"""op1 and op9 against brute force."""

import hashlib
import random
import re

import pytest

from palimpsest.llm.substring_dedup import substring_dedup
from palimpsest.llm.suffix_dedup import stack_scan, suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def key(i):
    return (i is None, i or 0)


def brute_bytes(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < key(i):
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, n=20):
    first = {}
    for k, (i, t) in enumerate(rows):
        w = WORD.findall((t or "").encode())
        for p in range(len(w) - n + 1):
            first.setdefault(tuple(w[p : p + n]), []).append((key(i), k, p))
    out = []
    for k, (i, t) in enumerate(rows):
        w = WORD.findall((t or "").encode())
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if any(o[0] < key(i) or (o[1] == k and o[2] < p) for o in first[tuple(w[p : p + n])]):
                gone[p : p + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=70):
    r = random.Random(seed)
    vocab = ["the", "of", "a", "é", "naïve", "x"] + ["w%d" % k for k in range(40)]
    text = lambda m: "".join(r.choice(vocab) + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(m))
    passages = [text(r.randint(10, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = "".join(r.choice([text(r.randint(1, 40)), r.choice(passages), r.choice(passages)[r.randint(0, 30) :]]) for _ in range(r.randint(0, 5)))
        rows.append((i * 3, t))
    rows += [(1000 + k, rows[k][1]) for k in range(10)] + [(1, rows[7][1]), (2000, None), (2001, ""), (2002, "a" * 400), (2003, "a" * 300), (2004, "ab " * 100), (2005, "ab " * 60 + "c"), (None, rows[4][1]), (2006, rows[4][1]), (2006, rows[4][1]), (2007, "w1 " * 5), (2008, text(9000)), (2009, "\x00" * 70), (2010, "q" + "\x00" * 64)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_both_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, chunk int, n_words string")
    got = sorted((tuple(x)[:5] for x in suffix_dedup(df).collect()), key=repr)
    assert got == brute_bytes(rows)
    got = sorted((tuple(x)[:4] for x in substring_dedup(df).collect()), key=repr)
    assert got == brute_words(rows)


@pytest.mark.parametrize(("hot", "fan"), [(1, 4096), (3, 5), (4000, 5)])
def test_hot_anchors_and_frames_change_nothing(spark, monkeypatch, hot, fan):
    from palimpsest.llm import _chunks, suffix_dedup as S

    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "HOT_ZEROS", 0)
    monkeypatch.setattr(_chunks, "FAN", fan)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x)[:5] for x in suffix_dedup(df).collect()), key=repr) == brute_bytes(rows)
    if fan < 4096:
        assert sorted((tuple(x)[:4] for x in substring_dedup(df).collect()), key=repr) == brute_words(rows)


def test_relay_holds_few_blobs(spark, monkeypatch):
    import pyarrow as pa

    from palimpsest.llm import _chunks

    monkeypatch.setattr(_chunks, "FAN", 16)

    def to_all(table):
        own = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array(range(40), pa.int32()), "blob": pa.array([b"%d %d" % (own, k) for k in range(40)])})

    senders = spark.range(40).selectExpr("cast(id as int) chunk").groupBy("chunk")
    rows, _ = _chunks.deal(senders, to_all, "bucket int, blob binary", "chunk", "bucket", 40)
    frames = [(r.bucket, pa.ipc.open_stream(r.frame).read_all().column("blob").to_pylist()) for r in rows.collect()]
    assert sorted(b for _, blobs in frames for b in blobs) == sorted(b"%d %d" % (a, k) for a in range(40) for k in range(40))
    assert all(b.endswith(b" %d" % k) for k, blobs in frames for b in blobs)
    # a relay has one frame for each of as many receivers as it has senders
    assert max(len(blobs) for _, blobs in frames) ** 2 <= 16


def plain_pieces(texts, length):
    """(anchor, document, start, windows) of every piece, by the definition."""
    import numpy as np

    from palimpsest.llm import _text as T, suffix_dedup as S

    out = []
    for d, b in enumerate(texts):
        buf = np.frombuffer(b, np.uint8)
        h = T.rolling_hash(T.prefix(T.BYTE_VALUES[buf]), S.SEED).tolist()
        least = [min(h[p : p + length - S.SEED + 1]) for p in range(len(b) - length + 1)]
        p = 0
        while p < len(least):
            q = p
            while q < len(least) and least[q] == least[p] and q - p < S.RUN:
                q += 1
            out.append((least[p], d, p, q - p))
            p = q
    return out


def test_groups_against_brute_force(spark):
    """Left-diverse, right-maximal strings among each anchor's pieces, with all their occurrences."""
    import collections

    from palimpsest.llm.suffix_dedup import repeat_groups

    rows = [r for r in corpus(4, 40) if r[0] is not None and r[0] not in (2006, 2008)]
    texts = [(t or "").encode() for _, t in rows]
    by_anchor = collections.defaultdict(list)
    for anchor, d, p, runs in plain_pieces(texts, 50):
        by_anchor[anchor].append((d, p, texts[d][p : p + runs + 49]))
    want = set()
    for pieces in by_anchor.values():
        if len({d for d, _, _ in pieces}) == 1:
            continue
        places = collections.defaultdict(list)
        for d, p, s in pieces:
            for a in range(len(s) - 49):
                for n in range(50, len(s) - a + 1):
                    places[s[a : a + n]].append((d, p, a, s))
        for s, found in places.items():
            if len(found) < 2:
                continue
            nxt = {x[3][x[2] + len(s) : x[2] + len(s) + 1] or (x[0], x[1]) for x in found}
            ends = any(not x[3][x[2] + len(s) : x[2] + len(s) + 1] for x in found)
            left = {x[3][x[2] - 1 : x[2]] if x[2] else None for x in found}
            if (len(nxt) > 1 or ends) and (len(left) > 1 or None in left):
                want |= {(s, d, p + a) for d, p, a, _ in found}
    got = repeat_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    number = {i: k for k, (i, _) in enumerate(rows)}
    strings = collections.defaultdict(set)
    have = set()
    for x in got:
        d = number[x.doc_id]
        s = texts[d][x.start : x.start + x.length]
        strings[x.grp, x.length].add(s)
        have.add((s, d, x.start))
    assert all(len(s) == 1 for s in strings.values())
    assert have == want
    assert repeat_groups(spark.createDataFrame(rows[:1], "doc_id long, text string")).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(df).count() == 0
    assert substring_dedup(df).count() == 0


def test_stack_scan_is_the_interval_tree():
    import numpy as np

    # suffixes with common prefixes 3, 5, 5, 2, 4
    got = list(stack_scan(np.array([0, 3, 5, 5, 2, 4]), 2))
    assert got == [(5, 1, 3), (3, 0, 3), (4, 4, 5), (2, 0, 5)]
