"""op13 against a plain alignment of whole texts."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from palimpsest.llm import token_alignment as K

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def ends(tokens):
    out, at = [], 0
    for _, raw in tokens:
        at += len(raw)
        out.append(at)
    return out


def plain(rows):
    """Whole texts, one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    out, held = [], Counter()
    for i, text in rows:
        xs = [(k, bytes(letter[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        ys = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)] if text else []
        raw = (" " + text).encode() if text else b""
        if not text or b"".join(x[1] for x in xs) != raw or b"".join(y[1] for y in ys) != raw:
            out.append((i, 0, 0, 0, [], ""))
            continue
        ea, eb, groups, p, q = ends(xs), ends(ys), [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            n, m = ea.index(cut, p) + 1, eb.index(cut, q) + 1
            groups.append(([x[0] for x in xs[p:n]], [y[0] for y in ys[q:m]]))
            p, q = n, m
        links = [(u, v) for g in groups for u in g[0] for v in g[1]]
        held.update(set(links))
        text = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        out.append((i, len(xs), len(ys), len(groups), links, hashlib.sha256(text.encode()).hexdigest()))
    top = Counter()
    for (u, _), n in held.items():
        top[u] = max(top[u], n)
    return sorted(((i, n, m, g, len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), h) for i, n, m, g, links, h in out), key=repr)


ODD = [
    (1, "a  b\n c"), (2, " lead"), (3, "tail "), (4, "  "), (5, "x<|endoftext|>y <s> </s> <0x41>"), (6, "▁ mark"), (7, None), (8, ""), (9, "é  ñ b 　c"), (10, "a\tb \t c\x1c d\x85 e"),
    (11, "😀 👩‍👩‍👧 \x00 z"), (12, "ab" * 3000), (13, "a b"), (13, "a b"), (None, "don't we'll it's 'tis x'"), (14, "word.) (see) ###token$$$ 123abc Ünïcode! naïve..."), (15, "한국어 中文 ไทย mixed 12 ٣"),
]


def test_odd_rows(spark):
    """Special strings, white space of all kinds, marks, nulls, empty and long texts, repeated rows, clashing names."""
    df = spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, pair int").withColumnRenamed("pair", "block")
    assert sorted(map(tuple, K.align(df, A, B).collect()), key=repr) == plain(ODD)
    assert K.align(df.limit(0), A, B).count() == 0


def test_random_texts_in_small_blocks(spark, monkeypatch):
    """Counts over several blocks; a cache that overflows."""
    r = random.Random(8)
    words = ["the", "house", "Naïve", "x.y", "12", "foo-bar", "l'eau", "\n", "", "ﬁ", "été,", "don't", "\t", "straße", "##"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(80)]
    rows += [(i + 100, t) for i, t in rows[:20]]
    monkeypatch.setattr(K, "BLOCK", 600)
    monkeypatch.setattr(K, "CACHE_UNITS", 10)
    K.Aligner._held.clear()
    assert sorted(map(tuple, K.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), A, B).collect()), key=repr) == plain(rows)


def test_whole_texts_where_units_are_unsafe():
    aligner = K.Aligner(A, B)
    text = "some text. With 3 words’ worth, é"
    by_unit = aligner.block([text])
    aligner.by_unit = False
    aligner.forget()
    whole = aligner.block([text])
    assert whole[0].tolist() == by_unit[0].tolist() and whole[1] == by_unit[1] and whole[2].tolist() == by_unit[2].tolist()


def test_shared_cuts_of_random_ends():
    r = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 500):
        a, b = (np.unique(np.append(r.integers(1, n + 1, n // 2), n)) for _ in range(2))
        cuts, up_a, up_b = K.shared_cuts(a, b, n)
        assert cuts.tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        assert up_a.tolist() == [int((a <= c).sum()) for c in cuts] and up_b.tolist() == [int((b <= c).sum()) for c in cuts]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query(spark):
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, K.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()), key=repr) == plain(rows)
