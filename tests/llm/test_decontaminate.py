"""op4: alignment against a plain dynamic program, and planted copies."""

import random

import numpy as np

from palimpsest.llm import decontaminate as D


def plain(item, text):
    best, row = 0, [0] * (len(text) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(text, 1):
            new.append(max(0, row[j - 1] + (2 if a == b else -1), row[j] - 1, new[j - 1] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_equals_plain_dynamic_program():
    r = random.Random(3)
    for _ in range(300):
        a = [r.randrange(5) for _ in range(r.randint(1, 12))]
        b = [r.randrange(5) for _ in range(r.randint(1, 25))]
        score, first, last = D.smith_waterman(np.array(a), np.array(b))
        assert score == plain(a, b)
        if score:
            assert 0 <= first <= last < len(b)
            assert plain(a, b[first : last + 1]) == score


def test_planted_copies(spark):
    r = random.Random(5)
    vocab = ["the", "of", "and", "in"] * 40 + [f"wörd{i}" for i in range(3000)]
    names = [v.replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d").replace("4", "e").replace("5", "f").replace("6", "g").replace("7", "h").replace("8", "i").replace("9", "j") for v in vocab]
    words = lambda n: [r.choice(names) for _ in range(n)]
    items = [words(r.randint(16, 60)) for _ in range(30)]
    rows, want = [], set()
    for i in range(300):
        w = words(r.randint(0, 300))
        if i % 5 == 0:
            k = r.randrange(30)
            copy = list(items[k])
            for _ in range(len(copy) // 8 if i % 10 else 0):
                copy[r.randrange(len(copy))] = r.choice(names)
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in copy] if i % 15 == 0 else copy
            want.add((i, k))
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "  ,,  ")]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(98, None), (99, ",. -")], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    got = D.contaminated(docs, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    assert all(x.score == 1.0 for x in got if x.doc_id % 10 == 0)
    kept = {x.doc_id for x in D.drop_contaminated(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in want}
    assert D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.contaminated(docs.limit(0), bench).count() == 0


def test_edited_copies_of_a_frequent_item(spark):
    """A third of all rows hold the item, so each of its words is frequent; edits hit its first words."""
    r = random.Random(6)
    name = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    item = [f"item{name(k)}" for k in range(20)]
    rows, want = [], set()
    for i in range(300):
        w = [f"word{name(r.randrange(3000))}" for _ in range(60)]
        if i % 3 == 0:
            copy = list(item)
            if i % 2:
                copy[2:4] = ["edited", "here"]
            elif i % 4:
                copy = copy[5:]
            elif i % 12 == 0:
                copy[4::5] = ["changed"] * len(copy[4::5])
            at = r.randint(0, len(w))
            w[at:at] = copy
            want.add(i)
        rows.append((i, " ".join(w)))
    # an item of very frequent words, with an edit inside its rarest ones
    common = "the of and in to the of a in the and of to a the in and to of the".split()
    rows += [(1000 + i, " ".join(r.choice(common) for _ in range(8)) + f" x{name(i)}") for i in range(100)]
    rows.append((2000, "some words " + " ".join(common[:9] + ["other"] + common[10:]) + " and more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(common))], "item_id long, text string")
    got = D.contaminated(docs, bench).collect()
    assert {x.doc_id for x in got if x.item_id == 1} == want
    assert 2000 in {x.doc_id for x in got if x.item_id == 2}
    for x in got:
        text, own = dict(rows)[x.doc_id].split(), item if x.item_id == 1 else common
        assert x.score == round(plain(own, text) / (2 * len(own)), 6) >= 0.5
    kept = {x.doc_id for x in D.drop_contaminated(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {x.doc_id for x in got}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "nothing here at all")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(["alpha beta gamma delta epsilon", "beta gamma delta epsilon zeta", "x y z"])], "item_id long, text string")
    bench = bench.union(bench.where("item_id = 1"))
    want = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_ITEMS", 1)
    assert sorted(map(tuple, D.contaminated(docs, bench).collect())) == want
    assert len(want) == 2


def plain_tokens(text):
    """Tokens by the definition, one character at a time."""
    out, now = [], ""
    for c in (text or "").lower():
        p = ord(c)
        sign = not c.isalnum() if p < 128 else any(a <= p <= b for a, b in D._SIGNS)
        alone = not sign and any(a <= p <= b for a, b in D._UNSPACED)
        if sign or alone:
            out += [now] if now else []
            now = ""
            out += [c] if alone else []
        else:
            now += c
    return out + ([now] if now else [])


def test_tokens_against_plain():
    import pyarrow as pa

    from palimpsest.llm import _text as T

    r = random.Random(1)
    bits = ["a", "bc", "7", "17", " ", ",", "é", "ß", "—", "\u2019", "法", "国", "の", "ก", "ข", "한", "국", "。", "！", "𠀀", "😀", "×", "«", "\n", "-", "_", "ｱ", "Ω"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(400)]
    for _, _, buf, offs in T.blocks(None, pa.array([t.lower() for t in texts])):
        w = D.words_of(buf, offs)
        raw = buf.tobytes()
        for d, t in enumerate(texts):
            own = range(w.offs[d], w.offs[d + 1])
            assert [raw[w.start[k] : w.end[k]].decode() for k in own] == plain_tokens(t), t


def test_pairs_against_every_document_with_every_item(spark):
    """Brute force: every document against every item by the plain aligner over whole texts."""
    r = random.Random(12)
    vocab = [f"w{k}" for k in range(40)] + [str(k) for k in range(30)] + list("法国的首都是哪里巴黎東京")
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [words(r.randint(3, 14)) for _ in range(25)] + [words(80), words(120)]
    items += [["alpha", "beta"], ["gamma"], "what is 17 + 25 = 42 and 3 * 9 = 27".split(), list("法国的首都是哪里") + [" "] + list("巴黎"), ["eins", "zwei", "drei"]]
    texts = ["17 + 25 = 42 and 3 * 9 = 27", "法国的首都是哪里 巴黎", "法国的首都是哪里，巴黎！", "alpha beta", "alpha x beta", "say: GAMMA.", "what is 17 + 25 = 43 and 3 * 9 = 27", "", None, "eins zwei drei"]
    for _ in range(120):
        t = words(r.randint(0, 60))
        if r.random() < 0.6:
            copy = [w for w in r.choice(items) for w in ([w] if r.random() > 0.12 else [w, r.choice(vocab)] if r.random() < 0.5 else [r.choice(vocab)])]
            cut = r.randint(0, len(copy) // 3)
            at = r.randint(0, len(t))
            t[at:at] = copy[cut:]
        texts.append(r.choice([" ", ", ", "\n"]).join(t))
    texts.append(" ".join(words(9000) + items[3] + words(2000)))
    texts.append(" ".join(items[25][10:45]))  # a long passage of less than half an item
    rows = [(k, t, 5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], (None, texts[0], 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, " ".join(w), 1) for k, w in enumerate(items)] + [(900, None, 1), (901, "", 1), (902, "?!", 1), (3, " ".join(items[3]), 1), (None, "eins zwei drei", 1)], "item_id long, text string, doc_id int")
    want = {}
    for d, t, _ in rows:
        own = plain_tokens(t)
        for i, w in [*enumerate(items), (None, ["eins", "zwei", "drei"])]:
            item = plain_tokens(" ".join(w))
            grams = lambda x, n: {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            if len(item) < 3:
                if tuple(item) in grams(own, len(item)):
                    want[d, i] = 1.0
            elif grams(item, 3) & grams(own, 3):
                raw = plain(item, own)
                score = round(raw / (2 * len(item)), 6)
                if score >= 0.5 or raw >= 2 * D.PASSAGE:
                    want[d, i] = score
    got = D.contaminated(docs, bench).collect()
    assert len(got) == len(want) + 2 * sum(d == 0 for d, _ in want)
    assert {(x.doc_id, x.item_id): x.score for x in got if x.doc_id is not None} == want
    assert (len(texts) - 1, 25) in want and want[len(texts) - 1, 25] < 0.5
    assert {(0, 29), (1, 30), (2, 30), (3, 27), (5, 28), (6, 29), (9, 31), (9, None)} <= set(want) and (4, 27) not in want
    for x in got:
        if x.doc_id is not None:
            item = plain_tokens(" ".join(items[x.item_id] if x.item_id is not None else items[31]))
            assert round(plain(item, plain_tokens(texts[x.doc_id])[x.first_word : x.last_word + 1]) / (2 * len(item)), 6) == x.score
    kept = [x.doc_id for x in D.drop_contaminated(docs, bench).collect()]
    assert sorted(kept) == sorted({d for d, _, _ in rows} - {d for d, _ in want})
