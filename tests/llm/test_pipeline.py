"""run() against a brute-force version of every stage."""

import random
import re
import zlib

import public_tokenizers
from test_near_dedup import brute as near_groups
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import toxicity


def fixture():
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [text(30) for _ in range(5)]
    docs, toxic = [], {}
    for i in range(260):
        t = text(r.randint(1, 90))
        if i % 8 == 0:
            t += " scum moron " * 3
            toxic[i] = 1
        elif i % 13 == 0:
            t += " " + items[i % 5] + " " + text(3)
        elif i % 7 == 0 and docs:
            t = re.sub(" ", "  \n", docs[i - 3][1])
        elif i % 9 == 0:
            w = docs[i - 2][1].split()
            t = " ".join([*w, "extra"])
        docs.append((i, t))
        toxic.setdefault(i, 0)
    docs += [(900, None), (901, ""), (902, "")]
    return docs, toxic, items


def test_run_against_brute_force(spark, tmp_path):
    docs, toxic, items = fixture()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, v) for i, v in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # toxicity: planted words decide; the model has to agree with the labels, copies of toxic texts included
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    index = toxicity.fit(table, spark.read.parquet(str(tmp_path / "labels.parquet")))
    scores = {x.doc_id: x.score for x in toxicity.score_documents(table, index).collect()}
    left = [(i, t) for i, t in docs if "scum" not in (t or "")]
    assert {i for i, _ in left} == {i for i, s in scores.items() if s < 0.3}
    first = {}
    for i, t in left:
        first.setdefault(re.sub("[ \t-\r]+", " ", t or ""), i)
    left = [(i, t) for i, t in left if i in set(first.values())]
    kept = {d for d, _, _, k in near_groups(left, 5, 80) if k}
    left = [(i, t) for i, t in left if i in kept]
    norm = lambda t: " ".join((t or "").split())
    left = [(i, t) for i, t in left if not any(norm(x) in norm(t) for x in items)]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for x in rows:
        pieces.setdefault(x.doc_id, []).append(x)
    assert set(pieces) == {i for i, _ in left}
    for i, t in left:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for x in sorted(pieces[i], key=lambda x: x.start):
            assert x.start == at and x.ids_crc32 == zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids[at : at + x.length]))
            at += x.length
        assert at == len(ids) == pieces[i][0].doc_tokens


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Null ids and texts, repeated ids and rows, a very long text, columns that clash, and tables without rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [(1, "one plain text", "en", "s"), (1, "one plain text", "en", "s"), (1, "the same id with other words", None, None), (None, "a null id", "en", "s"), (None, None, "en", "s"), (2, "", "en", "s"), (3, long, "en", "s"), (4, "one  plain\ntext", "en", "s")]
    for name, docs in (("odd", rows), ("none", [])):
        top = tmp_path / name
        spark.createDataFrame([(*r, 0, "k", "z") for r in docs], schema).write.parquet(str(top / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (77, 0, 1)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
        spark.createDataFrame([(1, None), (2, "")] if docs else [], "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
        got = {(x.doc_id, x.doc_tokens) for x in corpus_pipeline.run(spark, str(top)).collect()}
        tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
        want = {(1, size("one plain text")), (1, size("the same id with other words")), (None, size("a null id")), (2, 1), (3, size(long))}
        assert got == (want if docs else set())
