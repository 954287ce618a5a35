"""Words that polynomial hashes can't tell apart, columns named as the operators' own, rows that repeat."""

import numpy as np
import pyarrow as pa
import public_tokenizers

from palimpsest.llm import _chunks as C
from palimpsest.llm import _text as T
from palimpsest.llm import exact_dedup as E
from palimpsest.llm import near_dedup as N
from palimpsest.llm import packing as P
from palimpsest.llm import substring_dedup as S
from palimpsest.llm import token_counts as K


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


def test_patterned_words_are_told_apart(spark):
    """A Thue-Morse word and its complement collide in every polynomial mod 2**64 with an odd base."""
    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    for _, _, buf, offs in T.blocks(None, pa.array([one, two, one])):
        h = T.Words(buf, offs).hash
        assert h[0] == h[2] != h[1]
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in P.pack(df, path, keep_ids=True, tiers=(1 << 13,)).collect() if r["length"] == r["doc_tokens"]}
    whole = {1: one, 2: two}
    assert all(v == [*plain.encode(whole[k], add_special_tokens=False).ids, 2] for k, v in ids.items())
    counter = K.Counter({"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, "abb": -2.6})
    for _, _, buf, offs in T.blocks(None, pa.array([one, two])):
        assert counter.block(buf, offs)[1].tolist() == counter.terminals([K.MARK + one]) + counter.terminals([K.MARK + two])
    assert {r["kept"] for r in N.near_duplicates(df, shingle=3, percent=85).collect()} == {True}
    runs = spark.createDataFrame([(1, " ".join([one] * 25)), (2, " ".join([two] * 25))], "doc_id long, text string")
    assert [r["n_removed"] for r in S.substring_dedup(runs).orderBy("doc_id").collect()] == [24, 24]  # each repeats itself only


def test_seeds_and_runs():
    k = T.keys(10)
    assert len(set(k[:10].tolist())) == 10 and (T.keys(5000)[:10] == k[:10]).all()
    h = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    runs = T.run_hash(h, 3)
    assert runs[0] == runs[3] and len(set(runs.tolist())) == 3 and len(T.run_hash(h, 7)) == 0
    assert T.run_hash(h[:2], 2)[0] not in set(T.run_hash(h, 3).tolist())


def test_drop_functions_keep_columns_of_any_name(spark):
    """Columns named as the operators' own, and one with a dot."""
    names = ["_row", "_digest", "_gone", "_maybe", "_doc", "_id", "_hot", "_key", "_part", "_bit", "node", "key", "a.b"]
    text = "one two three four five six seven"
    rows = [(1, text), (2, text), (3, "x"), (None, "y")]
    df = spark.createDataFrame([(*r, *[k] * len(names)) for k, r in enumerate(rows)], ["doc_id", "text", *names])
    for drop in (E.drop_exact_duplicates, N.drop_near_duplicates):
        kept = drop(df)
        assert kept.columns == df.columns
        assert sorted((tuple(r)[:3] for r in kept.collect()), key=repr) == [(1, text, 0), (3, "x", 2), (None, "y", 3)]


def test_exact_drop_of_winners_and_others(spark):
    """Frequent copies, rare ones, null ids and rows that repeat both, with and without winners."""
    rows = [(i, f"t{i % 7}" if i % 3 else "hot", i) for i in range(200)] + [(None, "hot", 1), (None, "lone", 2), (None, "lone", 3), (0, "hot", 4), (5, None, 5), (6, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int").repartition(5)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((r for r in rows if r[0] == least[r[1] or ""]), key=repr)
    for kw in ({}, {"min_copies": 2}, {"min_copies": 2, "max_winners": 1}):
        assert sorted((tuple(r) for r in E.drop_exact_duplicates(df, **kw).collect()), key=repr) == want


def test_repeated_rows_are_dealt_to_several_chunks(spark):
    """A third of the rows with a null id, the same id, or all the same: no chunk holds more than its share."""
    rows = [(i, f"text {i}") for i in range(1000)]
    chunk_rows = lambda df, **kw: [r["n"] for r in C.packed(df, "doc_id", "text", 16, **kw).groupBy("chunk").sum("n").withColumnRenamed("sum(n)", "n").collect()]
    for extra in ([(7, "same")] * 1000, [(None, "same")] * 1000, [(None, f"own {i}") for i in range(1000)], [(9, f"own {i}") for i in range(1000)]):
        df = spark.createDataFrame(rows + extra, "doc_id long, text string").repartition(4)
        n = chunk_rows(df)
        assert sum(n) == 2000 and max(n) < 300
        if extra[0][0] is None:
            n = chunk_rows(df, by_id=True)
            assert sum(n) == 2000 and max(n) < 300
