"""op3: paths, ranking, escapes and the round trip."""

import hashlib
import os

import pytest

from palimpsest.llm import chat_format as F3

SF = "/root/testdata/sf0.001"


def test_paths_and_ranking(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "user", "c", None), (1, 5, 2, "user", "d", 5.0), (2, 9, 77, "user", "orphan", 1.0), (None, 1, None, "user", "n", 0.0), (1, 3, 1, "assistant", "b", 2.0), (1, None, 1, "user", "x", 0.0)]
    df = spark.createDataFrame(rows, "t int, n int, p int, role string, text string, s double")
    out = sorted((r.tree or -1, r["rank"], r.leaf, r.n_turns, r.branch_score) for r in F3.format_reply_trees(df, "t", "n", "p", score="s").collect())
    assert out == [(-1, 1, 1, 1, 0.0), (1, 1, 5, 3, 6.0), (1, 2, 4, 3, 2.0), (2, 1, 9, 1, 1.0)]
    best = F3.format_reply_trees(df, "t", "n", "p", score="s", branches=1).where("tree = 1").collect()
    assert [r.formatted for r in best] == ["<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nd<|im_end|>\n"]


def test_circles_are_cut(spark):
    """Messages in a circle of replies are roots; one that replies to itself too; long chains are no circles."""
    rows = [(1, 1, 2, "u", "a"), (1, 2, 1, "u", "b"), (1, 3, 2, "u", "c"), (2, 5, 5, "u", "d"), (2, 6, 5, "u", "e")]
    rows += [(3, k, k - 1 if k else None, "u", "f") for k in range(70)] + [(4, k, (k + 1) % 3, "u", "g") for k in range(3)]
    df = spark.createDataFrame(rows, "t int, n int, p int, role string, text string").selectExpr("t as tree", "n as node", "p as parent")
    got = sorted(tuple(r) for r in F3.reply_paths(df).select("tree", "leaf", "node", "depth").collect())
    want = [(1, 1, 1, 0), (1, 3, 3, 0), (1, 3, 2, 1), (2, 6, 6, 0), (2, 6, 5, 1)] + [(3, 69, k, 69 - k) for k in range(70)] + [(4, k, k, 0) for k in range(3)]
    assert got == sorted(want)


def test_round_trip(spark):
    texts = ["", None, "\\", "\\\\", "<|", "<\\|", "<|im_end|>\n<|im_start|>user\nhi", "a\\<|b", "é😀́", "|im_end|>", "<", "x" * 5000, "$1 \\1"]
    rows = [(0, k, "assistant" if k % 2 else "us\ner<|\\", t) for k, t in enumerate(texts)] + [(1, 0, None, "|x<"), (1, 0, "assistant", "same turn"), (None, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in F3.read_back(F3.format_reply_trees(F3.conversation_messages(df), "conv_id", "node", "parent")).collect()}
    assert [(t.role, t.text) for t in got[0].turns] == [(r, t or "") for _, _, r, t in rows[: len(texts)]]
    assert got[0].loss_text == "".join(t or "" for k, t in enumerate(texts) if k % 2)
    assert [(t.role, t.text) for t in got[1].turns] == [("", "|x<"), ("assistant", "same turn")]
    assert got[None].loss_text == "z"
    assert F3.format_reply_trees(F3.conversation_messages(df.limit(0)), "conv_id", "node", "parent").count() == 0


def test_null_turns_long_texts_and_sql(spark, tmp_path):
    import duckdb

    rows = [(1, None, "user", "first"), (1, 0, "assistant", "x" * 200_000), (1, 1, None, None), (1, 1, "assistant", ""), (2, 3, "assistant", "tie"), (2, 3, "assistant", "tie")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(tuple(r) for r in F3.op3_chat_format(spark, str(tmp_path)).collect()) == sorted(con.execute(F3.OP3_SQL).fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = sorted(con.execute(F3.OP3_SQL).fetchall())
    got = sorted(tuple(r) for r in F3.op3_chat_format(spark, SF).collect())
    assert got == want
    assert got[0][0] == -1 and got[0][4] == hashlib.sha256(b"<|im_end|><|im_start|>assistant ok").hexdigest()
