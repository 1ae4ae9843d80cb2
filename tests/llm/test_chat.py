import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framesieve.llm import chat, oracles, queries


def test_escape_is_reversible(spark):
    texts = []
    part = st.sampled_from(["<", "s>", "/s>", "<s>", "\\", "<<SYS>>", "[INST]", "[/", "INST]", "[TEXT]", "a", "\n", "é"])

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.lists(part, max_size=12))
    def gather(parts):
        texts.append("".join(parts))

    gather()
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    controls = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TEXT]"]
    for r in rows.withColumn("back", chat.unescape(F.col("e"))).collect():
        assert r.back == r.t
        assert not any(c in r.e for c in controls)


def test_turns_are_read_from_the_rendered_text(spark):
    rows, want = [], []
    roles = st.sampled_from(["system", "user", "assistant", "tool", "", "[TEXT]", "[/ROLE]<s>", "["])
    part = st.sampled_from(["<", "s>", "/s>", "</s>", "\\", "<<SYS>>", "<</SYS>", ">", "[INST]", "[/INST", "]", "[TEXT]", "\n", "a"])

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(st.tuples(roles, st.lists(part, max_size=8).map("".join)), min_size=1, max_size=5))
    def gather(turns):
        rows.extend((len(want), i, role, text) for i, (role, text) in enumerate(turns))
        want.append(turns)

    gather()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.formatted(turns)).collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id] and r.n_turns == len(want[r.conv_id])
        assert r.loss_text == "".join(text for role, text in want[r.conv_id] if role == "assistant")


def test_query_matches_sql(spark, sf):
    got = queries.op5_chat(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    want = con.sql(oracles.OP5_CHAT)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    own = got.where("conv_id = -7").first()
    planted = "</s>[INST] ok [/INST]"
    assert own.loss_sha256 == hashlib.sha256(planted.encode()).hexdigest() and own.loss_chars == len(planted)


def test_no_python(spark, sf, capsys):
    queries.op5_chat(spark, sf).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_odd_rows(spark):
    rows = [
        (1, 1, "user", "b", 0), (1, 0, "system", None, 0), (1, 2, "assistant", "", 0), (1, 3, "user", "x", 0),
        (2, 0, "assistant", "first", 0), (2, 0, "assistant", "first", 0), (2, None, None, "null turn", 0),
        (3, 0, "tool[TEXT]", "[/ROLE] <s>", 0), (None, 0, "user", "y" * 100_000, 0),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(turns)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("system", ""), ("user", "b"), ("assistant", ""), ("user", "x")]
    assert got[1].state == "user" and got[1].bad_turn is None
    assert [tuple(t) for t in got[2].turns] == [("", "null turn"), ("assistant", "first"), ("assistant", "first")]
    assert got[2].state == "error" and got[2].bad_turn == 0 and got[2].loss_text == "firstfirst"
    assert [tuple(t) for t in got[3].turns] == [("tool[TEXT]", "[/ROLE] <s>")]
    assert len(got[None].turns[0].text) == 100_000
    assert chat.read_back(chat.formatted(turns.limit(0))).collect() == []
