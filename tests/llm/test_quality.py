import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framesieve.llm import oracles, quality, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics(spark):
    alphabet = st.sampled_from(["a", "b", "é", "#x", " ", "\n", "\t", " ", "a b c ", "\r\n"])
    texts = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(alphabet, max_size=40))
    def gather(parts):
        texts.append("".join(parts))

    gather()
    texts += [None, "", " ", "a b c", "a b c a b c", "x " * 30000, "\n\n a \n a \n a\nb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in quality.with_statistics(rows).collect()}
    assert got == {i: slow_base(t) for i, t in enumerate(texts)}


def test_no_python(spark, sf, capsys):
    queries.op1_quality(spark, sf).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_query_matches_sql(spark, sf, scale):
    sf = sf.replace("0.001", scale)
    got = queries.op1_quality(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.sql(oracles.OP1_QUALITY)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_frequent_lines(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    menu = " ".join(f"m{k}" for k in range(70))
    rows = [(i, own(i) + "\n" + menu.upper() + "  ", "h") for i in range(12)]
    rows += [(20 + i, own(99), "h") for i in range(30)]  # exact copies are documents of their own
    rows += [(70, own(70), "h")] * 30  # one document
    rows += [(None, own(71), "h")] * 11
    rows += [(60, own(60) + "\n" + menu, "other"), (61, None, None), (62, "", "h"), (None, menu, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = defaultdict(list)
    for r in quality.judged(docs).collect():
        got[r.doc_id].append(r)
    assert all(got[i][0].removed_words == 70 and not got[i][0].kept for i in range(12))
    assert all(got[20 + i][0].removed_words == 60 and not got[20 + i][0].kept for i in range(30))
    assert len(got[70]) == 30 and all(r.kept and r.removed_words == 0 for r in got[70])
    assert got[60][0].kept and not got[61][0].kept and got[62][0].base_failed
    assert sorted(r.removed_words for r in got[None]) == [60] * 11 + [70]
    assert quality.judged(docs.limit(0)).collect() == []


def test_clashing_columns(spark):
    rows = [(1, "a b", "h", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, removed int, kept int")
    assert quality.judged(docs).count() == 1
