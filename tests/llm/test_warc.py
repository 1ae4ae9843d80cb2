import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framesieve.llm import oracles, queries, warc


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=12), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_record_round_trip():
    raw = b"<p>\r\n\r\nWARC/1.1 \xc3\xa9"
    digest = hashlib.sha1(raw).hexdigest()
    head, http, payload = warc.parse(warc.record(5, "http://a b\n/", warc.FIRST_CAPTURE, raw, digest, len(raw), None))
    assert payload == raw and head["warc-type"] == "response" and head["warc-target-uri"] == "http://a%20b%0A/"
    head, http, payload = warc.parse(warc.record(5, "u", warc.FIRST_CAPTURE, None, digest, len(raw), 9))
    assert payload == b"" and head["warc-refers-to"] == "<urn:page:9>"


def test_url_key():
    assert warc.url_key("https://www.Example.com/A?b=C#x") == "com,example)/a?b=c"
    assert warc.url_key("http://[bad") == "http://[bad"


@pytest.mark.parametrize("scale", ["0.001", "0.1"])
def test_query_matches_sql(spark, sf, scale):
    sf = sf.replace("0.001", scale)
    got = queries.op4_warc(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = con.sql(oracles.OP4_WARC)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_odd_rows(spark):
    big = "x" * 1000
    rows = [(1, "http://b.c/", big, 0), (3, "http://b.c/", big, 0), (2, None, big, 0), (3, "http://b.c/", big, 0)]
    rows += [(4, "http://a.c/", "x" * 999, 0), (5, "http://a.c/", "x" * 999, 0), (6, "", None, 0), (None, "u", big, 0)]
    rows += [(10 + i, f"http://h{random.Random(i).randrange(5)}.org/p", f"é{i}" * 600, 0) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    index = warc.write(pages, run_rows=5, file_bytes=2000)
    order = sorted(warc.merged(index, range_rows=7).collect(), key=lambda r: r.capture_rank)
    assert [r.capture_rank for r in order] == list(range(len(rows))) and len({r.part for r in order}) > 3
    keys = [(r.urlkey, r.captured, -1 if r.page_id is None else r.page_id) for r in order]
    assert keys == sorted(keys) and len(keys) == len(rows)
    found = warc.read(warc.merged(index, range_rows=7)).collect()
    history = [r.page_id for r in sorted(found, key=lambda r: r.capture_rank)]
    assert history == [r.page_id for r in order]
    by_id = {r.page_id: r for r in found}
    assert (by_id[1].record_type, by_id[1].refers_to, by_id[1].payload) == ("revisit", 3, None)
    assert by_id[2].refers_to == 3 and by_id[1].payload_bytes == 1000
    assert sum(r.page_id == 3 and r.record_type == "response" for r in found) == 2
    assert by_id[4].record_type == by_id[5].record_type == "response"
    assert by_id[6].payload_bytes == 0 and by_id[None].record_type == "response"
    assert all(bytes(by_id[10 + i].payload).decode() == f"é{i}" * 600 for i in range(40))
    assert warc.read(warc.merged(warc.write(pages.limit(0)))).collect() == []
