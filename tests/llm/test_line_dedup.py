import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from framesieve.llm import line_dedup, oracles, queries

STRIP = " \t\n\x0b\x0c\r"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(STRIP))


def slow(rows, least_chars=40, least_docs=5):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(doc)
    keeper = {
        k: max((d for d in ds if d is not None), default=None)
        for k, ds in holders.items()
        if len(k) >= least_chars and len(ds) >= least_docs
    }
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in keeper or keeper[key_of(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def found(docs, **how):
    return [tuple(r) for r in line_dedup.deduplicated(docs, **how).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_random_texts(spark):
    pick = random.Random(5)
    pool = [pick.choice("aAéÉ x") * pick.randint(1, 6) + str(i % 7) for i in range(40)]
    rows = []
    for i in range(150):
        lines = [pick.choice(STRIP) * pick.randint(0, 2) + pick.choice(pool) + pick.choice(["", " ", "\r"]) for _ in range(pick.randint(0, 9))]
        rows.append((pick.choice([None, *range(120)]), "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, (pool[0] + "\n") * 5000), (503, pool[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for least in (1, 4):
        assert order(found(docs, least_chars=3, least_docs=least)) == order(slow(rows, 3, least))


def test_keeper_limits_and_clashes(spark):
    long = "L" * 39 + "é"
    short = "s" * 39
    rows = [(i, f"{short}\n \t{long.lower() if i % 2 else long}\r\nown {i}", i) for i in range(7)]
    rows += [(6, long, 0), (None, long, 0), (None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keys int").withColumn("row", F.lit(1))
    got = Counter(found(docs))
    want = Counter({(i, 3, 1, f"{short}\nown {i}"): 1 for i in range(6)})
    want += Counter([(6, 3, 0, rows[6][1]), (6, 1, 0, long), (None, 1, 1, ""), (None, 1, 0, "")])
    assert got == want
    four = spark.createDataFrame([(i, long) for i in range(4)], "doc_id long, text string")
    assert all(r[2] == 0 for r in found(four))
    only_null = spark.createDataFrame([(None, long)] * 9, "doc_id long, text string")
    assert all(r[2] == 0 for r in found(only_null))
    assert found(docs.limit(0)) == []


def test_runs_are_levelled(spark):
    """Compaction leaves fewer runs than batches, one record a key, and keys known as frequent enter no further run."""
    runs = line_dedup.LineRuns(spark, least_docs=2, buckets=3, fanout=2)
    for high in range(50, 0, -10):
        rows = [(d, 1, 1) for d in range(high - 10, high)] + [(d, d, 0) for d in range(high - 10, high)]
        runs.add(spark.createDataFrame(rows, "doc_id long, h long, g long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    merged = {(r.h, r.g): (r.docs, r.keeper) for r in line_dedup.merge(runs.runs()).collect()}
    assert merged == {(1, 1): (10, 49)} | {(d, 0): (1, d) for d in range(50)}
    assert [(r.h, r.g, r.keeper) for r in runs.frequent().collect()] == [(1, 1, 49)]


def test_no_python(spark, sf, capsys):
    queries.op12_line_dedup(spark, sf).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_query_matches_sql(spark, sf, scale):
    sf = sf.replace("0.001", scale)
    got = queries.op12_line_dedup(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.sql(oracles.OP12_LINE_DEDUP)
    assert got.columns == want.columns
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
    assert sum(r.n_dropped for r in rows) > 0
