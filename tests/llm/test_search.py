import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framesieve.llm import oracles, queries, search


def slow_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def slow(docs, items, top):
    counted = [(doc, Counter(slow_terms(text))) for doc, text in docs]
    n_docs = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for place, (doc, c) in enumerate(counted):
            n = sum(c.values())
            score = 0
            for t in set(slow_terms(text)):
                if t in c:
                    m = 100 - 90 + (90 * n * n_docs) // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, place, doc))
        out += [(item, k + 1, f[4], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return out


def texts(pick, n, longest):
    words = ["the", "of", "é", "Ärger", "x9", "q-r", *(f"w{i}" for i in range(60))]
    weights = [40, 30, 3, 2, 2, 1, *(60 / (i + 1) for i in range(60))]
    return [" ".join(pick.choices(words, weights, k=pick.randint(0, longest))) for _ in range(n)]


def key(row):
    return tuple((x is None, str(x).rjust(30)) for x in row)


@pytest.mark.parametrize("portions", [(2, 3), (64, 250, 999)])
def test_random(spark, portions):
    pick = random.Random(3)
    docs = [(i, t) for i, t in enumerate(texts(pick, 300, 60))]
    docs += [(1000 + i, "the w5 w5 of tie") for i in range(15)]  # equal scores
    docs += [(7, "w5 w6 w7"), (7, "w5 w6 w7"), (None, "w5 w6 w7"), (None, None), (2000, ""), (2001, "!? .")]
    docs += [(3000, "w5 w59 " * 20000), (3001, " ".join(f"u{i}" for i in range(30000)) + " tie")]
    items = [(f"i{i}", t) for i, t in enumerate(texts(pick, 12, 12))]
    items += [("tie", "tie W5"), ("tie", "tie"), (None, "w6"), ("none", None), ("empty", ""), ("unknown", "zzz")]
    got = search.ranked(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("row", F.lit(0)).withColumn("n", F.lit("x")),
        spark.createDataFrame(items, "item_id string, text string").withColumn("value", F.lit(1)),
        top=10,
        block_items=7,
        portions=portions,
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(key, got.collect())) == sorted(map(key, slow(docs, items, 10)))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    # One document: each of its terms weighs floor(1000 ln(4/3)).
    assert [tuple(r)[:3] for r in search.ranked(docs, items).collect()] == [("x", 1, 1)]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.selectExpr("doc_id", "'' AS text"), items)):
        assert search.ranked(d, i).collect() == []


def test_cells_never_stand_below_a_term():
    hashes = search._Hashes()
    counted = [Counter({b"t%d" % i: i + 1 for i in range(k)}) for k in (0, 1, 300, 5000)]
    for c, sketch in zip(counted, search._sketches(counted, hashes)):
        codes = np.frombuffer(sketch, np.uint8)
        for t, f in c.items():
            for cell in search.cells_of(np.array([hashes[t]], np.uint64).astype(np.int64), len(codes) // 2):
                assert search.FREQUENCY[codes[cell[0]]] >= f


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_query_matches_sql(spark, sf, scale):
    sf = sf.replace("0.001", scale)
    got = queries.op13_search(spark, sf)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    want = con.sql(oracles.OP13_SEARCH)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
