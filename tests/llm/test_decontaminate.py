import hashlib
import re

from framesieve.llm import decontaminate, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                got = windows.get(tuple(w[i : i + size]))
                if got:
                    hit.update(range(i, i + size))
                    found |= got
        names = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), names, bool(hit)))
    return sorted(out, key=str)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op8_decontaminate(spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == slow(docs, items)
    assert got.where("contaminated").count() > 0


def test_odd_rows(spark, odd_docs):
    items = [(1, "word word"), (2, "the café of it"), (2, "IT'S a test"), (3, None), (4, "!!"), (None, "hello")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = odd_docs.union(
        spark.createDataFrame([(9, "in THE café, of it: word word", None), (10, "a b c " * 30, "q")], odd_docs.schema)
    )
    want = slow([(r.doc_id, r.text) for r in docs.collect()], [x for x in items if x[0] is not None])
    found = decontaminate.contamination(docs, bench)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect()]
    assert sorted(got, key=str) == sorted([x[:4] + x[5:] for x in want], key=str)
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    kept = decontaminate.clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "7", "None"]


def test_every_row_comes_back(spark):
    """Repeated rows, different texts that share an id, and null ids."""
    rows = [(1, "hello word word"), (1, "hello word word"), (1, "other text"), (None, "word word"), (None, "it's a test"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "word word"), (2, "the café of it"), (3, "IT'S a test"), (4, "hello word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([x[:4] + x[5:] for x in slow(rows, items)], key=str)
    found = decontaminate.contamination(docs, bench)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect()]
    assert sorted(got, key=str) == want


def test_long_texts_and_many_windows(spark):
    """A long text full of overlapping windows, widths around the shingle's, and shingles at both ends."""
    run = " ".join(f"w{i % 7}" for i in range(20_000))
    rows = [(1, run), (2, "x " + run + " y"), (3, "w0 w1 w2"), (4, "w0 w1"), (5, " ".join(f"w{i}" for i in range(9)))]
    items = [(1, " ".join(f"w{i % 7}" for i in range(40))), (2, "w0 w1"), (3, "x"), (4, "w8"), (5, "w5 w6 w7 w8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect()]
    assert sorted(got, key=str) == sorted([x[:4] + x[5:] for x in slow(rows, items)], key=str)
