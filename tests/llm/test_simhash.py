import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from framesieve.llm import queries, simhash
from framesieve.llm.components import components


def slow_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """{doc_id: fp} to {doc_id: least reachable doc_id}."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB é\t\n　", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_print(text)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 8), (20, 9)] + [(100 + i, 99 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8, 20: 8} | {99 + i: 99 for i in range(41)}
    assert got == want


def test_plan_covers(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for total in (300, 10**6, 10**9):
        groups, thresholds = simhash.plan(base, total)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(thresholds) == 4 - len(groups) + 1


def _clustered(rng):
    fps = set(rng.integers(0, 1 << 63, 200).tolist())
    for centre in list(fps)[:6]:
        for _ in range(60):
            near = centre
            for b in rng.choice(63, rng.integers(1, 7), replace=False).tolist():
                near ^= 1 << b
            fps.add(near)
    return sorted(fps)


def test_links_lose_nothing(spark):
    fps = _clustered(np.random.default_rng(7))
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = slow_components(dict(zip(range(len(fps)), fps)))
    at = {x: i for i, x in enumerate(fps)}
    for most in (20_000, 12):
        rows = [(at[r.x], at[r.y]) for r in simhash.links(frame, most_bucket=most).collect()]
        for a, b in rows:
            assert bin(fps[a] ^ fps[b]).count("1") <= 4
        got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
        assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_rows_without_id_connect_others(spark):
    """A null id between two others, alone, and in a chain that has one id at its end only."""
    chain = [0, 0b1111, 0b1111 << 4 | 0b1111, 0b1111 << 8 | 0b11111111]
    rows = [(1, chain[0]), (None, chain[1]), (2, chain[2]), (None, 1 << 40 | (1 << 20) - 1), (None, chain[3])]
    far = (1 << 60) - 1
    rows += [(None, far), (None, far ^ 1), (9, far ^ 0b11111 ^ 1)]
    marks = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(marks).collect()}
    assert [got[x] for x in chain] == [1, 1, 1, 1]
    assert got[1 << 40 | (1 << 20) - 1] is None
    assert [got[far], got[far ^ 1], got[far ^ 0b11111 ^ 1]] == [9, 9, 9]


def test_query(spark, sf):
    docs = {r.doc_id: slow_print(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = slow_components(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, sf).collect()}
    assert got == {i: (f"{docs[i]:016x}", want[i]) for i in docs}


def test_odd_rows(spark, odd_docs):
    got = sorted(simhash.near_duplicates(odd_docs).collect(), key=str)
    assert len(got) == odd_docs.count()
    zero = {r.doc_id: r.component_id for r in got if r.fp == 0}
    assert zero == {2: 2, 3: 2}
    assert simhash.near_duplicates(odd_docs.limit(0)).collect() == []
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "4", "7", "None"]
