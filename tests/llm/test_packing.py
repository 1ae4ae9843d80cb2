import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from framesieve.llm import packing, queries

WORDS = queries.vocabulary("word_bpe_49k.json")


def _ids(text):
    one = Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False)
    return np.array([*one.ids, 1], "<u4")


def _whole(pieces, width):
    seen = defaultdict(list)
    for r in pieces:
        seen[r.sequence_id].append((r.offset, r.length))
        assert 0 < r.length <= width
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    fills = {k: sum(x[1] for x in v) for k, v in seen.items()}
    assert all(n == width for k, n in fills.items() if k != max(fills))
    assert sorted(fills) == list(range(len(fills)))


def test_pieces_restore_every_document(spark, odd_docs):
    pieces = packing.pack(odd_docs, WORDS, width=64).collect()
    _whole(pieces, 64)
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(_ids(r.text))
    got = defaultdict(list)
    for r in pieces:
        got[r.doc_id].append(r)
    assert got.keys() == texts.keys()
    for key, want in texts.items():
        whole = sum(len(x) for x in want)
        assert sum(r.length for r in got[key]) == whole
        for r in got[key]:
            assert bytes(r.piece_ids) == want[0][r.start : r.start + r.length].tobytes()
            assert r.doc_tokens == len(want[0])
            assert r.continues == (r.start + r.length < r.doc_tokens)


def test_empty_table(spark, odd_docs):
    assert packing.pack(odd_docs.limit(0), WORDS).collect() == []


def test_query(spark, sf):
    rows = queries.op2_packing(spark, sf).collect()
    _whole(rows, 2048)
    docs = {r.doc_id: _ids(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == docs.keys()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(docs[r.doc_id][r.start : r.start + r.length].tobytes())
