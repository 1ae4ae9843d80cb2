import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from framesieve.llm import queries, repair, token_files, tokens

BYTES = queries.vocabulary("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(1, 5), st.integers(1, 40))
def test_grammar_round_trip(ids, rounds, per_round):
    ids = np.array(ids, np.uint32)
    symbols, rules = repair.compress(ids, 7, rounds, per_round, least=2)
    assert np.array_equal(repair.expand(symbols, rules, 7), ids)
    assert len(symbols) <= len(ids)


def test_random_access():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 50, 977), 60).astype(np.uint32)
    raw = repair.encode_shard(ids, np.array([len(ids)]), np.array([5]), np.array([True]), 50)
    assert len(raw) < 2 * len(ids) // 2
    shard = repair.Shard(raw)
    assert np.array_equal(shard.all_ids(), ids)
    for a, n in ((0, 1), (4000, 9000), (len(ids) - 5, 5), (17, 0)):
        assert np.array_equal(shard.decode(a, n), ids[a : a + n])


def test_no_frequent_pair_is_left():
    """Long repeats are folded until no pair occurs four times, however many rounds that takes."""
    rng = np.random.default_rng(2)
    ids = np.tile(rng.integers(0, 5000, 2000), 200).astype(np.uint32)
    symbols, rules = repair.compress(ids, 5000)
    assert np.array_equal(repair.expand(symbols, rules, 5000), ids)
    pairs = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
    assert np.unique(pairs[symbols[:-1] != symbols[1:]], return_counts=True)[1].max(initial=0) < 4
    assert len(symbols) < 2000


def test_not_a_shard():
    with pytest.raises(ValueError):
        repair.Shard(b"x" * 64)


def _expected(rows):
    coder = Tokenizer.from_file(BYTES)
    out, start = [], 0
    for r in rows:
        ids = np.array([*coder.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(queries.op9_token_files(spark, sf).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == _expected(rows)


def test_odd_rows(spark, odd_docs):
    manifest = token_files.write(odd_docs, BYTES, end_id=2, shard_ids=500)
    got = sorted(token_files.read(manifest).collect(), key=lambda r: r.start)
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    want = _expected(sorted(odd_docs.collect(), key=key))
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got] == want
    assert token_files.read(token_files.write(odd_docs.limit(0), BYTES, end_id=2)).collect() == []


def test_rare_chunks_are_kept():
    """A worker that has met 450,000 words still knows the first ones."""
    coder = tokens.encoder(BYTES, True, token_files.MOST_CHUNKS)
    for low in range(0, 450_000, 150_000):
        coder.encode([b" ".join(b"%d" % n for n in range(low, low + 150_000))])
    coder.encode([b"one more"])
    assert b"17" in coder.after and b"449999" in coder.after


class _Counted:
    """The library's merges, with the number of calls."""

    def __init__(self, merges):
        self.merges, self.calls = merges, 0

    def tokenize(self, text):
        self.calls += 1
        return self.merges.tokenize(text)


def test_new_words_are_merged_many_at_a_time():
    """3,000 new words of letters, some with marks or at the start of a line, take far fewer calls of the library."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzéß"))
    words = ["".join(row) for row in letters[np.random.default_rng(4).integers(0, 28, (3000, 9))]]
    texts = [" ".join(words[:1500]), "!! ".join(words[1500:2250]), "\n".join(words[2250:])]
    coder = tokens.ChunkEncoder(BYTES, True)
    coder.merges = counted = _Counted(coder.merges)
    got = coder.encode([t.encode() for t in texts])
    assert counted.calls < 300
    for text, ids in zip(texts, got):
        want = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, coder.kind).tolist() == want


def test_few_tasks_read_many_shards(spark):
    """Starting a Python task costs as much as decoding a shard, so a task reads several of them."""
    docs = spark.createDataFrame([(n, "some words " * 20) for n in range(600)], "doc_id long, text string").repartition(4)
    manifest = token_files.write(docs, BYTES, end_id=2, shard_ids=40)
    assert manifest.count() == 600
    found = token_files.read(manifest)
    assert found.rdd.getNumPartitions() <= max(600 // 8, 4 * spark.sparkContext.defaultParallelism)
    assert found.count() == 600


def test_long_nonterminals_are_expanded_where_they_stand(monkeypatch):
    """A table that has no place for the longer nonterminals gives the same ids."""
    ids = np.tile(np.random.default_rng(3).integers(0, 50, 977), 60).astype(np.uint32)
    raw = repair.encode_shard(ids, np.array([len(ids)]), np.array([5]), np.array([True]), 50)
    for most in (0, 500, 1 << 21):
        monkeypatch.setattr(repair, "EXPANDED", most)
        shard = repair.Shard(raw)
        assert np.array_equal(shard.all_ids(), ids)
        assert np.array_equal(shard.decode(4321, 30_000), ids[4321:34_321])


@pytest.mark.parametrize("bits", [1, 7, 8, 9, 17, 25, 31, 32])
def test_packed_values(bits):
    for count in (0, 1, 7, 8, 1001):
        values = np.random.default_rng(bits).integers(0, 1 << bits, count, dtype=np.uint64).astype(np.uint32)
        raw = np.frombuffer(repair.pack(values, bits), np.uint8)
        assert np.array_equal(repair.unpack(raw, bits, count), values)


def test_control_character_behind_a_blank():
    """U+0001 in a text is the text's own, not the mark that stands for no blank."""
    coder = tokens.ChunkEncoder(BYTES, True)
    for text in ("a \x01", " \x01b c", "a, \x01 b\n \x01", "\x01 \x01"):
        want = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode([text.encode()])[0], coder.kind).tolist() == want
