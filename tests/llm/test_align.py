import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framesieve.llm import align, queries

A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


class Slow:
    """One document at a time, tokens by the libraries alone, links by comparing ranges."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.one = Tokenizer.from_file(A)
        self.one.encode_special_tokens = True
        self.two = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(x): x for x in shown}
        self.byte |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.byte[c] for c in self.one.id_to_token(i))) for i in self.one.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.two.encode(text):
            p = self.two.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.two.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def rows(self, docs):
        count, kept = Counter(), []
        for doc, text in docs:
            a, b = self.tokens(text)
            spans = []
            for side in (a, b):
                at, out = 0, []
                for i, raw in side:
                    out.append((i, at, at + len(raw)))
                    at += len(raw)
                spans.append(out)
            links, low = [], 0
            for i, s, e in spans[0]:
                while low < len(spans[1]) and spans[1][low][2] <= s:
                    low += 1
                k = low
                while k < len(spans[1]) and spans[1][k][1] < e:
                    links.append((i, spans[1][k][0]))
                    k += 1
            common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
            groups = [[[], []] for _ in common]
            for side in (0, 1):
                g = 0
                for i, s, e in spans[side]:
                    while e > common[g]:
                        g += 1
                    groups[g][side].append(str(i))
            shown = ";".join("|".join(",".join(x) for x in g) for g in groups)
            count.update(links)
            kept.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(shown.encode()).hexdigest() if a else ""))
        best = Counter()
        for (_, b), n in count.items():
            best[b] = max(best[b], n)
        return [
            (d, na, nb, ng, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), sha)
            for d, na, nb, ng, ls, sha in kept
        ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "a", "  two  blanks ", "\n\nline\n x\t", "<|endoftext|> and <s> </s> <0x41> <unk>", "x▁y", "▁", "é ﬁ ① 字字字 🙂🙂",
       "a b　c", "It's they'll 1234567 ...!!! -- ==", "\x00\x01 z", "\r\n\r\n", "x" * 3000, "word " * 4000, "ab" * 70000]


def same(spark, docs, **how):
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("a", F.lit(1)).withColumn("n_best", F.lit("x"))
    got = align.aligned(rows, A, B, **how).select(COLUMNS).collect()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(Slow().rows(docs), key=order)


@pytest.mark.parametrize("block_pairs", [2_000_000, 150])
def test_odd_texts(spark, block_pairs):
    docs = list(enumerate(ODD)) + [(3, "a"), (None, "no id"), (None, None)]
    same(spark, docs, block_pairs=block_pairs)


def test_random_texts(spark):
    pick = random.Random(9)
    parts = ["the ", "of", " ", "  ", "\n", "ing", "tion", "Über", "字", "🙂", ".", ",", "'s", "<|", "<s>", "12", "\t", "qzx", "-", "é"]
    same(spark, [(i, "".join(pick.choices(parts, k=pick.randint(0, 60)))) for i in range(400)])


def test_given_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(spark, docs)
    got = queries.op11_align(spark, sf)
    assert got.columns == COLUMNS and got.count() == len(docs)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.aligned(none, A, B).collect() == []
    assert [tuple(r)[3:] for r in align.aligned(spark.createDataFrame([(1, None)], none.schema), A, B).collect()] == [(0, 0, 0, 0, "", 0, 0)]


@settings(max_examples=300, deadline=None, database=None)
@given(st.lists(st.integers(0, 60), unique=True), st.lists(st.integers(0, 60), unique=True), st.data())
def test_gallop(short, long, data):
    short, long = np.array(sorted(short), np.int64), np.array(sorted(long), np.int64)
    guess = np.array([data.draw(st.integers(-3, 70)) for _ in short], np.int64)
    assert align.gallop(short, long, guess).tolist() == np.searchsorted(long, short).tolist()
