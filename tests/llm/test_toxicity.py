import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framesieve.llm import queries, toxicity


def plain_symbols(text):
    """Words of a text as tuples of symbols, each with its closing border."""
    words, word = [], []
    for c in [*text, "\n"]:
        base = c.lower()[0]
        if ord(c) < 1 << 16 and not c.isalnum():
            if word:
                words.append((*word, 0))
            word = []
        elif "a" <= base <= "z":
            word.append(ord(base) - 96)
        else:
            word.append(27 if c.isdecimal() and ord(c) < 1 << 16 else 28 + ord(base) % 12)
    return words


class PlainModel:
    """Interpolated Kneser-Ney by its definition, over dictionaries."""

    def __init__(self, order, counts, discount, shared):
        self.order, self.discount, self.levels = order, discount, {}
        level = [Counter(counts[0]), Counter(counts[1])]
        for k in range(order, 0, -1):
            used = [level[0] + level[1]] * 2 if k <= shared else level
            self.levels[k] = used
            level = [Counter({g: len({x[0] for x in c if x[1:] == g}) for g in {x[1:] for x in c}}) for c in level]

    def p(self, cls, gram):
        if not gram:
            return 1 / toxicity.SYMBOLS
        counts = self.levels[len(gram)][cls]
        beside = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        if not beside:
            return self.p(cls, gram[1:])
        own = max(counts.get(gram, 0) - self.discount, 0)
        return (own + self.discount * len(beside) * self.p(cls, gram[1:])) / sum(beside)


def grams(word, order):
    padded = (0,) * (order - 1) + word
    return [padded[i : i + order] for i in range(len(word))]


def test_against_the_definition():
    rng = random.Random(3)
    docs = [" ".join(rng.choice(["aab", "Éa", "b1", "bba", "ж"]) for _ in range(6)) for _ in range(12)]
    counts = [Counter(), Counter()]
    for i, text in enumerate(docs):
        for word in set(plain_symbols(text)):
            counts[i % 2].update(grams(word, 3))
    dense = np.zeros((2, *[toxicity.SYMBOLS] * 3))
    for cls in (0, 1):
        for g, n in counts[cls].items():
            dense[(cls, *g)] = n
    p = toxicity.probabilities(dense, 0.8, 1)
    assert np.allclose(p.sum(axis=-1), 1)
    plain = PlainModel(3, counts, 0.8, 1)
    for g in [*counts[0], *counts[1], (1, 2, 9), (0, 0, 5), (7, 7, 7)]:
        for cls in (0, 1):
            assert math.isclose(p[(cls, *g)], plain.p(cls, g))
    keys = np.array([(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c for a, b, c in counts[0] | counts[1]])
    order = [tuple(g) for g in counts[0] | counts[1]]
    n0, n1 = ([c[g] for g in order] for c in counts)
    model = toxicity.kneser_ney(keys, np.array(n1), np.array(n0), 3, 0.8, 1)
    texts = ["aab ÉA, b1!", "", " ..", "bba ж zz", "x" * 50]
    for text, got in zip(texts, toxicity.evidence(model, [t.encode() for t in texts])):
        ratios = [sum(math.log(plain.p(1, g) / plain.p(0, g)) for g in grams(w, 3)) for w in plain_symbols(text)]
        letters = sum(map(len, plain_symbols(text)))
        assert math.isclose(got[0], sum(ratios) / max(letters, 1), abs_tol=1e-5)
        top = sum(sorted((r for r in ratios if r > 0), reverse=True)[:3]) / 3
        assert math.isclose(got[3], top, abs_tol=1e-4)
        assert math.isclose(got[4], math.log1p(len(ratios)))


def test_counts_of_a_task():
    """Each distinct word of a text counts once, however the texts are batched."""
    texts = ["aa aa b", "b", "", "c aa"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([t.encode() for t in texts]), pa.array([1, 0, 1, 0], pa.int32()), pa.array([False, False, True, True])],
        ["raw", "toxic", "picked"],
    )
    [out] = list(toxicity._partial(2)(iter([batch])))
    want = Counter()
    for text, kind in zip(texts, (1, 0, 3, 2)):
        for word in set(plain_symbols(text)):
            want.update((a * toxicity.SYMBOLS + b) * 4 + kind for a, b in grams(word, 2))
    assert dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())) == dict(want)


def test_long_texts_are_read_whole():
    raw = ("plain words " * 200_000 + "zq" + "x" * 1_500_000 + " end").encode()
    parts = list(toxicity.segments(raw))
    assert b"".join(parts) == raw and len(parts) > 2 and max(map(len, parts)) < 1_600_000
    model = toxicity.Model(2, np.zeros(toxicity.SYMBOLS**2, np.float32))
    assert toxicity.evidence(model, [raw, b"a b"])[0, 4] == math.log1p(400_002)


def test_words_of_a_long_text_count_once():
    """A text beyond one part counts each of its words once, as short texts do; empty texts may stand between."""
    long = " ".join(f"w{'abcdefgh'[k % 8]} x{'stuv'[k % 4]}" for k in range(400_000))
    texts = ["wa wa", long, "", "wa", long[::-1], None]
    assert len(long.encode()) > 2_000_000
    order = 3
    kept = Counter()
    for text in texts:
        for word in set((text or "").split()):
            kept[word] += 1
    want = Counter()
    for word, n in kept.items():
        found = toxicity.words_in([word.encode()], order)
        for gram in found.grams:
            want[int(gram)] += n
    batch = pa.RecordBatch.from_arrays(
        [pa.array([None if t is None else t.encode() for t in texts]), pa.array([0] * 6), pa.array([False] * 6)], ["raw", "toxic", "picked"]
    )
    out = next(toxicity._partial(order)([batch]))
    assert {k // 4: n for k, n in zip(*(c.to_pylist() for c in out.columns))} == want


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op6_toxicity(spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    got = rows.join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id)
    assert got.score.between(0, 1).all()
    bad, good = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None, :]).mean() > 0.9
    assert (got.predicted == (got.score >= 0.3)).all()


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        model = toxicity.train(odd_docs, some)
        got = toxicity.scored(odd_docs, model)
        assert got.columns == [*odd_docs.columns, "score"]
        assert got.count() == odd_docs.count()
        assert got.where("score between 0 and 1").count() == odd_docs.count()
    assert toxicity.scored(odd_docs.limit(0), model).collect() == []
    clash = odd_docs.withColumns({"_toxicity": F.lit(7), "_score": F.lit(8), "score": F.lit(9)})
    kept = toxicity.clean(clash, labels.withColumn("part", F.lit(1)), limit=1.1)
    assert kept.columns == clash.columns and kept.where("_toxicity = 7 and _score = 8 and score = 9").count() == odd_docs.count()
    assert toxicity.clean(clash.limit(0), labels).collect() == []
    assert {"score", "ratio"} < set(toxicity.scored(clash, model, ratio="ratio").columns)
    kept = toxicity.clean(odd_docs, labels.withColumn("part", F.lit(1)), limit=1.1)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_counts_cover_fold_3(spark):
    """An expression that stands only in labelled documents of fold 3 is known to the model."""
    folds = {i: zlib.crc32(str(i).encode()) % 4 for i in range(400)}
    docs = [(i, f"plain words of a text {'zxqvkj' if k == 3 and i % 2 else 'again'} {i}") for i, k in folds.items()]
    labels = [(i, int(i % 2 and k == 3 or i % 9 == 0)) for i, k in folds.items()]
    model = toxicity.train(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    )
    [known, plain] = toxicity.evidence(model, [b"zxqvkj", b"again"])
    assert known[3] > 1 and known[3] > plain[3]
