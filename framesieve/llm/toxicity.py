"""Toxicity by class-conditional Kneser-Ney models.

Expressions are words, modelled as sequences of symbols: one interpolated Kneser-Ney model of the words of toxic documents
and one of ordinary documents, over all labelled training documents.  Orders up to shared_order draw their counts from
both classes together, so an expression that neither class knows well gets nearly the same likelihood from both.  A word's
log-likelihood ratio depends on the word alone; a document's evidence is its ratio per symbol (the length-normalised
comparison of both models) and what its most telling words add.  A logistic curve over that evidence gives the score.  It
is fitted on a bounded sample of labelled documents, with a model whose counts lack that sample; the model that scores
counts the sample too.

Symbols are a fixed alphabet of SYMBOLS: the letters a to z, digits as one, all other letters in a few classes, and the border of a word.  All n-grams of an order therefore fit a dense table: none is dropped, whatever the
corpus, and what is sent to the workers has one size.  Counts of the longest n-grams are summed on Spark from one partial
count per task; all lower orders are counts of distinct extensions of the next higher order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, hash_sample, stored, text_bytes

#: 0 is the border of a word, 1-26 are letters, 27 is any digit, the rest classes of other letters.
SYMBOLS, DIGIT, OTHERS = 40, 27, 12
FEATURES = 5


def fold(doc_id):
    """crc32 of the id as text, mod 4: 2 is held out, all others feed the counts, 3 the curve too."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


# -- words as symbols --------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """The symbol of each code point below 2^16; beyond, every character counts as a letter."""
    out = np.zeros(1 << 16, np.uint8)
    for point in range(1 << 16):
        c = chr(point)
        if not c.isalnum():
            continue
        low = c.lower()[0]
        out[point] = ord(low) - 96 if "a" <= low <= "z" else DIGIT if c.isdecimal() else DIGIT + 1 + ord(low) % OTHERS
    return out


def segments(raw: bytes, most: int = 1_000_000):
    """raw in parts of at most most bytes, cut at blanks or line feeds; a longer word stays whole."""
    at = 0
    while len(raw) - at > most:
        cut = max(raw.rfind(b" ", at, at + most), raw.rfind(b"\n", at, at + most))
        if cut <= at:
            nexts = [x for x in (raw.find(b" ", at + most), raw.find(b"\n", at + most)) if x > 0]
            if not nexts:
                break
            cut = min(nexts)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


@dataclass
class Words:
    """grams: for each symbol of each word, its closing border included, the n-gram that ends there; starts and sizes of the
    words in grams; owner: the text of each word."""

    grams: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray


def words_in(raws: list[bytes], order: int) -> Words:
    texts = [x.decode("utf-8", "replace") for x in raws]
    points = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "replace"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    low = points < 1 << 16
    codes = np.where(low, alphabet()[np.where(low, points, 0)], (DIGIT + 1 + points % OTHERS).astype(np.uint8))
    border = codes == 0
    keep = np.flatnonzero(~(border & np.concatenate(([True], border[:-1]))))
    symbols = codes[keep].astype(np.int32)
    last = np.flatnonzero(symbols == 0)
    starts = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    sizes = last - starts + 1
    place = np.arange(len(symbols)) - np.repeat(starts, sizes)
    grams = symbols.copy()
    for back in range(1, order):
        before = np.zeros_like(symbols)
        before[back:] = np.where(place[back:] >= back, symbols[:-back], 0)
        grams += before * np.int32(SYMBOLS**back)
    return Words(grams, starts, sizes, np.searchsorted(ends, keep[starts], "right"))


def word_keys(words: Words, texts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word and the number of its text."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(words.grams)) - np.repeat(words.starts, words.sizes)
    mixed = _mix(words.grams.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _mix(np.add.reduceat(mixed, words.starts) + texts.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Distinct:
    """Which words are the first of their kind in their text, for parts in their order; a text may go on in later parts."""

    def __init__(self):
        self.text, self.seen = -1, np.zeros(0, np.uint64)

    def first(self, words: Words, owners: np.ndarray) -> np.ndarray:
        """owners: the text of each part that words were found in."""
        texts = owners[words.owner]
        keys = word_keys(words, texts)
        first = np.zeros(len(keys), bool)
        first[np.unique(keys, return_index=True)[1]] = True
        first &= ~np.isin(keys, self.seen)
        ours = np.unique(keys[texts == owners[-1]])
        self.seen = np.union1d(self.seen, ours) if owners[-1] == self.text else ours
        self.text = owners[-1]
        return first


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batched(raws, most: int = 1_000_000):
    """(parts, their texts' places): segments of all texts, together at most most bytes unless one is longer."""
    parts, owners, size = [], [], 0
    for i, raw in enumerate(raws):
        for part in segments(raw, most):
            if parts and size + len(part) > most:
                yield parts, np.array(owners)
                parts, owners, size = [], [], 0
            parts.append(part)
            owners.append(i)
            size += len(part)
    if parts:
        yield parts, np.array(owners)


# -- counts ------------------------------------------------------------------------------------------------------------


def _partial(order: int, most_keys: int = 4_000_000):
    """Per task the n-grams of its documents' distinct words: key is the n-gram and its class (toxic, and in the sample)."""

    def summed(held):
        keys, counts = (np.concatenate(x) for x in zip(*held))
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, counts).astype(np.int64)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            label, picked = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            kinds = label.astype(np.int64) + 2 * picked.astype(np.int64)
            distinct = Distinct()
            for parts, owners in batched(x.as_py() or b"" for x in batch.column(0)):
                words = words_in(parts, order)
                first = distinct.first(words, owners)
                kind = kinds[owners[words.owner]]
                keys = words.grams.astype(np.int64) * 4 + np.repeat(kind, words.sizes)
                held.append(np.unique(keys[np.repeat(first, words.sizes)], return_counts=True))
                size += len(held[-1][0])
                if size > most_keys:
                    held = [summed(held)]
                    size = len(held[0][0])
        keys, counts = summed(held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    return run


# -- the models --------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """ratio: log P(symbol | toxic) - log P(symbol | ordinary) of every n-gram; the rest is the curve's."""

    order: int
    ratio: np.ndarray
    weights: list[float] = field(default_factory=list)
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    prior: float = 0.5


def probabilities(counts: np.ndarray, discount: float = 0.8, shared_order: int = 2) -> np.ndarray:
    """Interpolated Kneser-Ney probabilities of both classes: [class, symbols before..., symbol].

    counts: [class, symbols before..., symbol] of the longest n-grams.  Each shorter order counts the distinct symbols to
    the left; orders up to shared_order add both classes.
    """
    levels = [counts.astype(np.float64)]
    while levels[-1].ndim > 2:
        levels.append((levels[-1] > 0).sum(axis=1).astype(np.float64))
    p = np.full((2,), 1 / SYMBOLS)[:, None]
    for k, n in enumerate(reversed(levels), 1):
        if k <= shared_order:
            n = np.broadcast_to(n.sum(axis=0, keepdims=True), n.shape)
        total = n.sum(axis=-1, keepdims=True)
        known = np.maximum(total, 1)
        back = np.where(total > 0, discount * (n > 0).sum(axis=-1, keepdims=True) / known, 1.0)
        p = np.maximum(n - discount, 0) / known + back * (p if k == 1 else p[:, None])
    return p


def kneser_ney(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int, discount: float, shared_order: int) -> Model:
    counts = np.zeros((2, SYMBOLS**order))
    counts[0, keys], counts[1, keys] = ordinary, toxic
    p = probabilities(counts.reshape((2,) + (SYMBOLS,) * order), discount, shared_order)
    return Model(order, (np.log(p[1]) - np.log(p[0])).astype(np.float32).ravel())


# -- evidence and curve ------------------------------------------------------------------------------------------------


def evidence(model: Model, raws: list[bytes], strong_from: float = 2.0, most_top: int = 3) -> np.ndarray:
    """Per text: ratio per symbol; strong words' ratios, summed and by the root of the words; the top words' mean; words."""
    n = len(raws)
    total, symbols, words, strong = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    tops = []
    for parts, owners in batched(raws):
        found = words_in(parts, model.order)
        if not len(found.starts):
            continue
        text = owners[found.owner]
        ratios = np.add.reduceat(model.ratio[found.grams].astype(np.float64), found.starts)
        total += np.bincount(text, ratios, n)
        symbols += np.bincount(text, found.sizes, n)
        words += np.bincount(text, minlength=n)
        strong += np.bincount(text, np.maximum(ratios - strong_from, 0), n)
        tops.append(_top(text[ratios > 0], ratios[ratios > 0], most_top))
    text, ratios = _top(*(np.concatenate(x) for x in zip(*tops)), most_top) if tops else (np.zeros(0, np.int64), np.zeros(0))
    top = np.bincount(text, ratios, n) / most_top
    root = np.sqrt(np.maximum(words, 1))
    out = (total / np.maximum(symbols, 1), np.log1p(strong), np.log1p(10 * strong / root), np.minimum(top, 30), np.log1p(words))
    return np.stack(out, axis=1)


def _top(text: np.ndarray, ratios: np.ndarray, most: int):
    """The most largest ratios of each text."""
    order = np.lexsort((-ratios, text))
    text, ratios = text[order], ratios[order]
    fresh = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, np.int64)
    rank = np.arange(len(text)) - np.repeat(fresh, np.diff(np.append(fresh, len(text))))
    return text[rank < most], ratios[rank < most]


def scores(model: Model, found: np.ndarray) -> np.ndarray:
    if not model.weights:
        return np.full(len(found), model.prior)
    x = (found - model.centre) / model.scale @ np.array(model.weights[1:]) + model.weights[0]
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_curve(model: Model, evidence: np.ndarray, labels: np.ndarray, steps: int = 60, ridge: float = 1.0) -> None:
    """Logistic regression by Newton steps."""
    model.centre = evidence.mean(axis=0).tolist()
    model.scale = [s or 1.0 for s in evidence.std(axis=0).tolist()]
    x = np.hstack((np.ones((len(evidence), 1)), (evidence - model.centre) / model.scale))
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [ridge] * evidence.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (labels - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = [float(v) for v in w]


def train(
    docs: DataFrame,
    labels: DataFrame,
    order: int = 4,
    discount: float = 0.8,
    shared_order: int = 2,
    curve_rows: int = 20_000,
) -> Model:
    """Fit both models on all labelled documents but those of fold 2, and the curve on at most curve_rows of fold 3.

    docs needs doc_id and text, labels doc_id and toxic; other columns are left out.  A doc_id with several labels takes
    the largest; null labels and null ids are left out.  Where a class or all labels are missing, every text gets the
    smoothed share of toxic labels.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    )
    known = known.withColumn("fold", fold("_id")).where("fold <> 2")
    n = known.agg(
        F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.count_if(F.col("fold") == 3).alias("curve")
    ).first()
    # A bounded number of ids, so the sample may be sent to all workers.
    picked = stored(hash_sample(known.where("fold = 3").select("_id", "toxic"), ["_id"], curve_rows, n.curve), "toxicity-curve")
    flagged = known.join(F.broadcast(picked.select("_id", F.lit(True).alias("picked"))), "_id", "left")
    flagged = flagged.select("_id", "toxic", F.coalesce("picked", F.lit(False)).alias("picked"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_bytes().alias("raw"))
    # Labels grow with the corpus, so they are never sent to all tasks: the join deals both sides by id at every size.
    counted = rows.where(fold("_id") != 2).join(flagged.hint("merge"), "_id").select("raw", "toxic", "picked")
    top = counted.mapInArrow(_partial(order), "key long, n long").groupBy((F.col("key") / 4).cast("long").alias("gram"))
    top = top.agg(*(F.sum(F.when(F.col("key") % 4 == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(4)))
    # One row per n-gram of the alphabet at most, SYMBOLS ** order of them, whatever the documents.
    grams = top.toPandas()
    keys, (n0, n1, p0, p1) = grams["gram"].to_numpy(), (grams[f"c{c}"].to_numpy() for c in range(4))
    shared = spark.sparkContext.broadcast(kneser_ney(keys, n1, n0, order, discount, shared_order))
    sample = rows.join(F.broadcast(picked), "_id").select("raw", "toxic").mapInArrow(
        _evidence(shared), "toxic int, evidence array<double>"
    )
    found = sample.toPandas()
    shared.unpersist()
    model = kneser_ney(keys, n1 + p1, n0 + p0, order, discount, shared_order)
    model.prior = ((n.toxic or 0) + 1) / (n.n + 2)
    if len(found) and 0 < found["toxic"].sum() < len(found):
        fit_curve(model, np.array(found["evidence"].tolist(), np.float64), found["toxic"].to_numpy(np.float64))
    return model


def _evidence(shared):
    def run(batches):
        for batch in batches:
            values = evidence(shared.value, [x.as_py() or b"" for x in batch.column(0)])
            cells = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), cells], ["toxic", "evidence"])

    return run


def scored(docs: DataFrame, model: Model, name: str = "score", ratio: str | None = None) -> DataFrame:
    """docs, all rows and columns, with the toxicity of text (0 to 1) in column name; null and empty texts too.

    ratio names a second new column: log P(text | toxic) - log P(text | ordinary) per symbol.  A column of docs that has
    one of these names is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score double, ratio double>")
    def toxicity(cells: pd.Series) -> pd.DataFrame:
        found = evidence(shared.value, list(cells))
        return pd.DataFrame({"score": scores(shared.value, found), "ratio": found[:, 0]})

    both = free_name(docs, "_toxicity")
    out = docs.withColumn(both, toxicity(text_bytes())).withColumn(name, F.col(f"{both}.score"))
    if ratio:
        out = out.withColumn(ratio, F.col(f"{both}.ratio"))
    return out.drop(both)


def clean(docs: DataFrame, labels: DataFrame, limit: float = 0.3, **tune) -> DataFrame:
    """docs whose toxicity is below limit, all columns kept, whatever their names.

    Null and empty texts are scored as all others; repeated rows stay or go together; an empty table stays empty.
    """
    name = free_name(docs, "_score")
    return scored(docs, train(docs, labels, **tune), name).where(F.col(name) < limit).drop(name)
