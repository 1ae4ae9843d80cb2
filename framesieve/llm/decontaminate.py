"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of a fixed number of words; a document contains a window if all the window's shingles
stand in it in place, so by the prefix principle for containment 1 the window's rarest shingle must be among the
document's shingles.  Rarity is counted over all documents.  A document's shingles meet the windows' prefix shingles in a
join; the place of the shingle in the window gives the one possible start, which must leave room for the window on both
sides, and the window's words are then compared in full with the words around the shingle.

Both sides may grow.  What is sent to all tasks is a bit map of BITS bits over shingle hashes, whatever the benchmark: it
keeps shingles that no window has from being shuffled, and lets through what it must.  Documents are read twice, for the
rarity and for the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import stored, text_bytes

#: Every byte that is no word byte becomes a blank; A-Z become a-z; bytes of other scripts stay.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
BITS = 1 << 22

WINDOWS = "item long, window string, width int, gram long, place int, size int"
FOUND = "row long, doc_id long, n_words long, near array<struct<gram:bigint,at:int,low:int,words:string>>"
HITS = "row long, spans array<struct<start:int,end:int>>, items array<long>"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], width: int) -> list[list[bytes]]:
    """All windows of width words; of fewer words, the one window they are."""
    if not words:
        return []
    return [words[i : i + width] for i in range(max(1, len(words) - width + 1))]


def grams_of(words: list[bytes], size: int) -> np.ndarray:
    """The hashes of all shingles of size words, as signed longs."""
    if len(words) < size:
        return np.zeros(0, np.int64)
    own = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ own[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _places(grams: np.ndarray) -> np.ndarray:
    """The bit of each shingle in a map."""
    return (grams.view(np.uint64) >> np.uint64(42)).astype(np.int64)


# -- the benchmark's side ----------------------------------------------------------------------------------------------


def _cut(width: int, shingle: int):
    def run(batches):
        for batch in batches:
            for item, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                words = words_of(cell.as_py() or b"")
                size = min(shingle, width, len(words))
                grams = grams_of(words, size).tolist() if words else []
                for start, window in enumerate(windows_of(words, width)):
                    text, wide = b" ".join(window).decode("utf-8", "replace"), len(window)
                    rows += [(item, text, wide, grams[start + k], k, size) for k in range(wide - size + 1)]
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in WINDOWS.split(", ")]
                )

    return run


def _bit_map(grams: DataFrame) -> np.ndarray:
    """The places of grams as a map of BITS bits; what reaches the driver is a number per bit at most."""
    bit = F.shiftrightunsigned("gram", 42).alias("bit")
    out = np.zeros(BITS, bool)
    out[grams.select(bit).distinct().toPandas()["bit"].to_numpy().astype(np.int64)] = True
    return np.packbits(out)


# -- the documents' side -----------------------------------------------------------------------------------------------


def _count(sizes: list[int], shared):
    """Per task the number of documents that hold each shingle that the map lets through."""

    def summed(held):
        grams, counts = (np.concatenate(x) for x in zip(*held))
        grams, at = np.unique(grams, return_inverse=True)
        return grams, np.bincount(at, counts).astype(np.int64)

    def run(batches):
        bits = np.unpackbits(shared.value).view(bool)
        held, size = [], 0
        for batch in batches:
            for cell in batch.column(0):
                words = words_of(cell.as_py() or b"")
                for k in sizes:
                    grams = grams_of(words, k)
                    grams = np.unique(grams[bits[_places(grams)]])
                    if len(grams):
                        held.append((grams, np.ones(len(grams), np.int64)))
                        size += len(grams)
            if size > 1_000_000:
                held = [summed(held)]
                size = len(held[0][0])
        grams, counts = summed(held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], ["gram", "n"])

    return run


def _probe(sizes: list[int], width: int, shared, most_rows: int = 1000):
    """Per document its row number, words, and the shingles that the map lets through with the words around them."""
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("words", pa.string())]))

    def run(batches):
        bits = np.unpackbits(shared.value).view(bool)
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for low in range(0, whole.num_rows, most_rows):
                batch = whole.slice(low, most_rows)
                counts, near = [], []
                for cell in batch.column(1):
                    words = words_of(cell.as_py() or b"")
                    found = []
                    for k in sizes:
                        grams = grams_of(words, k)
                        for at in np.flatnonzero(bits[_places(grams)]).tolist():
                            first = max(0, at + k - width)
                            around = b" ".join(words[first : at + width]).decode("utf-8", "replace")
                            found.append({"gram": int(grams[at]), "at": at, "low": first, "words": around})
                    counts.append(len(words))
                    near.append(found)
                rows = pa.array(range(row, row + len(counts)), pa.int64())
                row += len(counts)
                yield pa.RecordBatch.from_arrays(
                    [rows, batch.column(0), pa.array(counts, pa.int64()), pa.array(near, kind)],
                    ["row", "doc_id", "n_words", "near"],
                )

    return run


def joined(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _unite(batches):
    """Takes (row, start, end, item) sorted by row; one row comes out for each, its overlapping spans joined."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def made(rows):
        spans = [[{"start": a, "end": b} for a, b in joined(s)] for _, s, _ in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([r for r, _, _ in rows], pa.int64()), pa.array(spans, span), pa.array([sorted(i) for _, _, i in rows], pa.list_(pa.int64()))],
            ["row", "spans", "items"],
        )

    here, spans, items, out = None, set(), set(), []
    for batch in batches:
        for row, start, end, item in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if row != here:
                if here is not None:
                    out.append((here, spans, items))
                    if len(out) >= 1000:
                        yield made(out)
                        out = []
                here, spans, items = row, set(), set()
            spans.add((start, end))
            items.add(item)
    if here is not None:
        out.append((here, spans, items))
    yield made(out)


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, shingle: int = 3) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of docs: the word spans [start, end) that windows cover.

    docs needs doc_id and text, benchmark item_id and text; other columns are left out.  A null or empty text has no
    words; an item without words or without item_id has no window; items that share an item_id count as one item.  An
    empty benchmark hits nothing.  Every row of docs comes back by itself, those without doc_id and those that repeat too.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item"), text_bytes().alias("raw"))
    windows = stored(items.mapInArrow(_cut(width, shingle), WINDOWS), "benchmark-windows")
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # 1 to shingle
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw"))

    grams = windows.select("gram").distinct()
    every = spark.sparkContext.broadcast(_bit_map(grams))
    counted = rows.select("raw").mapInArrow(_count(sizes, every), "gram long, n long")
    rarity = counted.join(grams, "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n"))
    weighed = windows.select("window", "width", "gram", "place").distinct().join(rarity, "gram", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "place"))
    prefixes = weighed.groupBy("window", "width").agg(rarest.alias("p")).select("window", "width", "p.gram", "p.place")
    prefixes = stored(prefixes, "benchmark-prefixes")

    wanted = spark.sparkContext.broadcast(_bit_map(prefixes))
    found = stored(rows.mapInArrow(_probe(sizes, width, wanted), FOUND), "decontamination-probes")
    near = found.where(F.size("near") > 0).select("row", "n_words", F.explode("near").alias("x")).select("row", "n_words", "x.*")
    start = F.col("at") - F.col("place")
    met = near.join(prefixes, "gram").where((start >= 0) & (start + F.col("width") <= F.col("n_words")))
    same = F.array_join(F.slice(F.split("words", " "), start - F.col("low") + 1, F.col("width")), " ") == F.col("window")
    met = met.where(same).select("row", start.alias("start"), (start + F.col("width")).alias("end"), "window")
    named = met.join(windows.select("window", "item").distinct(), "window").select("row", "start", "end", "item")
    united = named.repartition("row").sortWithinPartitions("row").mapInArrow(_unite, HITS)
    none = (F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<bigint>"))
    return found.select("row", "doc_id", "n_words").join(united, "row", "left").select(
        "doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, **tune) -> DataFrame:
    """hits() with n_hit (words that windows cover), n_items and contaminated (n_hit > 0)."""
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = hits(docs, benchmark, width, **tune).withColumn("n_hit", covered)
    return found.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, **tune) -> DataFrame:
    """docs without the contaminated ones, all columns kept.  A row without doc_id stays."""
    found = contamination(docs, benchmark, width, **tune).where("contaminated")
    gone = found.select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")
