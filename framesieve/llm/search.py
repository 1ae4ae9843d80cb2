"""Ranked lexical search over hashed max-sketches.

Index: each text is read once.  A document's sketch has two rows of cells, eight to sixteen times as many as it has terms; a
term falls into one cell of each row, and a cell holds the greatest frequency among its terms, as a one-byte code that
rounds up.  Within a document the impact of a term grows with its frequency only, so the cell stands for the greatest
impact as well.  Beside the documents each task leaves its terms' document frequencies.

Search: items go in blocks.  For a block, one pass over the sketches gives every document an upper bound for each item:
the sum of term weight times the lesser impact of its two cells.  The documents with the highest bounds are scored exactly
from their whole texts, in descending order of bound and in growing portions, until an item's tenth score is above every
bound that is left.  All numbers are integers below 2^53, so bounds never round down.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_ASCII, new_folder, stored, text_bytes
from .tokens import slices

#: A term: digits, ASCII letters and all characters beyond ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

INDEX = "row long, doc_id long, text binary, n long, sketch binary, term binary, df long"
#: Terms whose counts a task holds before it passes them on.
MOST_TERMS = 500_000


def frequency_codes() -> np.ndarray:
    """The frequency that each one-byte code stands for: exact to 128, then growing by a twelfth, the last without end."""
    codes = list(range(129))
    while len(codes) < 255:
        codes.append(max(codes[-1] + 1, codes[-1] * 13 // 12))
    return np.array([*codes, 1 << 40], np.int64)


FREQUENCY = frequency_codes()


#: Cells of a row per distinct term, at least; rows have a power of two of them.
LOAD = 8
LEAST_CELLS = 256


class _Hashes(dict):
    """Two 32-bit hashes of a term, packed in one number; at most MOST_TERMS terms are remembered."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= MOST_TERMS:
            self.clear()
        low = zlib.crc32(term)
        # The second is a mix of the first: independent bits matter for cells, equal pairs do not occur any more often.
        found = low << 32 | (low * 0x9E3779B1 >> 7) & 0xFFFFFFFF
        self[term] = found
        return found


def cells_of(hashes: np.ndarray, width):
    """The cell of each packed hash in the first row and in the second, which lies behind it."""
    return hashes >> 32 & (width - 1), (hashes & 0xFFFFFFFF & (width - 1)) + width


def terms(raw: bytes) -> Counter:
    return Counter(TERM.findall(raw.translate(LOWER_ASCII)))


def _sketches(counted: list[Counter], hashes: _Hashes) -> list[bytes]:
    """The two rows of codes of each document."""
    sizes = np.fromiter(map(len, counted), np.int64, len(counted))
    total = int(sizes.sum())
    packed = np.fromiter((hashes[t] for c in counted for t in c), np.uint64, total).astype(np.int64)
    often = np.fromiter((f for c in counted for f in c.values()), np.int64, total)
    width = np.maximum(LEAST_CELLS, 1 << np.ceil(np.log2(np.maximum(1, LOAD * sizes))).astype(np.int64))
    ends = np.cumsum(2 * width)
    base, wide = np.repeat(ends - 2 * width, sizes), np.repeat(width, sizes)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    codes = np.searchsorted(FREQUENCY, often).astype(np.uint8)
    for cell in cells_of(packed, wide):
        np.maximum.at(flat, base + cell, codes)
    whole = flat.tobytes()
    return [whole[a:b] for a, b in zip((ends - 2 * width).tolist(), ends.tolist())]


def _index():
    def rows(n, row=None, doc=None, text=None, count=None, sketch=None, term=None, df=None):
        none = [None] * n
        return pa.RecordBatch.from_arrays(
            [
                pa.array(none if row is None else row, pa.int64()),
                pa.array(none if doc is None else doc, pa.int64()),
                pa.array(none if text is None else text, pa.binary()),
                pa.array(none if count is None else count, pa.int64()),
                pa.array(none if sketch is None else sketch, pa.binary()),
                pa.array(none if term is None else term, pa.binary()),
                pa.array(none if df is None else df, pa.int64()),
            ],
            [x.split()[0] for x in INDEX.split(", ")],
        )

    def spilled(held: Counter):
        return rows(len(held), term=list(held), df=list(held.values()))

    def run(batches):
        hashes, held = _Hashes(), Counter()
        for batch in batches:
            at = 0
            ids, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for texts in slices(batch.column(2)):
                counted = [terms(t) for t in texts]
                for c in counted:
                    held.update(c.keys())
                    if len(held) >= MOST_TERMS:
                        yield spilled(held)
                        held = Counter()
                sketch = _sketches(counted, hashes)
                end = at + len(texts)
                yield rows(len(texts), ids[at:end], docs[at:end], texts, [c.total() for c in counted], sketch)
                at = end
        if held:
            yield spilled(held)

    return run


def index(docs: DataFrame) -> DataFrame:
    """The stored index of docs: a row per document with its text, number of terms and sketch, and rows of terms' counts.

    docs needs doc_id and text; other columns are left out.  A null text is empty; every row is a document of its own.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    path = new_folder(spark, "search-index")
    # Small row groups: bounds need no texts, scores only some of them.
    written = narrow.mapInArrow(_index(), INDEX).write.option("compression", "zstd")
    written.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def _length_part(n: int, docs: int, total: int) -> int:
    return 100 - 90 + (90 * n * docs) // total


def _bounds(block: list, docs: int, total: int, most: int | None, floor: dict, rows: int = 1024):
    """(item, row, bound) of the documents whose bound reaches the item's floor; with most, the highest of a task only.

    block holds (item, [(term, weight)]).
    """
    hashes = _Hashes()
    wanted = [
        (item, np.array([hashes[t] for t, _ in weighted], np.uint64).astype(np.int64), np.array([w for _, w in weighted], np.float64))
        for item, weighted in block
    ]

    def run(batches):
        best = {}  # item -> bounds and rows so far, the highest first
        places = {}  # width -> cells of each item's terms
        for batch in batches:
            ids, counts = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            sizes = np.asarray(pc.binary_length(batch.column(2))).astype(np.int64)
            order = np.argsort(sizes, kind="stable")
            for size in np.unique(sizes).tolist():
                width = size // 2
                if width not in places:
                    places[width] = [cells_of(h, width) for _, h, _ in wanted]
                chosen = order[np.searchsorted(sizes[order], size) : np.searchsorted(sizes[order], size, "right")]
                step = max(1, min(rows, (64 << 20) // (8 * size)))
                for low in range(0, len(chosen), step):
                    at = chosen[low : low + step]
                    m = np.array([_length_part(x, docs, total) for x in counts[at].tolist()], np.int64)
                    codes = np.frombuffer(b"".join(batch.column(2).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), size)
                    impact = 1_000_000_000 * FREQUENCY[None, :-1] // (1000 * FREQUENCY[None, :-1] + 8 * m[:, None])
                    impact = np.concatenate([impact, np.full((len(at), 1), 1_000_000)], 1).astype(np.float64)
                    spread = np.ascontiguousarray(np.take_along_axis(impact, codes.astype(np.intp), 1).T)
                    found = []
                    for (item, _, weight), (first, second) in zip(wanted, places[width]):
                        bound = weight @ np.minimum(spread[first], spread[second])
                        least = max(1, floor.get(item, 1))
                        if item in best and len(best[item][0]) >= most:
                            least = max(least, best[item][0][-1])
                        hit = np.flatnonzero(bound >= least)
                        if not len(hit):
                            continue
                        now, at_rows = bound[hit], ids[at[hit]]
                        if most is None:
                            found.append((np.full(len(hit), item), at_rows, now))
                            continue
                        if item in best:
                            now, at_rows = np.concatenate([best[item][0], now]), np.concatenate([best[item][1], at_rows])
                        top = np.argsort(-now, kind="stable")[:most]
                        best[item] = now[top], at_rows[top]
                    if found:
                        yield _triples(*zip(*found))
        if best:
            yield _triples(*zip(*((np.full(len(b), item), r, b) for item, (b, r) in best.items())))

    return run


TRIPLES = "item int, row long, value long"


def _triples(items, rows, values):
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(items).astype(np.int32)),
            pa.array(np.concatenate(rows).astype(np.int64)),
            pa.array(np.concatenate(values).astype(np.int64)),
        ],
        ["item", "row", "value"],
    )


def _scores(block: list, docs: int, total: int):
    """(item, row, value): the exact score of each document for each of its items."""
    weights = {item: weighted for item, weighted in block}

    def run(batches):
        for batch in batches:
            out = []
            for row, raw, n, items in zip(*(c.to_pylist() for c in batch.columns)):
                counted = terms(raw)
                m = 8 * _length_part(n, docs, total)
                for item in items:
                    score = 0
                    for term, weight in weights[item]:
                        tf = counted.get(term, 0)
                        if tf:
                            score += weight * (1_000_000_000 * tf // (1000 * tf + m))
                    out.append((item, row, score))
            if out:
                items, rows, values = zip(*out)
                yield _triples([items], [rows], [values])

    return run


def _highest(triples: DataFrame, most: int, *ties) -> DataFrame:
    """The most highest of each item with their rank; tasks pass on only their own highest."""
    order = [F.col("value").desc(), *ties, F.col("row")]
    ranked_rows = triples.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked_rows.where(F.col("rank") <= most)


def _block_results(indexed: DataFrame, block: list, docs: int, total: int, top: int, portions: tuple[int, ...]) -> DataFrame:
    """(item, rank, doc_id, value) for the items of a block."""
    spark = indexed.sparkSession
    rows = indexed.where(F.col("row").isNotNull())
    sketches, texts = rows.select("row", "n", "sketch"), rows.select("row", "text", "n")

    def scored(wanted: DataFrame) -> DataFrame:
        asked = wanted.groupBy("row").agg(F.collect_list("item").alias("items"))
        read = texts.join(asked, "row").select("row", "text", "n", "items")
        return stored(read.mapInArrow(_scores(block, docs, total), TRIPLES), "search-scores")

    def floors(values: DataFrame) -> dict:
        ends = _highest(values.where(F.col("value") > 0), top).where(F.col("rank") == top)
        return {r.item: r.value for r in ends.select("item", "value").collect()}

    def bounds(most: int | None, floor: dict) -> DataFrame:
        return sketches.mapInArrow(_bounds(block, docs, total, most, floor), TRIPLES)

    # The highest bounds of every task, and of these the highest of all, give each item a floor to start with.
    values = scored(_highest(bounds(portions[0], {}), portions[0]))
    floor = floors(values)
    reach = stored(bounds(None, floor), "search-bounds")
    for portion in (*portions[1:], None):  # in descending order of bound; the last portion is all that is left
        least = spark.createDataFrame(list(floor.items()) or [(-1, 0)], "item int, floor long")
        ahead = reach.join(F.broadcast(least), "item", "left").where(F.col("value") >= F.coalesce("floor", F.lit(1)))
        ahead = ahead.join(values.select("item", "row"), ["item", "row"], "left_anti").select("item", "row", "value")
        now = ahead if portion is None else _highest(ahead, portion)
        values = values.unionByName(scored(now))
        if portion is not None:
            floor = floors(values)
    # All that reach the last score in question get their doc_id, which settles ties.
    last = _highest(values.where(F.col("value") > 0), top).groupBy("item").agg(F.min("value").alias("last"))
    able = values.join(last, "item").where(F.col("value") >= F.col("last")).drop("last")
    named = able.join(rows.select("row", "doc_id"), "row")
    return _highest(named, top, F.col("doc_id").asc_nulls_last()).select("item", "rank", "doc_id", "value")


def ranked(
    docs: DataFrame, items: DataFrame, top: int = 10, block_items: int = 1000, portions: tuple[int, ...] = (64, 250, 999)
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the top documents with a score above 0.

    docs needs doc_id and text, items item_id and text; other columns are left out.  Null and empty texts have no terms:
    such documents count nowhere and are never found, such items find nothing.  Every row of docs and every row of items
    stands for itself, repeated ones too; documents without doc_id come last among equal scores.  Empty tables give none.
    A block has about block_items items; what is sent to all tasks is one block's terms and weights.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    indexed = index(docs)
    sizes = indexed.where(F.col("n") > 0).agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
    asked = items.select("item_id", text_bytes().alias("raw")).withColumn("item", F.monotonically_increasing_id())
    blocks = max(1, -(-items.count() // block_items))
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "search-items")
    frequency = stored(indexed.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df")), "search-terms")
    found = []
    for number in range(blocks if sizes.docs else 0):
        held = asked.where(F.col("block") == number).select("item", "raw").collect()
        wanted = [(i, sorted(terms(bytes(r.raw)))) for i, r in enumerate(held)]
        distinct = sorted({t for _, ts in wanted for t in ts})
        if not distinct:
            continue
        asked_terms = spark.createDataFrame([(bytearray(t),) for t in distinct], "term binary")
        dfs = {bytes(r.term): r.df for r in frequency.join(asked_terms, "term").collect()}
        weight = {t: math.floor(1000 * math.log((2 * sizes.docs + 2) / (2 * df + 1))) for t, df in dfs.items()}
        block = [(i, [(t, weight[t]) for t in ts if weight.get(t)]) for i, ts in wanted]
        block = [(i, ts) for i, ts in block if ts]
        if not block:
            continue
        result = _block_results(indexed, block, sizes.docs, sizes.total, top, portions)
        names = spark.createDataFrame([(i, r.item) for i, r in enumerate(held)], "item int, place long")
        named = result.join(F.broadcast(names), "item").drop("item")
        found.append(stored(named.select("place", "rank", "doc_id", F.col("value").alias("score")), "search-found"))
    if not found:
        return empty
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    ids = asked.select(F.col("item").alias("place"), "item_id")
    return whole.join(ids, "place").select("item_id", "rank", "doc_id", "score")
