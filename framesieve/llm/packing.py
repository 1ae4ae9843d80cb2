"""Packing: concatenate and cut.

Pass 1 tokenises each partition once and stores, per document, its ids and the ids before it in that partition.  One row
per partition then gives the global offset of each partition (a prefix sum of totals).  Pass 2 is a map over the stored
ids: the stream of all ids is cut at every multiple of the sequence length, and a document that crosses a cut yields one
boundary record per sequence it touches.  No row of the corpus is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exclusive_prefix, stored, text_bytes
from .tokens import encoder, slices

TOKENIZED = "part int, before long, doc_id long, n_ids long, ids binary"
PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "continues boolean, piece_ids binary"
)


def _tokenise(path: str, byte_level: bool, end_id: int):
    def run(batches):
        coder = encoder(path, byte_level)
        end = np.array([end_id], coder.kind).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, at = batch.column(0), 0
            for texts in slices(batch.column(1)):
                ids = [x + end for x in coder.encode(texts)]
                counts = np.array([len(x) // coder.kind.itemsize for x in ids], np.int64)
                starts = before + np.concatenate(([0], np.cumsum(counts)[:-1]))
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(starts),
                        keys.slice(at, len(ids)),
                        pa.array(counts),
                        pa.array(ids, pa.binary()),
                    ],
                    ["part", "before", "doc_id", "n_ids", "ids"],
                )
                at += len(ids)

    return run


def tokenised(docs: DataFrame, path: str, end_id: int, byte_level: bool = False) -> DataFrame:
    """Per document its ids (with end_id) and its place in its partition, stored in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw"))
    return stored(rows.mapInArrow(_tokenise(path, byte_level, end_id), TOKENIZED), "packing-ids")


def _pieces(out: list[list]):
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)


def _cut(width: int, item: int, most_ids: int = 1_000_000):
    """Pieces of each row; a batch goes out when it holds most_ids, or after the row that reaches them."""

    def run(batches):
        out, held = [[] for _ in range(8)], 0
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3))
            for doc, first, count, cell in rows:
                ids = np.frombuffer(cell.as_py(), f"<u{item}").astype("<u4")
                at = 0
                while at < count:
                    sequence, offset = divmod(first + at, width)
                    take = min(width - offset, count - at)
                    piece = (doc, at, take, count, sequence, offset, at + take < count, ids[at : at + take].tobytes())
                    for column, value in zip(out, piece):
                        column.append(value)
                    at += take
                held += count
                if held >= most_ids:
                    yield _pieces(out)
                    out, held = [[] for _ in range(8)], 0
        yield _pieces(out)

    return run


def pack(docs: DataFrame, path: str, width: int = 2048, end_id: int = 1, byte_level: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of width ids; only the last sequence has room left.

    docs needs doc_id and text; other columns, of whatever name, are left out.  A null or empty text is one piece that
    holds end_id alone.  Repeated rows are packed once each; a null doc_id stays null.  An empty table gives no piece.
    piece_ids are little-endian unsigned 32-bit integers; continues marks a piece whose document goes on in the next
    sequence.
    """
    ids = tokenised(docs, path, end_id, byte_level)
    # One row per input partition: a few thousand of these fit any driver, whatever the rows behind them.
    totals = ids.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("total"))
    bases = exclusive_prefix(totals, ["part"], "total", "base").select("part", "base")
    placed = ids.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("first"), "n_ids", "ids"
    )
    item = 2 if _small(path, byte_level) else 4
    return placed.mapInArrow(_cut(width, item), PIECES)


def _small(path: str, byte_level: bool) -> bool:
    return encoder(path, byte_level).kind.itemsize == 2
