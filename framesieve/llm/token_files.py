"""Token-id files: documents in ascending doc_id order, each shard under its own Re-Pair grammar.

One range partitioning by doc_id puts the documents in order; each task tokenises its range, compresses it in shards of a
bounded number of ids and writes them into files of its own.  The rows a task returns (one per shard) are the manifest,
stored once.  The offset of a shard among all ids is a prefix sum over that manifest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repair, storage
from .common import exclusive_prefix, new_folder, stored, text_bytes
from .tokens import encoder, slices

MANIFEST = "part int, shard int, file string, at long, size long, n_docs long, n_ids long"
#: Distinct chunks whose ids a worker keeps: rare words fill a smaller table within some 25 MB of text, and are learnt anew.
MOST_CHUNKS = 1_000_000
#: Shards that one task reads back; starting it costs about as much as decoding one.
SHARDS_A_TASK = 8
READ = "doc_id long, start long, n_tokens long, ids binary"


def _write(path: str, byte_level: bool, end_id: int, first: int, folder: str, shard_ids: int, file_bytes: int):
    def run(batches):
        coder = encoder(path, byte_level, MOST_CHUNKS)
        end = np.array([end_id], coder.kind).tobytes()
        part, shard = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # (key, ids) of the shard being filled
        filled, out, uri, at = 0, None, "", 0

        def flush():
            nonlocal held, filled, out, uri, at, shard
            ids = np.frombuffer(b"".join(x for _, x in held), coder.kind)
            counts = np.array([len(x) // coder.kind.itemsize for _, x in held], np.int64)
            keys = np.array([k or 0 for k, _ in held], np.int64)
            known = np.array([k is not None for k, _ in held])
            raw = repair.encode_shard(ids, counts, keys, known, first)
            if out is not None and at + len(raw) > file_bytes:
                out.close()
                out = None
            if out is None:
                (out, uri), at = storage.create(folder, f"ids-{part:06d}"), 0
            out.write(raw)
            row = (part, shard, uri, at, len(raw), len(held), len(ids))
            held, filled, at, shard = [], 0, at + len(raw), shard + 1
            return row

        rows = []
        for batch in batches:
            keys, n = batch.column(0), 0
            for texts in slices(batch.column(1)):
                for ids in coder.encode(texts):
                    held.append((keys[n].as_py(), ids + end))
                    filled += len(held[-1][1]) // coder.kind.itemsize
                    n += 1
                    if filled >= shard_ids:
                        rows.append(flush())
        if held:
            rows.append(flush())
        if out is not None:
            out.close()
        kinds = [pa.int32(), pa.int32(), pa.string()] + [pa.int64()] * 4
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        columns = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names)

    return run


def write(
    docs: DataFrame,
    path: str,
    end_id: int,
    byte_level: bool = True,
    shard_ids: int = 1 << 20,
    file_bytes: int = 1 << 28,
) -> DataFrame:
    """Write the ids of docs and return the stored manifest, one row per shard.

    docs needs doc_id and text; other columns are left out.  Null texts count as empty; a null doc_id comes first; rows
    with equal ids stand next to each other in the order of their texts' hashes.  An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw"))
        .withColumn("tie", F.xxhash64("raw"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "raw")
    )
    first = encoder(path, byte_level, MOST_CHUNKS).tokenizer.get_vocab_size()
    run = _write(path, byte_level, end_id, first, new_folder(spark, "token-files"), shard_ids, file_bytes)
    return stored(ranged.mapInArrow(run, MANIFEST), "token-manifest")


def _read(batches, most_docs: int = 2000, most_ids: int = 1 << 18):
    """Decodes each shard by ranges of documents, each from the blocks that hold it."""
    for batch in batches:
        for row in batch.to_pylist():
            with storage.open_file(row["file"]) as f:
                f.seek(row["at"])
                shard = repair.Shard(f.read(row["size"]))
            ends = np.cumsum(shard.counts)
            starts = ends - shard.counts
            low = 0
            while low < len(ends):
                high = int(np.searchsorted(ends, starts[low] + most_ids, "right"))
                high = max(low + 1, min(high, low + most_docs))
                part = slice(low, high)
                begin = int(starts[low])
                ids = shard.decode(begin, int(ends[high - 1]) - begin).astype("<u4", copy=False)
                cells = [ids[a:b].tobytes() for a, b in zip((starts[part] - begin).tolist(), (ends[part] - begin).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.keys[part], mask=shard.known[part] == 0),
                        pa.array(row["base"] + starts[part]),
                        pa.array(shard.counts[part]),
                        pa.array(cells, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )
                low = high


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the files: its ids (little-endian, 32 bits each) and the ids before it in all files.

    manifest is what write() returned; an empty one gives no row, a null doc_id comes back null, repeated rows repeated.
    """
    # One row per shard of about a million ids, so the window over all of them is small.
    based = exclusive_prefix(manifest, ["part", "shard"], "n_ids", "base")
    # Rows are few and what they name is large, so their number sets the number of tasks: a few shards each, as soon as
    # there are enough for all cores several times over.
    shards = manifest.count()
    tasks = max(1, min(shards, max(-(-shards // SHARDS_A_TASK), 4 * manifest.sparkSession.sparkContext.defaultParallelism), 20_000))
    return based.repartition(tasks, "file", "at").mapInArrow(_read, READ)
