"""Scenes: runs of frames in capture order that belong together.

A gap beyond the limit always starts a scene and resets everything the walk carries, so such gaps cut a batch into
segments that are walked on their own.  Inside a segment a scene also ends where the picture differs too much from the
scene's first frame, or where it is full.  Gaps, segments and numbers come from scans over ranges, so a batch of any size
spreads over all tasks; what one task walks in order is a segment.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesieve.config import GroupConfig
from framesieve.operators.ordered import in_ranges, sums_before, with_before, with_segments


def capture_order() -> list[Column]:
    """Timed frames by time and name, then untimed ones by name; input_order settles the rest."""
    return [F.col("capture_time").isNull(), F.col("capture_time"), F.col("name"), F.col("input_order")]


def hamming(a, b) -> Column:
    """Differing bits of two 64-bit patterns held as longs."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _gaps(ranged: DataFrame) -> DataFrame:
    """Frames in ranges with gap and _first, which marks the first frame of a batch."""
    df = with_before(ranged, ["batch_id", "capture_time"])
    same = F.coalesce(F.col("_before.batch_id") == F.col("batch_id"), F.lit(False))
    # Microseconds, so that the difference is exact before it becomes seconds.
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    gap = F.when(same, (micros(F.col("capture_time")) - micros(F.col("_before.capture_time"))) / 1e6)
    return df.withColumn("gap", gap).withColumn("_first", ~same).drop("_before")


def _ranged(frames: DataFrame) -> DataFrame:
    return in_ranges(frames, [F.col("batch_id"), *capture_order()], "frame-ranges")


def gaps(frames: DataFrame) -> DataFrame:
    """frames with gap: seconds since the frame before in the batch, null if either has no time."""
    return _gaps(_ranged(frames)).drop("_seq", "_part", "_first")


def _walk(c: GroupConfig):
    """Walks rows that come sorted by segment and place; what it carries is one scene's state."""

    def walk(frames):
        at, scene, size, anchor = None, 0, 0, None
        for rows in frames:
            out = []
            for segment, known, hashed, mark in zip(rows["_segment"], rows["known"], rows["hashed"], rows["dhash"]):
                mark = int(mark) & 0xFFFFFFFFFFFFFFFF if hashed else None
                if segment != at:  # a hard break: everything starts anew
                    at, scene, size, anchor = segment, 0, 0, mark
                else:
                    apart = (mark ^ anchor).bit_count() if mark is not None and anchor is not None else 0
                    limit = c.scene_change_distance if known else c.no_time_hash_distance
                    if apart > limit or size >= c.max_group_size:
                        scene, size, anchor = scene + 1, 0, mark
                size += 1
                out.append(scene)
            yield rows[["batch_id", "_segment", "_seq"]].assign(scene=pd.Series(out, index=rows.index, dtype="int32"))

    return walk


def _hard(c: GroupConfig) -> Column:
    return F.col("_first") | F.coalesce(F.col("gap") > c.time_gap_seconds, F.lit(False))


def with_scenes(frames: DataFrame, config: GroupConfig | None = None) -> DataFrame:
    """frames with group_id, numbered from 0 in capture order within each batch.

    frames needs batch_id, capture_time, name, input_order and dhash.
    """
    c = config or GroupConfig()
    ranged = _ranged(frames)
    # A missing hash travels as a flag: pandas would turn a nullable long into a double and lose its low bits.
    mark = F.coalesce("dhash", F.lit(0).cast("long")).alias("dhash")
    narrow = _gaps(ranged.select("batch_id", "_seq", "_part", "capture_time", F.col("dhash").isNotNull().alias("hashed"), mark))
    narrow = with_segments(narrow.withColumn("known", F.col("gap").isNotNull()), _hard(c), "scene-segments")
    narrow = narrow.select("batch_id", "_segment", "_seq", "known", "hashed", "dhash")
    dealt = narrow.repartition("_segment").sortWithinPartitions("_segment", "_seq")
    walked = dealt.mapInPandas(_walk(c), "batch_id string, _segment long, _seq long, scene int")
    counts = walked.groupBy("batch_id", "_segment").agg((F.max("scene") + 1).alias("n"))
    based = sums_before(counts.withColumn("_seq", F.col("_segment")), "batch_id", "n", "base")
    numbered = walked.join(based.select("_segment", "base"), "_segment").select(
        "_seq", (F.col("base") + F.col("scene")).cast("int").alias("group_id")
    )
    return ranged.join(numbered, "_seq").drop("_seq", "_part")


def scenes_by_time(frames: DataFrame, config: GroupConfig | None = None) -> DataFrame:
    """frames with group_id from time gaps alone: no Python."""
    df = _gaps(_ranged(frames))
    hard = F.when(_hard(config or GroupConfig()), 1).otherwise(0)
    before = sums_before(df.withColumn("_hard", hard), "batch_id", "_hard", "_base")
    number = (F.col("_base") + F.col("_hard") - 1).cast("int")
    return before.withColumn("group_id", number).drop("gap", "_first", "_seq", "_hard", "_base")


def scene_sizes(frames: DataFrame) -> DataFrame:
    """(batch_id, group_id, frames) of every scene; frames without a scene are left out."""
    named = frames.where(F.col("group_id").isNotNull())
    return named.groupBy("batch_id", "group_id").agg(F.count("*").alias("frames"))


def scene_count(frames: DataFrame) -> DataFrame:
    return frames.groupBy("batch_id").agg(F.count_distinct("group_id").alias("scenes"))
