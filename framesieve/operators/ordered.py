"""Ordered scans over ranges: what a row needs to know of the rows before it, without gathering a batch in one task.

Rows are dealt by ranges of their order and stored with their range and their place.  Inside a range a window answers;
what crosses a border travels as boundary records, one per range: its last row, its last break, its sums.  Only those
records meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesieve.sources.shared import stored

#: The bits of a place that number the rows inside a range; those above are the range.
RANGE_BITS = 33


def in_ranges(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """df, stored, with _part (its range) and _seq (its place, which ascends with order over all ranges)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_seq", F.monotonically_increasing_id())
    return stored(ranged.withColumn("_part", F.shiftright("_seq", RANGE_BITS)), tag)


def _inside() -> Window:
    return Window.partitionBy("_part").orderBy("_seq")


def _handed_on(records: DataFrame, value: str, name: str) -> DataFrame:
    """(_part, name): the last value that is not null in the records of earlier ranges."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(records.select("_part", F.last(value, ignorenulls=True).over(before).alias(name)))


def with_before(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (of in_ranges) with _before: a struct of the columns of the row before it, null for the first of all."""
    own = F.struct(*columns)
    ends = df.groupBy("_part").agg(F.max_by(own, "_seq").alias("_end"))
    inside = df.withColumn("_lag", F.lag(own).over(_inside()))
    handed = inside.join(_handed_on(ends, "_end", "_handed"), "_part", "left")
    return handed.withColumn("_before", F.coalesce("_lag", "_handed")).drop("_lag", "_handed")


def with_segments(df: DataFrame, breaks: Column, tag: str) -> DataFrame:
    """df (of in_ranges), stored, with _segment: the _seq of the last row at or before it where breaks holds."""
    marked = df.withColumn("_segment", F.last(F.when(breaks, F.col("_seq")), ignorenulls=True).over(_inside()))
    marked = stored(marked, tag)
    ends = marked.groupBy("_part").agg(F.max("_segment").alias("_end"))
    handed = marked.join(_handed_on(ends, "_end", "_handed"), "_part", "left")
    return handed.withColumn("_segment", F.coalesce("_segment", "_handed")).drop("_handed")


def sums_before(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """rows (group, _seq, value, ...) with the sum of value over the rows of their group that come earlier.

    The records between ranges are one per group and range it reaches into.
    """
    rows = rows.withColumn("_part", F.shiftright("_seq", RANGE_BITS))
    inside = Window.partitionBy("_part", group).orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(group, "_part").agg(F.sum(value).alias("__total"))
    totals = totals.select(group, "_part", F.sum("__total").over(earlier).alias("__earlier"))
    zero = F.lit(0).cast("long")
    found = rows.withColumn("__own", F.sum(value).over(inside)).join(totals, [group, "_part"])
    return found.withColumn(name, F.coalesce("__own", zero) + F.coalesce("__earlier", zero)).drop("__own", "__earlier", "_part")
