"""Places: runs of located frames around a moving centre.

Frames in time order join the current cluster while they lie within the radius of its centre, which then moves by the
running mean.  A jump of more than twice the radius between neighbours always starts a cluster, so such jumps cut a batch
into segments that are walked on their own.  Jumps, segments and numbers come from scans over ranges, so a batch of any size
spreads over all tasks.  Longitudes are averaged as numbers, so a place on the date line is not found.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesieve.operators.numbers import fixed
from framesieve.operators.ordered import in_ranges, sums_before, with_before, with_segments

EARTH_METRES = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0)
    )
    return F.lit(2 * EARTH_METRES) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _metres(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    a += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_METRES * math.asin(min(1.0, math.sqrt(a)))


def _walk(radius: float):
    """Walks rows that come sorted by segment and place; what it carries is one cluster's centre."""

    def walk(frames):
        at, start, n, lat, lon = None, 0, 0, 0.0, 0.0
        for rows in frames:
            starts = []
            for segment, seq, y, x in zip(rows["_segment"], rows["_seq"], rows["latitude"], rows["longitude"]):
                if segment != at:
                    at, n = segment, 0
                elif _metres(lat, lon, y, x) > radius:
                    n = 0
                if not n:
                    start, lat, lon = seq, 0.0, 0.0
                n += 1
                lat, lon = lat + (y - lat) / n, lon + (x - lon) / n
                starts.append(start)
            yield rows[["batch_id", "_seq"]].assign(cluster=pd.Series(starts, index=rows.index, dtype="int64"))

    return walk


def with_places(frames: DataFrame, radius: float = 250.0, min_cluster: int = 2) -> DataFrame:
    """frames with place_id from 1 in the order of time; null for frames without a position or in a smaller cluster.

    A cluster is named by the place of its first frame, so clusters are numbered by counting those that begin earlier.
    """
    order = [F.col("batch_id"), F.col("capture_time").asc_nulls_first(), F.col("name"), F.col("input_order")]
    located = frames.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    located = located.select("batch_id", "path", "capture_time", "name", "input_order", "latitude", "longitude")
    ranged = in_ranges(located, order, "place-ranges").drop("capture_time", "name", "input_order")
    df = with_before(ranged, ["batch_id", "latitude", "longitude"])
    same = F.coalesce(F.col("_before.batch_id") == F.col("batch_id"), F.lit(False))
    jump = haversine(F.col("_before.latitude"), F.col("_before.longitude"), F.col("latitude"), F.col("longitude"))
    cut = with_segments(df.withColumn("_hard", ~same | (jump > 2.02 * radius)).drop("_before"), F.col("_hard"), "place-segments")
    narrow = cut.select("batch_id", "_segment", "_seq", "latitude", "longitude")
    dealt = narrow.repartition("_segment").sortWithinPartitions("_segment", "_seq")
    walked = dealt.mapInPandas(_walk(radius), "batch_id string, _seq long, cluster long")
    sizes = walked.groupBy("batch_id", "cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_cluster)
    sizes = sizes.select("batch_id", F.col("cluster").alias("_seq"), F.lit(1).alias("one"))
    named = sums_before(sizes, "batch_id", "one", "earlier").select(
        F.col("_seq").alias("cluster"), (F.col("earlier") + 1).cast("int").alias("place_id")
    )
    found = walked.join(named, "cluster").select("_seq", "place_id")
    found = found.join(ranged.select("_seq", "batch_id", "path"), "_seq").select("batch_id", "path", "place_id")
    return frames.join(found, ["batch_id", "path"], "left")


def places(frames: DataFrame) -> DataFrame:
    """(batch_id, place_id, latitude, longitude, n, label) of every place.

    Means come from sums in decimals of nine places, so that neither order nor partitions move a label's last digit.
    """
    mean = lambda c: F.sum(F.col(c).cast("decimal(12,9)")).cast("double") / F.count("*")
    found = frames.where(F.col("place_id").isNotNull()).groupBy("batch_id", "place_id").agg(
        mean("latitude").alias("latitude"), mean("longitude").alias("longitude"), F.count("*").alias("n")
    )
    return found.withColumn("label", label(F.col("place_id"), F.col("latitude"), F.col("longitude")))


def label(number: Column, lat: Column, lon: Column) -> Column:
    """Two-digit number, then the position to four places with its hemisphere."""
    ns, ew = F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W")
    position = F.concat(fixed(F.abs(lat), 4), ns, F.lit("_"), fixed(F.abs(lon), 4), ew)
    return F.concat(F.format_string("%02d", number), F.lit("_"), position)


def coverage(frames: DataFrame) -> DataFrame:
    """(batch_id, places, located, total)."""
    return frames.groupBy("batch_id").agg(
        F.count_distinct("place_id").alias("places"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("located"),
        F.count("*").alias("total"),
    )
