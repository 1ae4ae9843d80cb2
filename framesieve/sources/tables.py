"""Frame tables derived from the given tables: events are the frames, embeddings their hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, dhash): the signs of the first 64 numbers, the first one as the highest bit."""
    bits = F.transform(
        F.slice("embedding", 1, 64),
        lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), 63 - i)).otherwise(
            F.lit(0).cast("long")
        ),
    )
    one = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return table(spark, sf_dir, "embeddings").select("vec_id", one.alias("dhash"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per photo; a batch is a day."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.col("ts").cast("timestamp_ntz").alias("ts"))
    n = F.col("event_id")
    faces = n % 4
    with_face = F.element_at(F.array(*map(F.lit, ["eye", "face", "af", "tile", "frame"])), (n % 5 + 1).cast("int"))
    without = F.when(n % 2 == 0, "tile").otherwise("frame")
    suffix = F.element_at(F.array(*map(F.lit, [".ARW", ".CR3", ".NEF", ".JPG", ".HIF"])), (n % 5 + 1).cast("int"))
    hour = F.hour("ts")
    stray = F.when(n % 53 == 0, 0.5).otherwise(0.0)
    lat = F.lit(37.5) + 0.01 * (F.floor(hour / 4) % 3).cast("double") + 0.0001 * (n % 10).cast("double") + stray
    no_place = n % 6 == 0
    df = e.select(
        F.date_format("ts", "yyyyMMdd").alias("batch_id"),
        n.alias("input_order"),
        F.concat(F.lit("DSC"), F.lpad(n.cast("string"), 7, "0"), suffix).alias("name"),
        F.when(n % 101 == 0, "decode").alias("error"),
        F.when(n % 97 != 0, F.col("ts")).alias("capture_time"),
        F.least(F.lit(100.0), F.lit(40.0) + F.col("value") / 4).alias("sharpness"),
        (F.lit(30.0) + ((n * 7919) % 700) / 10).alias("frame_sharpness"),
        F.when(faces > 0, with_face).otherwise(without).alias("source"),
        faces.cast("int").alias("face_count"),
        ((n % 50) / 49).alias("face_confidence"),
        ((n % 61) / 1000).alias("face_area_ratio"),
        (((n * 31) % 1000) / 10).alias("background_sharpness"),
        ((n * 13) % 256).cast("double").alias("mean_luma"),
        ((n % 40) / 100).alias("clipped_highlights"),
        ((n % 70) / 100).alias("clipped_shadows"),
        F.when((faces == 0) | (n % 7 == 0), -1.0).otherwise((n % 45) / 100).alias("eyes_open"),
        F.when(no_place, None).otherwise(lat).alias("latitude"),
        F.when(no_place, None).otherwise(F.lit(127.0) + 0.0001 * (n % 7).cast("double")).alias("longitude"),
        F.when(n % 89 != 0, n % 500).alias("_vec"),
    )
    h = hashes(spark, sf_dir)
    return (
        df.join(h, df["_vec"] == h["vec_id"], "left")
        .drop("_vec", "vec_id")
        .withColumn("path", F.concat(F.lit("/shoot/"), "batch_id", F.lit("/"), "name"))
    )


#: The same tables for DuckDB; hashes as two 32-bit halves.
FRAMES_SQL = """
hashes AS (
  SELECT vec_id,
    list_sum([CASE WHEN embedding[i] > 0 THEN CAST(2 AS BIGINT) ** (32 - i) ELSE 0 END FOR i IN range(1, 33)])::BIGINT AS h1,
    list_sum([CASE WHEN embedding[i + 32] > 0 THEN CAST(2 AS BIGINT) ** (32 - i) ELSE 0 END FOR i IN range(1, 33)])::BIGINT AS h2
  FROM embeddings),
frames AS (
  SELECT strftime(ts, '%Y%m%d') AS batch_id, event_id AS input_order,
    'DSC' || lpad(CAST(event_id AS VARCHAR), 7, '0') || (['.ARW', '.CR3', '.NEF', '.JPG', '.HIF'])[event_id % 5 + 1] AS name,
    CASE WHEN event_id % 101 = 0 THEN 'decode' END AS error,
    CASE WHEN event_id % 97 <> 0 THEN ts END AS capture_time,
    least(100.0::DOUBLE, 40.0::DOUBLE + value / 4) AS sharpness,
    30.0::DOUBLE + ((event_id * 7919) % 700)::DOUBLE / 10 AS frame_sharpness,
    CASE WHEN event_id % 4 > 0 THEN (['eye', 'face', 'af', 'tile', 'frame'])[event_id % 5 + 1]
         WHEN event_id % 2 = 0 THEN 'tile' ELSE 'frame' END AS source,
    CAST(event_id % 4 AS INTEGER) AS face_count,
    (event_id % 50)::DOUBLE / 49 AS face_confidence, (event_id % 61)::DOUBLE / 1000 AS face_area_ratio,
    ((event_id * 31) % 1000)::DOUBLE / 10 AS background_sharpness, ((event_id * 13) % 256)::DOUBLE AS mean_luma,
    (event_id % 40)::DOUBLE / 100 AS clipped_highlights, (event_id % 70)::DOUBLE / 100 AS clipped_shadows,
    CASE WHEN event_id % 4 = 0 OR event_id % 7 = 0 THEN -1.0::DOUBLE ELSE (event_id % 45)::DOUBLE / 100 END AS eyes_open,
    CASE WHEN event_id % 6 <> 0 THEN 37.5::DOUBLE + 0.01::DOUBLE * ((hour(ts) // 4) % 3)::DOUBLE
      + 0.0001::DOUBLE * (event_id % 10)::DOUBLE + CASE WHEN event_id % 53 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS latitude,
    CASE WHEN event_id % 6 <> 0 THEN 127.0::DOUBLE + 0.0001::DOUBLE * (event_id % 7)::DOUBLE END AS longitude,
    h1, h2, '/shoot/' || strftime(ts, '%Y%m%d') || '/DSC' || lpad(CAST(event_id AS VARCHAR), 7, '0')
      || (['.ARW', '.CR3', '.NEF', '.JPG', '.HIF'])[event_id % 5 + 1] AS path
  FROM events LEFT JOIN hashes ON vec_id = CASE WHEN event_id % 89 <> 0 THEN event_id % 500 END)
"""
