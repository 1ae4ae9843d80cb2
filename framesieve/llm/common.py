"""Helpers that several of the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte table that lower-cases A-Z and leaves all else.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: What separates words: space and the five ASCII controls from tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-framesieve-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """df written once as Parquet in the shared folder and read again: lost executors can't undo it, and its lineage ends here."""
    path = new_folder(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """A string column as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as keep it apart from the columns of df, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(df: DataFrame, keys: list[str], rows: int, total: int) -> DataFrame:
    """About rows of the total rows of df: those whose keys hash lowest.  Each task passes on only its share of them.

    No more than twice as many come out where keys repeat.
    """
    if total <= rows:
        return df
    bound = int((1 << 64) * rows / total) - (1 << 63)
    return df.where(F.xxhash64(*keys) < F.lit(bound)).limit(2 * rows)


def exclusive_prefix(totals: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """totals with the sum of value over all earlier rows.

    For tables with one row per partition or file only: the window has no key, so its rows meet in one task.
    """
    from pyspark.sql import Window

    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))
