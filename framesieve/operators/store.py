"""The analysis store: measurements kept by file fingerprint and parameters, so that only what changed is measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINGERPRINT = ["path", "mtime", "size"]


def latest(store: DataFrame) -> DataFrame:
    """One row per path: the last one written, whatever its parameters."""
    w = Window.partitionBy("path").orderBy(F.desc("written_at"))
    return store.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def valid(store: DataFrame, params_key: str, schema_version: int) -> DataFrame:
    return latest(store).where((F.col("params_key") == params_key) & (F.col("schema_version") == schema_version))


def hits(inventory: DataFrame, store: DataFrame, params_key: str, schema_version: int) -> DataFrame:
    """Files whose stored measurements still hold, in the order of the inventory's input_order."""
    kept = valid(store, params_key, schema_version).drop("params_key", "schema_version", "written_at")
    return inventory.join(kept, FINGERPRINT)


def pending(inventory: DataFrame, store: DataFrame, params_key: str, schema_version: int) -> DataFrame:
    """Files to measure: new ones, changed ones, and those measured under other parameters."""
    return inventory.join(valid(store, params_key, schema_version).select(FINGERPRINT), FINGERPRINT, "left_anti")


def count_ready(inventory: DataFrame, store: DataFrame, params_key: str, schema_version: int) -> DataFrame:
    """(ready): how many files need no measuring; reads fingerprints only."""
    kept = valid(store, params_key, schema_version).select(FINGERPRINT)
    return inventory.select(FINGERPRINT).join(kept, FINGERPRINT, "left_semi").agg(F.count("*").alias("ready"))


def upsert(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store after fresh rows are written: one row per path, the newest."""
    return latest(store.unionByName(fresh))


def gathered(inventory: DataFrame, store: DataFrame, fresh: DataFrame, params_key: str, schema_version: int) -> DataFrame:
    """Stored and fresh measurements of the inventory together."""
    known = hits(inventory, store, params_key, schema_version)
    return known.unionByName(inventory.join(fresh, FINGERPRINT).select(known.columns))


def statistics(store: DataFrame) -> DataFrame:
    """(entries, failed, bytes) by params_key."""
    return store.groupBy("params_key").agg(
        F.count("*").alias("entries"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("size").alias("bytes")
    )


def progress(inventory: DataFrame, store: DataFrame, results: DataFrame, params_key: str, schema_version: int) -> DataFrame:
    """(done, total, cached, failed) after a run."""
    ready = hits(inventory, store, params_key, schema_version).select("path", F.lit(1).alias("_cached"))
    df = inventory.select("path").join(ready, "path", "left").join(results.select("path", F.lit(1).alias("_done"), "error"), "path", "left")
    return df.agg(
        F.count("_done").alias("done"),
        F.count("*").alias("total"),
        F.count("_cached").alias("cached"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def invalidated(store: DataFrame, schema_version: int) -> DataFrame:
    """The store without rows of another schema."""
    return store.where(F.col("schema_version") == schema_version)


#: The files of a store's folder by kind: measurements, previews, and the logs that undoing needs.
_KINDS = {"analysis": r"^(.*)/analysis/[^/]+$", "thumbnail": r"^(.*)/thumbs/[^/]+\.jpg$", "log": r"^(.*)/logs/log=[^/]+/[^/]+$"}


def file_kinds(files: DataFrame) -> DataFrame:
    """files (path, size, ...) with folder and kind: analysis, thumbnail, log, or other for what a store doesn't write."""
    kind = F.lit("other")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    for name, pattern in _KINDS.items():
        fits = F.rlike("path", F.lit(pattern))
        kind = F.when(fits, name).otherwise(kind)
        folder = F.when(fits, F.regexp_extract("path", pattern, 1)).otherwise(folder)
    return files.withColumns({"kind": kind, "folder": folder})


def statistics_by_kind(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(folder, analysis_entries, analysis_bytes, thumbnails, thumbnail_bytes, logs, total_bytes) of every folder.

    entries (folder, ...) are the stored rows; a folder whose rows can't be read has none, but its files count.  Logs are
    told apart by their folders and their bytes are no part of the total.
    """
    of = lambda k: F.col("kind") == k
    size = lambda k: F.coalesce(F.sum(F.when(of(k), F.col("size"))), F.lit(0))
    log = F.regexp_extract("path", r"/log=([^/]+)/[^/]+$", 1)
    found = file_kinds(files).groupBy("folder").agg(
        size("analysis").alias("analysis_bytes"), F.count_if(of("thumbnail")).alias("thumbnails"), size("thumbnail").alias("thumbnail_bytes"),
        F.count_distinct(F.when(of("log"), log)).alias("logs"),
    )
    counted = entries.groupBy("folder").agg(F.count("*").alias("analysis_entries"))
    found = found.join(counted, "folder", "left").withColumn("analysis_entries", F.coalesce("analysis_entries", F.lit(0)))
    return found.withColumn("total_bytes", F.col("analysis_bytes") + F.col("thumbnail_bytes"))


def clearing(files: DataFrame, keep_logs: bool = True) -> DataFrame:
    """file_kinds() with deleted: measurements and previews go, logs only if asked for, other files never."""
    doomed = ["analysis", "thumbnail", *([] if keep_logs else ["log"])]
    return file_kinds(files).withColumn("deleted", F.col("kind").isin(doomed))


def after_clearing(files: DataFrame, keep_logs: bool = True) -> DataFrame:
    """(folder, freed, left, gone): bytes freed, files left, and whether the folder is empty then."""
    rows = clearing(files, keep_logs)
    found = rows.groupBy("folder").agg(
        F.coalesce(F.sum(F.when(F.col("deleted"), F.col("size"))), F.lit(0)).alias("freed"), F.count_if(~F.col("deleted")).alias("left")
    )
    return found.withColumn("gone", F.col("left") == 0)
