"""Logs, queues, calibrations and listings as files.

All readers take an explicit schema; rows that can't be one are dropped, never a failed job.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LOG = "version int, created string, mode string, root string, pos long, source string, destination string, grade string, rendered boolean"
LOG_DOCUMENT = (
    "version int, created string, mode string, root string, "
    "operations array<struct<source:string,destination:string,grade:string,rendered:boolean>>"
)
QUEUE = "seq long, source string, develop string, grade string, preset_name string"
CALIBRATION = "key string, camera string, gain array<double>, samples int"


def write_log(operations: DataFrame, path: str, created: str, mode: str, root: str, version: int = 2, name: str | None = None) -> None:
    """One log of a plan (index, source, destination, grade, rendered) as the folder log=name below path.

    Every task writes its own operations, a row each with its place in the plan; a first row without a place says that the
    log exists, so that a plan without operations has one too.  name is letters, digits, dots, dashes and underscores, by
    default taken from created; a name that stands already is an error.
    """
    name = name or "export_" + re.sub(r"\W", "", created)
    if not re.fullmatch(r"[\w.-]+", name, re.ASCII):
        raise ValueError(f"not a log's name: {name}")
    head = [F.lit(v).alias(k) for k, v in (("version", version), ("created", created), ("mode", mode), ("root", root))]
    cells = ["source", "destination", "grade", "rendered"]
    rows = operations.select(*head, F.col("index").cast("long").alias("pos"), *cells)
    first = operations.sparkSession.range(1).select(*head)
    first.unionByName(rows, allowMissingColumns=True).write.json(f"{path}/log={name}")


def _log_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(LOG).option("recursiveFileLookup", True).json(path)
    file = F.regexp_extract(F.col("_metadata.file_path"), r"/log=([^/]+)/[^/]+$", 1)
    return rows.withColumn("file", file).where("file <> '' and created is not null")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, created, mode, root, pos, source, destination, grade, rendered): every operation of every log below path."""
    return _log_rows(spark, path).where("pos is not null").select("file", *[c.split()[0] for c in LOG.split(", ")[1:]])


def read_log_documents(spark: SparkSession, path: str) -> DataFrame:
    """read_logs() for logs that are one JSON document each, with an array of operations, as desktop tools write them."""
    rows = spark.read.schema(LOG_DOCUMENT).option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("file"))
    found = rows.where("operations is not null").select("file", "created", "mode", "root", F.posexplode("operations").alias("pos", "op"))
    return found.select("file", "created", "mode", "root", F.col("pos").cast("long").alias("pos"), "op.*")


def newest_log(spark: SparkSession, path: str) -> DataFrame:
    """The operations of each root's newest log, last one first; none where that log is empty."""
    heads = _log_rows(spark, path).where("pos is null")
    last = heads.groupBy("root").agg(F.max_by("file", F.struct("created", "file")).alias("file"))
    return read_logs(spark, path).join(last, ["root", "file"], "left_semi").orderBy("root", F.desc("pos"))


def write_queue(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Entries in their order; broken lines and entries without a source are skipped."""
    rows = spark.read.schema(QUEUE).option("mode", "PERMISSIVE").json(path)
    return rows.where("source is not null and source <> ''").orderBy("seq")


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """Calibrations with three gains between a half and two."""
    from framesieve.operators.calibrate import valid_gains

    return valid_gains(spark.read.schema(CALIBRATION).option("multiLine", True).json(path))


def write_calibrations(old: DataFrame, new: DataFrame, path: str, removed: DataFrame | None = None) -> None:
    """new over old by key, without the keys of removed; path must not be where old is read from."""
    kept = old.join(new.select("key"), "key", "left_anti").unionByName(new)
    if removed is not None:
        kept = kept.join(removed.select("key"), "key", "left_anti")
    kept.write.mode("overwrite").json(path)


# -- listing -----------------------------------------------------------------------------------------------------------


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _ListReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        """The root's own files, and each folder below it as a task."""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.root)
        found = store.get_file_info(fs.FileSelector(path))
        return [_Folder(self.root, False)] + [
            _Folder(self.root.rstrip("/") + "/" + f.base_name, True) for f in found if f.type == fs.FileType.Directory
        ]

    def read(self, partition):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.path)
        for f in store.get_file_info(fs.FileSelector(path, recursive=partition.deep)):
            if f.type == fs.FileType.File:
                yield f.path, f.mtime.timestamp() if f.mtime else None, f.size


class FileListing(DataSource):
    """spark.read.format("file_listing").load(uri): every file below, hidden and empty ones too."""

    @classmethod
    def name(cls):
        return "file_listing"

    def schema(self):
        return "path string, mtime double, size long"

    def reader(self, schema):
        return _ListReader(self.options["path"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").load(root)


def _remove(frames):
    from pyarrow import fs

    for frame in frames:
        for uri in frame["path"]:
            store, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
            if store.get_file_info(path).type == fs.FileType.File:
                store.delete_file(path)
        yield frame


def clear_store(spark: SparkSession, root: str, keep_logs: bool = True) -> DataFrame:
    """Deletes what store.clearing() names below root, each task its share, and returns the listing from before.

    A file that is gone already, as when a lost task is run again, is passed over.
    """
    from framesieve.operators import store
    from framesieve.sources.shared import stored

    before = stored(listing(spark, root), "store-listing")
    doomed = store.clearing(before, keep_logs).where("deleted").select("path")
    doomed.mapInPandas(_remove, "path string").write.format("noop").mode("overwrite").save()
    return before
