"""Line dedup: lines that many documents hold stay in one document only.

Line keys are kept as hashes in levelled sorted runs.  Documents come in batches, those with the largest ids first.  The
keys of a batch are counted, merge-anti-joined against the runs (a key that a run shows to be frequent already needs no
further record, and its keeper stands in an earlier batch), and what is left becomes a run of its own.  A level with fanout
runs is compacted into one run of the next level.  Runs are bucketed tables sorted by key with one record a key, so joins
and compactions read them bucket by bucket without a shuffle, and no key is ever a hot one there.

Everything here is DataFrame functions.  Each text is parsed once within its row; shuffled are hashes, counted before
they go, and the places of dropped lines.  The join that marks lines is one that adaptive execution splits at a hot key.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, stored

#: What is stripped at both ends of a line, and the letters that are lower-cased.
STRIPPED = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = CAPITALS.lower()

KEY = ["h", "g"]


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(STRIPPED))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, CAPITALS, SMALL))


def parsed(docs: DataFrame, least_chars: int) -> DataFrame:
    """(row, doc_id, text, n_lines, keys), stored: keys are place and 128-bit hash of each line with a long key."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    places = F.filter(
        F.transform("_lines", lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: F.length(x["line"]) >= least_chars
    )
    cut = F.transform(places, lambda x: F.struct(x["at"].alias("at"), line_key(x["line"]).alias("line")))
    # The hash of a constant before the key seeds a second, independent hash of it.
    keys = F.transform(
        F.filter(cut, lambda x: F.length(x["line"]) >= least_chars),
        lambda x: F.struct(x["at"], F.xxhash64(x["line"]).alias("h"), F.xxhash64(F.lit(1), x["line"]).alias("g")),
    )
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    df = df.withColumn("_lines", lines)
    return stored(
        df.select("row", "doc_id", "text", F.size("_lines").cast("long").alias("n_lines"), keys.alias("keys")), "line-keys"
    )


class LineRuns:
    """Levelled runs of (h, g, docs, keeper): documents that hold a key, and the largest doc_id among them."""

    def __init__(self, spark: SparkSession, least_docs: int, buckets: int, fanout: int = 4):
        self.spark, self.least_docs, self.buckets, self.fanout = spark, least_docs, buckets, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _sorted(self, keys: DataFrame) -> DataFrame:
        """keys written once as a bucketed table, sorted by key inside each bucket, one file a bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = keys.select(*KEY, "docs", "keeper").repartition(self.buckets, *KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", new_folder(self.spark, name)).saveAsTable(name)
        return self.spark.table(name)

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = merge(self.levels[level]), []
            self._put(self._sorted(merged), level + 1)

    def add(self, keys: DataFrame) -> None:
        """Take in the (doc_id, h, g) of a batch, whose ids are all smaller than those of the batches before it."""
        counted = keys.distinct().groupBy(*KEY).agg(
            (F.count("doc_id") + F.count_if(F.col("doc_id").isNull())).alias("docs"), F.max("doc_id").alias("keeper")
        )
        fresh = counted.repartition(self.buckets, *KEY)
        for run in self.runs():
            fresh = fresh.join(run.where(F.col("docs") >= self.least_docs).select(*KEY), KEY, "left_anti")
        self._put(self._sorted(fresh), 0)

    def frequent(self) -> DataFrame:
        """(h, g, keeper) of the keys that least_docs documents or more hold."""
        return merge(self.runs()).where(F.col("docs") >= self.least_docs).select(*KEY, "keeper")


def merge(runs: list[DataFrame]) -> DataFrame:
    """One record a key of several runs: a chain of merge joins, since a union would lose their buckets."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*KEY, F.col("docs").alias("_docs"), F.col("keeper").alias("_keeper"))
        zero = F.lit(0).cast("long")
        return a.join(b, KEY, "full").select(
            *KEY,
            (F.coalesce("docs", zero) + F.coalesce("_docs", zero)).alias("docs"),
            F.greatest("keeper", "_keeper").alias("keeper"),
        )

    return reduce(two, runs)


def deduplicated(
    docs: DataFrame,
    least_chars: int = 40,
    least_docs: int = 5,
    batches: int = 6,
    fanout: int = 4,
    docs_per_bucket: int = 100_000,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for every row of docs, text being its lines that stay.

    docs needs doc_id and text; other columns are left out.  A line's key is stripped and lower-cased (A-Z); keys of
    least_chars code points or more that least_docs documents or more hold lose all their lines but in the largest doc_id.
    A null or empty text is one empty line.  Rows that repeat a doc_id are one document: all its rows keep or lose the
    line alike.  Rows without doc_id are one document with the least id; lines held by it alone are never frequent.  A line
    twice in its keeper stays twice.  An empty table gives an empty table.  Keys are 128-bit hashes.
    """
    spark = docs.sparkSession
    rows = parsed(docs, least_chars)
    share = [i / batches for i in range(1, batches)]
    seen = rows.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", share, 10_000).alias("cuts")).first()
    # A bucket is a task of the merges; its size in documents is fixed, their number grows with the input.
    runs = LineRuns(spark, least_docs, min(20_000, 1 + seen.n // docs_per_bucket), fanout)
    cuts = sorted(set(seen.cuts or []))
    held = rows.select("doc_id", F.explode("keys").alias("k")).select("doc_id", "k.h", "k.g")
    for high, low in zip([None, *reversed(cuts)], [*reversed(cuts), None]):
        batch = held
        if high is not None:
            batch = batch.where((F.col("doc_id") <= high) | (F.col("doc_id").isNull() if low is None else F.lit(False)))
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        runs.add(batch)

    lines = rows.select("row", "doc_id", F.explode("keys").alias("k")).select("row", "doc_id", "k.at", "k.h", "k.g")
    lost = lines.join(runs.frequent(), KEY).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("lost"))
    df = rows.drop("keys").join(lost, "row", "left")
    none = F.array().cast("array<int>")
    df = df.withColumn("lost", F.coalesce("lost", none)).withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    # The stretches between lost lines, so that the cost is linear in the lines however many are lost.
    ends = F.concat(F.array(F.lit(-1)), "lost", F.array(F.size("_lines")))
    df = df.withColumn("_ends", ends)
    stays = F.transform(
        F.slice("_ends", 1, F.size("_ends") - 1), lambda x, i: F.slice("_lines", x + 2, F.get("_ends", i + 1) - x - 1)
    )
    kept = F.when(F.size("lost") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(stays), "\n"))
    return df.select("doc_id", "n_lines", F.size("lost").cast("long").alias("n_dropped"), kept.alias("text"))
