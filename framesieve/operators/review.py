"""Looking over graded batches: manual edits, summaries, scenes without a keeper, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesieve.config import ScoreConfig
from framesieve.operators.score import is_ok


def with_final(frames: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """graded frames with final_grade: the last manual grade of edits (path, manual_grade, seq), else the grade."""
    if edits is None:
        return frames.withColumn("final_grade", F.col("grade"))
    last = edits.groupBy("path").agg(F.max_by("manual_grade", "seq").alias("manual_grade"))
    return frames.join(last, "path", "left").withColumn("final_grade", F.coalesce("manual_grade", "grade"))


def summary(frames: DataFrame, column: str = "grade") -> DataFrame:
    """(batch_id, keep, review, reject), zeros included."""
    return frames.groupBy("batch_id").agg(
        *(F.count_if(F.col(column) == g).alias(g) for g in ("keep", "review", "reject"))
    )


def scenes_without_keep(frames: DataFrame) -> DataFrame:
    return (
        frames.groupBy("batch_id", "group_id")
        .agg(F.count_if(F.col("final_grade") == "keep").alias("_keeps"))
        .where("_keeps = 0")
        .drop("_keeps")
    )


def frames_of_scenes_without_keep(frames: DataFrame) -> DataFrame:
    """The rows of scenes that keep nothing; a missing scene counts as one."""
    none = scenes_without_keep(frames).select(F.col("batch_id").alias("_b"), F.col("group_id").alias("_g"))
    return frames.join(none, (F.col("batch_id") == F.col("_b")) & F.col("group_id").eqNullSafe(F.col("_g")), "left_semi")


def dropped_scenes(frames: DataFrame, config: ScoreConfig) -> DataFrame:
    """(batch_id, dropped): scenes that the least keep score empties; none where winners are always kept."""
    by_scene = frames.groupBy("batch_id", "group_id").agg(F.count_if(F.col("final_grade") == "keep").alias("_keeps"))
    counts = by_scene.groupBy("batch_id").agg(F.count_if(F.col("_keeps") == 0).alias("dropped"))
    if config.min_keep_score <= 0 and config.keep_per_group > 0:
        return counts.withColumn("dropped", F.lit(0).cast("long"))
    return counts


def score_statistics(frames: DataFrame, ratio: float) -> DataFrame:
    """(batch_id, low, mean, high, cutoff): the cutoff is the score at the place that ratio of the frames reach."""
    w = Window.partitionBy("batch_id")
    place = F.row_number().over(w.orderBy(F.desc("score")))
    want = F.greatest(F.lit(1), F.bround(F.count("*").over(w) * ratio, 0).cast("long"))
    df = frames.select("batch_id", "score", place.alias("_place"), want.alias("_want"))
    return df.groupBy("batch_id").agg(
        F.round(F.min("score"), 9).alias("low"),
        F.round(F.avg("score"), 6).alias("mean"),
        F.round(F.max("score"), 9).alias("high"),
        F.round(F.max(F.when(F.col("_place") == F.col("_want"), F.col("score"))), 9).alias("cutoff"),
    )


def sorted_frames(frames: DataFrame, mode: str = "file") -> DataFrame:
    """frames with position in their batch, by file name, or by score either way; an unknown mode means file."""
    order = {"score_desc": [F.desc("score")], "score_asc": [F.asc("score")]}.get(mode, [])
    w = Window.partitionBy("batch_id").orderBy(*order, "name", "input_order")
    return frames.withColumn("position", F.row_number().over(w))


def with_measurements(frames: DataFrame, edits: DataFrame) -> DataFrame:
    """frames whose measurements edits replaces, by path: every other column of edits overrides its namesake."""
    names = [c for c in edits.columns if c != "path"]
    new = edits.select(F.col("path").alias("_path"), *(F.col(c).alias(f"_new_{c}") for c in names), F.lit(True).alias("_edited"))
    df = frames.join(new, frames["path"] == new["_path"], "left")
    for c in names:
        df = df.withColumn(c, F.when(F.col("_edited"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return df.drop("_path", "_edited", *(f"_new_{c}" for c in names))


def raw_count(frames: DataFrame) -> DataFrame:
    """(raws, others): frames by whether their name is that of a raw file."""
    from framesieve.sources.inventory import kind

    raw = F.coalesce(kind(F.col("name")) == "raw", F.lit(False))
    return frames.agg(F.count_if(raw).alias("raws"), F.count_if(~raw).alias("others"))


def by_grade(frames: DataFrame, grade: str) -> DataFrame:
    """The frames of one final grade; an unknown grade is an error."""
    if grade not in ("keep", "review", "reject"):
        raise ValueError(f"unknown grade: {grade}")
    return frames.where(F.col("final_grade") == grade)


def failed(frames: DataFrame) -> DataFrame:
    return frames.where(~is_ok())


def located(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def not_raw(frames: DataFrame) -> DataFrame:
    from framesieve.sources.inventory import kind

    return frames.where(kind(F.col("name")).isin("jpeg", "heif"))


def first_failures(frames: DataFrame, most: int = 5) -> DataFrame:
    """(batch_id, name, error) of the first failed frames of each batch in input order."""
    w = Window.partitionBy("batch_id").orderBy("input_order")
    found = failed(frames).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return found.select("batch_id", "name", F.coalesce("error", F.lit("")).alias("error"))
