"""Ranks, thresholds, grades and their reasons.

Thresholds are one row per batch: they are aggregated and joined back rather than taken over unbounded windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesieve.config import ScoreConfig, sanitise
from framesieve.operators.score import eyes_are_closed, face_defocus, is_ok
from framesieve.sources.shared import stored


def ranked(frames: DataFrame) -> DataFrame:
    """scored frames with group_rank (from 0: score, then name, then input order) and group_best."""
    scene = Window.partitionBy("batch_id", "group_id")
    order = scene.orderBy(F.desc("score"), "name", "input_order")
    return frames.withColumn("group_rank", F.row_number().over(order) - 1).withColumn(
        "group_best", F.max("score").over(scene)
    )


def reject_thresholds(frames: DataFrame, c: ScoreConfig) -> DataFrame:
    """(batch_id, threshold): the larger of reject_below and the percentile of the measured scores, to 9 places."""
    score = F.when(is_ok(), F.col("score"))
    cut = F.percentile(score, F.lit(c.reject_percentile / 100))
    floor = F.lit(float(c.reject_below))
    return frames.groupBy("batch_id").agg(F.round(F.greatest(floor, F.coalesce(cut, floor)), 9).alias("threshold"))


def keep_thresholds(frames: DataFrame, c: ScoreConfig) -> DataFrame:
    """(batch_id, keep_at): keep_above, or what a target ratio asks for beyond the scenes' winners.

    target = ratio of the measured frames, half to even.  Winners that are kept anyway count against it; the rest come
    from the highest scores of measured frames that lead no scene.
    """
    fixed = F.lit(float(c.keep_above))
    if c.target_keep_ratio is None:
        return frames.select("batch_id").distinct().withColumn("keep_at", fixed)
    ok = is_ok()
    winner = ok & (F.col("group_rank") == 0) & (F.col("score") >= c.min_keep_score)
    kept = F.count_if(winner) if c.keep_per_group > 0 else F.lit(0).cast("long")
    other = (F.col("group_rank") != 0) if c.keep_per_group > 0 else F.lit(True)
    wanted = frames.groupBy("batch_id").agg(
        F.count_if(ok).alias("n"),
        (F.bround(F.count_if(ok) * float(c.target_keep_ratio), 0).cast("long") - kept).alias("extra"),
        F.count_if(ok & other).alias("others"),
    )
    rest = frames.where(ok & other)
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("score")))
    picked = rest.select("batch_id", "score", place.alias("place"))
    found = wanted.join(
        picked, (picked["batch_id"] == wanted["batch_id"]) & (picked["place"] == wanted["extra"]), "left"
    )
    at = (
        F.when(F.col("n") == 0, fixed)
        .when(F.col("extra") <= 0, F.lit(float("inf")))
        .when(F.col("extra") >= F.col("others"), 0.0)
        .otherwise(F.col("score"))
    )
    return found.select(wanted["batch_id"], at.alias("keep_at"))


def graded(frames: DataFrame, config: ScoreConfig | None = None) -> DataFrame:
    """scored frames with scenes, graded keep, review or reject; adds group_rank, group_best, threshold, keep_at, grade."""
    c = sanitise(config or ScoreConfig())
    df = stored(ranked(frames), "ranked")  # both thresholds and the rows come from it, so scenes are walked once
    df = df.join(reject_thresholds(df, c), "batch_id").join(keep_thresholds(df, c), "batch_id")
    may_keep = (F.col("face_count") > 0) if c.face_priority else F.lit(True)
    grade = (
        F.when(~is_ok(), "reject")
        .when((F.col("score") >= F.col("keep_at")) & may_keep, "keep")
        .when((F.col("group_rank") < c.keep_per_group) & (F.col("score") >= c.min_keep_score), "keep")
        .when(F.round("score", 9) < F.col("threshold"), "reject")
        .when(F.col("group_best") - F.col("score") >= c.reject_below_group_best, "reject")
        .otherwise("review")
    )
    return df.withColumn("grade", grade)


def achievable_keep_floor(frames: DataFrame, config: ScoreConfig | None = None) -> DataFrame:
    """(batch_id, floor): the least share of frames that the scenes' winners make up."""
    c = sanitise(config or ScoreConfig())
    ok = is_ok()
    if c.keep_per_group <= 0:
        share = F.lit(0.0)
    elif c.min_keep_score > 0:
        share = F.count_if(ok & (F.col("group_rank") == 0) & (F.col("score") >= c.min_keep_score)) / F.count_if(ok)
    else:
        share = F.count_distinct(F.when(ok, F.col("group_id"))) / F.count_if(ok)
    none = F.count_if(ok) == 0
    return frames.groupBy("batch_id").agg(F.when(none, 0.0).otherwise(share).alias("floor"))


# -- reasons -----------------------------------------------------------------------------------------------------------

#: The suffixes of pictures that are no raw files.
EDITABLE = ["jpg", "jpeg", "hif", "heic", "heif"]


def suffix(name: str = "name") -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


#: What is said for each reason; {} stands for its number or name.
WORDS = {
    "roi_sharpness": "measured sharpness {}, region: {}",
    "not_raw": "{} file, not a RAW file",
    "face_count": "faces found: {}",
    "af_mismatch": "the camera focused on another face than the main one",
    "face_defocus": "background is {} points sharper than the face",
    "highlight_clip": "{}% of the picture has burnt highlights",
    "shadow_clip": "{}% of the picture has blocked shadows",
    "eyes_unknown": "no eye could be measured",
    "eyes_closed": "closed eyes: ratio {} under {}",
    "eyes_open": "open eyes: ratio {}",
    "frame_black": "nearly no light in the picture",
    "frame_white": "nearly only white in the picture",
    "batch_bottom": "among the weakest of the batch, under {}",
    "better_in_group": "the scene has a picture {} points better",
}
REGIONS = {"eye": "eyes", "face": "face", "tile": "likely subject", "frame": "full picture"}


def _said(key: str, *values: Column) -> Column:
    parts = WORDS[key].split("{}")
    pieces = [F.lit(parts[0])]
    for value, text in zip(values, parts[1:]):
        pieces += [value, F.lit(text)]
    return F.concat(*pieces)


def _number(value: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def reasons(graded_frames: DataFrame, config: ScoreConfig | None = None) -> DataFrame:
    """(path, pos, key, reason): why a frame got its grade, in the fixed order of keys."""
    c = sanitise(config or ScoreConfig())
    names = F.create_map(*(F.lit(x) for pair in REGIONS.items() for x in pair))
    region = F.coalesce(F.try_element_at(names, F.col("source")), F.col("source"))
    measured, closed = F.col("eyes_open") >= 0, eyes_are_closed(c)
    ear, luma, deficit = _number(F.col("eyes_open"), 2), F.col("mean_luma"), F.col("group_best") - F.col("score")
    other_face = F.lit(False)
    if {"af_face", "main_face"} <= set(graded_frames.columns):
        other_face = (F.col("af_face") >= 0) & (F.col("main_face") >= 0) & (F.col("af_face") != F.col("main_face"))
    share = lambda name: _number(F.col(name) * 100)
    found: list[tuple[str, Column, list[Column]]] = [
        ("roi_sharpness", F.lit(True), [_number(F.col("sharpness")), region]),
        ("not_raw", suffix().isin(EDITABLE), [F.upper(suffix())]),
        ("face_count", F.col("face_count") > 0, [F.col("face_count").cast("string")]),
        ("af_mismatch", other_face, []),
        ("face_defocus", face_defocus(c) > 0, [_number(F.col("background_sharpness") - F.col("sharpness"))]),
    ]
    if c.penalty_highlight_clip:
        found.append(("highlight_clip", F.col("clipped_highlights") > c.max_clipped_highlights, [share("clipped_highlights")]))
    if c.penalty_shadow_clip:
        found.append(("shadow_clip", F.col("clipped_shadows") > c.max_clipped_shadows, [share("clipped_shadows")]))
    if c.face_priority:
        found += [
            ("eyes_unknown", ~measured, []),
            ("eyes_closed", measured & closed, [ear, F.lit(f"{c.eyes_closed_below:.2f}")]),
            ("eyes_open", measured & ~closed, [ear]),
        ]
    found += [
        ("frame_black", luma < 8, []),
        ("frame_white", luma > 247, []),
        ("batch_bottom", F.round("score", 9) < F.col("threshold"), [_number(F.col("threshold"))]),
        ("better_in_group", deficit >= c.reject_below_group_best, [_number(deficit)]),
    ]
    rows = [F.when(when, F.struct(F.lit(key).alias("key"), _said(key, *values).alias("reason"))) for key, when, values in found]
    failed = F.array(F.struct(F.lit("error").alias("key"), F.coalesce("error", F.lit("")).alias("reason")))
    every = F.when(is_ok(), F.filter(F.array(*rows), lambda x: x.isNotNull())).otherwise(failed)
    return graded_frames.select("path", F.posexplode(every).alias("pos", "r")).select("path", "pos", "r.key", "r.reason")
