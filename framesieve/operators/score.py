"""The itemised score of a frame: every term a column expression, the total the sum of the terms in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesieve.config import ScoreConfig, sanitise

#: The terms in the order in which they add up.
LINES = [
    "sharpness",
    "face_defocus",
    "focus_on_face",
    "no_face",
    "face_detected",
    "face_size",
    "eye_detected",
    "eyes_closed",
    "eyes_open",
    "eyes_unknown",
    "highlight_clip",
    "shadow_clip",
    "extreme_luma",
]


def is_ok() -> Column:
    """Measured without an error."""
    return F.col("error").isNull() & F.col("sharpness").isNotNull()


def trust(c: ScoreConfig) -> Column:
    """How far the measured region speaks for the frame."""
    by_source = {"eye": c.trust_eye, "face": c.trust_face, "af": c.trust_af, "tile": c.trust_tile, "frame": c.trust_frame}
    out = None
    for name, value in by_source.items():
        out = F.when(F.col("source") == name, F.lit(value)) if out is None else out.when(F.col("source") == name, value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out.otherwise(F.lit(0.5))))


def face_weight(c: ScoreConfig) -> Column:
    """Share of the face bonuses that a face of this size earns: the root of its area, nothing below a hundredth."""
    if c.face_bonus_full_area <= 0:
        return F.lit(1.0)
    area = F.greatest(F.lit(0.0), F.col("face_area_ratio"))
    return (
        F.when(area >= c.face_bonus_full_area, 1.0)
        .when(area < c.face_bonus_full_area * 0.01, 0.0)
        .otherwise(F.sqrt(area / c.face_bonus_full_area))
    )


def face_defocus(c: ScoreConfig) -> Column:
    """Penalty (not negative) where the background is sharper than the face."""
    gap = F.col("background_sharpness") - F.col("sharpness")
    on_face = (F.col("face_count") > 0) & F.col("source").isin("eye", "face")
    if not (c.face_priority and c.penalty_face_defocus):
        return F.lit(0.0)
    sure = F.greatest(F.lit(0.5), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("face_confidence"))))
    return F.when(
        on_face & (gap > 0), F.lit(c.penalty_face_defocus) * F.least(F.lit(1.0), gap / 40.0) * sure
    ).otherwise(0.0)


def eyes_are_closed(c: ScoreConfig) -> Column:
    if not c.penalty_eyes_closed:
        return F.lit(False)
    return (F.col("eyes_open") >= 0) & (F.col("eyes_open") < c.eyes_closed_below)


def terms(config: ScoreConfig | None = None) -> dict[str, Column]:
    """Each term's value, null where the term does not apply."""
    c = sanitise(config or ScoreConfig())
    faces = F.col("face_count") > 0
    on_face = faces & F.col("source").isin("eye", "face")
    t, closed, open_ = trust(c), eyes_are_closed(c), F.col("eyes_open") >= 0
    never = F.lit(None).cast("double")
    scale = F.lit(0.5 if c.face_priority else 1.0)
    out = dict.fromkeys(LINES, never)
    out["sharpness"] = scale * (t * F.col("sharpness") + (F.lit(1.0) - t) * F.col("frame_sharpness"))
    defocus = face_defocus(c)
    out["face_defocus"] = F.when(defocus != 0, -defocus)
    if c.face_priority:
        if c.bonus_focus_on_face:
            out["focus_on_face"] = F.when(on_face, F.lit(c.bonus_focus_on_face))
        if c.penalty_no_face:
            out["no_face"] = F.when(~faces, F.lit(-c.penalty_no_face))
        if c.bonus_face:
            out["face_detected"] = F.when(faces, F.lit(c.bonus_face) * face_weight(c))
        if c.bonus_face_size:
            size = F.least(F.lit(1.0), F.col("face_area_ratio") / 0.10)
            out["face_size"] = F.when(faces, F.lit(c.bonus_face_size) * size)
        if c.bonus_eye:
            out["eye_detected"] = F.when(F.col("source") == "eye", F.lit(c.bonus_eye) * face_weight(c))
        out["eyes_closed"] = F.when(closed, F.lit(-c.penalty_eyes_closed))
        out["eyes_open"] = F.when(~closed & open_, F.lit(c.bonus_eyes_open))
        out["eyes_unknown"] = F.when(~closed & ~open_, F.lit(0.0))
    for name, column, most, allowed in (
        ("highlight_clip", "clipped_highlights", c.penalty_highlight_clip, c.max_clipped_highlights),
        ("shadow_clip", "clipped_shadows", c.penalty_shadow_clip, c.max_clipped_shadows),
    ):
        if most:
            excess = F.col(column) - allowed
            out[name] = F.when(F.col(column) > allowed, -F.least(F.lit(most), excess * 100.0))
    dark = (F.col("mean_luma") < 8.0) | (F.col("mean_luma") > 247.0)
    out["extreme_luma"] = F.when(dark, F.lit(-c.penalty_extreme_luma))
    return out


def scored(frames: DataFrame, config: ScoreConfig | None = None) -> DataFrame:
    """frames with lines (array of key and value) and score (0 to 100); failed frames have the one line 'failed'."""
    parts = [
        F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), value.cast("double").alias("value")))
        for key, value in terms(config).items()
    ]
    failed = F.array(F.struct(F.lit("failed").alias("key"), F.lit(0.0).alias("value")))
    measured = F.filter(F.array(*parts), lambda x: x.isNotNull())
    df = frames.withColumn("_lines", F.when(is_ok(), measured).otherwise(failed))
    total = F.aggregate("_lines", F.lit(0.0), lambda a, x: a + x["value"])
    df = df.withColumn("_total", total)
    df = df.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_total"))))
    clamp = F.struct(F.lit("clamped").alias("key"), (F.col("score") - F.col("_total")).alias("value"))
    lines = F.when(F.col("score") != F.col("_total"), F.array_append("_lines", clamp)).otherwise(F.col("_lines"))
    return df.withColumn("lines", lines).drop("_lines", "_total")


def score_lines(frames: DataFrame, config: ScoreConfig | None = None) -> DataFrame:
    """The score table in long form: (path, pos, key, value)."""
    return scored(frames, config).select("path", F.posexplode("lines").alias("pos", "line")).select(
        "path", "pos", "line.key", "line.value"
    )
