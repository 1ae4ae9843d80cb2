"""Reports: rounded texts of graded frames, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesieve.operators.numbers import fixed, rounded, short


def shutter(seconds: str = "shutter_speed") -> Column:
    """1/250s below a second, 2s from there, - where unknown."""
    s = F.col(seconds)
    short = F.concat(F.lit("1/"), F.bround(F.lit(1.0) / s, 0).cast("long").cast("string"), F.lit("s"))
    long = F.concat(F.regexp_replace(s.cast("string"), r"\.0$", ""), F.lit("s"))
    return F.when(s.isNull() | (s <= 0), "-").when(s < 1, short).otherwise(long)


def facts() -> Column:
    """One line about a shot: body, focal lengths (the equivalent if it differs by over 2 %), exposure, place."""
    make, model = F.col("camera_make"), F.col("camera_model")
    body = F.when(F.startswith(F.lower(model), F.lower(make)), model).otherwise(F.concat_ws(" ", make, model))
    f, f35 = F.col("focal_length"), F.col("focal_length_35mm")
    focal = F.concat(fixed(f, 0), F.lit("mm"))
    far = F.abs(f35 - f) > 0.02 * f
    focal = F.when(far, F.concat(focal, F.lit(" ("), fixed(f35, 0), F.lit("mm)"))).otherwise(focal)
    exposure = F.concat_ws(" ", shutter(), F.concat(F.lit("f/"), fixed(F.col("aperture"), 1)), F.concat(F.lit("ISO "), F.col("iso").cast("string")))
    place = F.concat(fixed(F.col("latitude"), 3), F.lit(", "), fixed(F.col("longitude"), 3))
    return F.concat_ws(" | ", body, focal, exposure, place)


#: What a caption may show, in its order, and what stands between its parts.
CAPTION = ("filename", "camera", "lens", "focal_length", "aperture", "shutter", "iso", "datetime")
BETWEEN = "  ·  "


def caption(include=CAPTION, custom: str = "", known: Column | None = None) -> Column:
    """(left, right): the chosen parts of a shot's data in CAPTION's order, and a text of one's own.

    Needs name and the columns of metadata; what is null or zero is left out, and so are empty names.  known says whether a
    picture has data at all (default: any of the fields); one without shows its name alone.  An unknown part is an error.
    """
    unknown = set(include) - set(CAPTION)
    if unknown:
        raise ValueError(f"unknown parts: {', '.join(sorted(unknown))}")
    number = lambda c: F.when(F.col(c) != 0, F.col(c))
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    parts = {
        "camera": given("camera_model"),
        "lens": given("lens_model"),
        "focal_length": F.concat(short(number("focal_length")), F.lit("mm")),
        "aperture": F.concat(F.lit("f/"), short(number("aperture"))),
        "shutter": F.when(number("shutter_speed").isNotNull(), shutter()),
        "iso": F.concat(F.lit("ISO "), number("iso").cast("string")),
        "datetime": F.date_format("capture_time", "yyyy-MM-dd HH:mm"),
    }
    if known is None:
        fields = ("camera_model", "lens_model", "focal_length", "aperture", "shutter_speed", "iso", "capture_time")
        known = F.coalesce(*(F.col(c).cast("string") for c in fields)).isNotNull()
    shown = F.array(*(parts[n] for n in CAPTION if n in parts and n in include)) if set(include) & set(parts) else F.array().cast("array<string>")
    name = F.col("name") if "filename" in include else F.when(~known, F.col("name"))
    texts = F.concat(F.array(name), F.when(known, shown).otherwise(F.array().cast("array<string>")))
    return F.struct(F.array_join(texts, BETWEEN).alias("left"), F.lit(custom).alias("right"))


def with_reasons(frames: DataFrame, reasons: DataFrame) -> DataFrame:
    """frames with reasons: the texts of reasons (path, pos, reason) in order, as an array."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("pos", "reason"))), lambda x: x["reason"])
    texts = reasons.groupBy("path").agg(cells.alias("reasons"))
    return frames.join(texts, "path", "left")


def iso_time(time: str = "capture_time") -> Column:
    """yyyy-mm-ddThh:mm:ss, with microseconds where there are any."""
    return F.regexp_replace(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def report_rows(frames: DataFrame) -> DataFrame:
    """The table report: 15 columns as text, numbers to two places, nothing for what is unknown.

    frames needs the graded columns, final_grade, lens_model, iso, shutter_speed and reasons.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    known = F.col("focus_known") if "focus_known" in frames.columns else F.col("sharpness").isNotNull()
    return frames.select(
        "name",
        "final_grade",
        fixed(F.col("score"), 2).alias("score"),
        F.col("group_id").cast("string").alias("group_id"),
        F.col("group_rank").cast("string").alias("group_rank"),
        blank(fixed(F.col("sharpness"), 2)).alias("sharpness"),
        blank(fixed(F.col("frame_sharpness"), 2)).alias("frame_sharpness"),
        F.when(known, F.col("source")).otherwise("").alias("source"),
        F.when(known, F.col("face_count").cast("string")).otherwise("0").alias("face_count"),
        blank(iso_time()).alias("capture_time"),
        blank(F.col("lens_model")).alias("lens"),
        blank(F.col("iso").cast("string")).alias("iso"),
        shutter().alias("shutter"),
        F.array_join("reasons", "; ").alias("reasons"),
        blank(F.col("error")).alias("error"),
    )


def json_rows(frames: DataFrame) -> DataFrame:
    """The record report: 15 fields with their types, numbers to two places, null for what is unknown."""
    return frames.select(
        "path",
        F.col("final_grade").alias("grade"),
        rounded(F.col("score"), 2).alias("score"),
        "group_id",
        "group_rank",
        rounded(F.col("sharpness"), 2).alias("sharpness"),
        rounded(F.col("frame_sharpness"), 2).alias("frame_sharpness"),
        F.when(F.col("sharpness").isNotNull(), F.col("source")).alias("focus_source"),
        F.when(F.col("sharpness").isNotNull(), F.col("face_count")).otherwise(0).alias("face_count"),
        iso_time().alias("capture_time"),
        F.col("lens_model").alias("lens"),
        "iso",
        shutter().alias("shutter"),
        "reasons",
        "error",
    )


def write_csv(frames: DataFrame, path: str) -> None:
    """Part files of report_rows(); a spreadsheet that wants a mark of the encoding takes it from the header's first name."""
    rows = report_rows(frames)
    rows.withColumnRenamed("name", "\ufeffname").write.mode("overwrite").option("header", True).csv(path)


def write_json(frames: DataFrame, path: str) -> None:
    json_rows(frames).write.mode("overwrite").json(path)


def write_by_grade(frames: DataFrame, path: str) -> None:
    """Rows laid out by place and grade.

    A folder's rows are brought together first, else each task opens a file in nearly every folder; only folders too large
    for one task are dealt to several.
    """
    frames.hint("rebalance", "place_label", "grade").write.mode("overwrite").partitionBy("place_label", "grade").parquet(path)


def merge_settings(current: Column, applied: Column, keep: list[str], schema: str) -> Column:
    """Settings as JSON: applied over current, unknown keys dropped, the keys of keep left as they are in current."""
    old, new = F.from_json(current, schema), F.from_json(applied, schema)
    names = [x.split()[0] for x in schema.split(", ")]
    parts = [(old[n] if n in keep else F.coalesce(new[n], old[n])).alias(n) for n in names]
    return F.to_json(F.struct(*parts))
