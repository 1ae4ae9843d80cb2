"""Typed metadata from a table of EXIF tags (path, tags MAP<STRING, STRING>): projections only."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The lens tags in the order in which they are trusted, and what stands for no lens.
LENS_TAGS = ["EXIF LensModel", "Image LensModel", "MakerNote LensModel", "MakerNote Lens", "MakerNote LensType"]
NO_LENS = ["unknown", "n/a", "na", "----", "none", "manual lens"]


def tag(*names: str) -> Column:
    """The first of these tags that is there and not blank."""
    return F.coalesce(*(F.nullif(F.btrim(F.try_element_at(F.col("tags"), F.lit(n))), F.lit("")) for n in names))


def number(text: Column) -> Column:
    """A decimal or a fraction as double; null for no number and for a zero denominator."""
    parts = F.split(text, "/")
    top, bottom = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    return F.when(F.size(parts) == 1, top).when(F.size(parts) == 2, F.try_divide(top, bottom))


def capture_time() -> Column:
    """The original, file or digitised time with its sub-seconds cut to microseconds; bad sub-seconds void the time."""
    text = tag("EXIF DateTimeOriginal", "Image DateTime", "EXIF DateTimeDigitized")
    at = F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")
    sub = tag("EXIF SubSecTimeOriginal")
    micros = F.rpad(F.substring(sub, 1, 6), 6, "0").try_cast("int")
    with_sub = at + F.make_dt_interval(secs=micros / F.lit(1_000_000).cast("decimal(18,6)"))
    return F.when(sub.isNull(), at).when(sub.rlike("^[0-9]+$"), with_sub)


def lens_name() -> Column:
    names = F.array(*(tag(n) for n in LENS_TAGS))
    good = F.filter(names, lambda x: x.isNotNull() & ~F.lower(x).isin(NO_LENS) & x.rlike(r"\p{L}"))
    return F.get(good, F.lit(0))


def gps(value: str, ref: str) -> Column:
    """Degrees, minutes and seconds ('[35, 41, 123/10]') as signed degrees; beyond 180 is null."""
    parts = F.split(F.regexp_replace(tag(value), r"[\[\]\s]", ""), ",")
    d, m, s = (number(F.get(parts, F.lit(i))) for i in range(3))
    degrees = d + m / 60 + s / 3600
    signed = F.when(F.upper(F.btrim(tag(ref))).isin("S", "W"), -degrees).otherwise(degrees)
    return F.when(signed.between(-180.0, 180.0), signed)


def focal_35mm() -> Column:
    """The tag, else focal length times the crop that the sensor's size gives, if that size can be one."""
    given = tag("EXIF FocalLengthIn35mmFilm").try_cast("double")
    unit = F.coalesce(
        F.try_element_at(
            F.create_map(*(F.lit(x) for x in ("2", 25.4, "3", 10.0, "4", 1.0))),
            F.coalesce(tag("EXIF FocalPlaneResolutionUnit"), F.lit("2")),
        ),
        F.lit(25.4),
    )
    width = F.try_divide(tag("EXIF ExifImageWidth").try_cast("double"), number(tag("EXIF FocalPlaneXResolution"))) * unit
    height = F.try_divide(tag("EXIF ExifImageLength").try_cast("double"), number(tag("EXIF FocalPlaneYResolution"))) * unit
    sane = (width > 2) & (width < 60) & (height > 1.5) & (height < 45)
    crop = F.sqrt(F.lit(36.0 * 36 + 24 * 24)) / F.sqrt(width * width + height * height)
    focal = number(tag("EXIF FocalLength"))
    return F.when(given > 0, given).when(sane & (focal > 0), F.bround(focal * crop, 0))


def colour_space() -> Column:
    """Interoperability index, else the colour-space tag, else sRGB."""
    inter, space = tag("Interoperability InteroperabilityIndex"), tag("EXIF ColorSpace")
    return F.when(inter == "R98", "srgb").when(inter == "R03", "adobergb").when(space == "2", "adobergb").otherwise("srgb")


def metadata(tags: DataFrame) -> DataFrame:
    """(path, metadata fields) of every row of tags."""
    return tags.select(
        "path",
        capture_time().alias("capture_time"),
        tag("Image Make").alias("camera_make"),
        tag("Image Model").alias("camera_model"),
        lens_name().alias("lens_model"),
        tag("EXIF ISOSpeedRatings").try_cast("int").alias("iso"),
        number(tag("EXIF ExposureTime")).alias("shutter_speed"),
        number(tag("EXIF FNumber")).alias("aperture"),
        number(tag("EXIF FocalLength")).alias("focal_length"),
        focal_35mm().alias("focal_length_35mm"),
        F.coalesce(tag("Image Orientation").try_cast("int"), F.lit(1)).alias("orientation"),
        gps("GPS GPSLatitude", "GPS GPSLatitudeRef").alias("latitude"),
        gps("GPS GPSLongitude", "GPS GPSLongitudeRef").alias("longitude"),
        colour_space().alias("colour_space"),
    )


def patched(meta: DataFrame, side: DataFrame) -> DataFrame:
    """meta with iso, lens_model and focal_length_35mm filled from side (by path) where they are missing."""
    names = ["iso", "lens_model", "focal_length_35mm"]
    other = side.select("path", *(F.col(n).alias(f"_{n}") for n in names))
    df = meta.join(other, "path", "left")
    return df.withColumns({n: F.coalesce(n, f"_{n}") for n in names}).drop(*(f"_{n}" for n in names))


#: The package's table of AF area modes; lines that begin with # are remarks.
AF_MODES = Path(__file__).with_name("af_modes.csv")


def af_mode_table(spark: SparkSession, file: Path = AF_MODES) -> DataFrame:
    """(maker, since, code, af_area_mode) of a table of AF modes, a file of a few lines on the driver."""
    lines = [x.split(",", 3) for x in file.read_text().splitlines() if x and not x.startswith("#")]
    rows = [(maker.lower(), int(since), int(code), name) for maker, since, code, name in lines]
    return spark.createDataFrame(rows, "maker string, since int, code long, af_area_mode string")


def af_mode(codes: DataFrame, modes: DataFrame) -> DataFrame:
    """codes (path, camera_make, version, code) with the maker's name of each AF mode.

    A maker's table with the greatest since up to the record's version holds; a code that it lacks has no name, even where
    an older table knows it.  A maker's name counts up to its first blank, whatever its case; a null version is 0.
    """
    maker = F.lower(F.split(F.btrim("camera_make"), " ")[0])
    version = F.coalesce("version", F.lit(0))
    since = modes.groupBy("maker").agg(F.array_sort(F.collect_set("since")).alias("_since")).withColumnRenamed("maker", "_of")
    held = codes.withColumn("_maker", maker).join(since, F.col("_maker") == F.col("_of"), "left").drop("_of")
    held = held.withColumn("_table", F.array_max(F.filter("_since", lambda s: s <= version))).drop("_since")
    names = modes.select(F.col("maker").alias("_maker"), F.col("since").alias("_table"), "code", "af_area_mode")
    return held.join(names, ["_maker", "_table", "code"], "left").drop("_maker", "_table")
