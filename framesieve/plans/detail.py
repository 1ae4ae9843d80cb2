"""Queries over metadata, reports, faces, pictures and lenses, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesieve.operators import faces, images, lenses, report
from framesieve.sources import metadata as meta
from framesieve.sources.tables import table


def _tags(spark, sf_dir):
    """EXIF tags from orders: times, fractions, lenses and positions, some missing or broken."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    text = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    pairs = {
        "EXIF DateTimeOriginal": F.when(n % 9 != 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")),
        "Image DateTime": F.when(n % 2 == 0, F.lit("2020:02:30 00:00:00")).otherwise(F.lit("2020:02:03 04:05:06")),
        "EXIF SubSecTimeOriginal": F.when(n % 5 == 0, text(n % 1000)).when(n % 31 == 0, F.lit("x")),
        "Image Make": F.lit("Canon"),
        "Image Model": text("Canon EOS R", n % 7),
        "EXIF LensModel": F.when(n % 4 == 0, F.lit("----")).when(n % 8 == 3, F.lit("Manual Lens")).when(n % 8 == 7, F.lit("NA")).when(n % 4 == 1, text("RF", n % 50 + 10, "mm F2")),
        "MakerNote LensType": F.when(n % 3 == 0, F.lit("61182")).otherwise(F.lit("Lens B")),
        "EXIF ISOSpeedRatings": F.when(n % 6 != 0, text(n % 100 * 50)),
        "EXIF ExposureTime": F.when(n % 8 == 0, F.lit("1/0")).otherwise(text("1/", n % 500 + 1)),
        "EXIF FNumber": text(n % 20 + 10, "/10"),
        "EXIF FocalLength": text(n % 90 + 10),
        "EXIF FocalLengthIn35mmFilm": F.when(n % 3 == 0, text((n % 90 + 10) * 2)),
        "EXIF FocalPlaneXResolution": F.lit("6000"),
        "EXIF FocalPlaneYResolution": F.lit("6000"),
        "EXIF ExifImageWidth": F.when(n % 7 == 0, F.lit("60000")).otherwise(F.lit("5400")),
        "EXIF ExifImageLength": F.lit("3600"),
        "GPS GPSLatitude": F.when(n % 2 == 0, text("[", n % 60, ", 30, 90/4]")),
        "GPS GPSLatitudeRef": F.when(n % 4 == 0, F.lit("S")).otherwise(F.lit("N")),
        "GPS GPSLongitude": F.when(n % 2 == 0, text("[", n % 400, ", 15, 0]")),
        "GPS GPSLongitudeRef": F.lit("E"),
        "EXIF ColorSpace": F.when(n % 5 == 1, F.lit("2")),
        "Interoperability InteroperabilityIndex": F.when(n % 10 == 1, F.lit("R98")),
    }
    return o.select(n.cast("string").alias("path"), F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))).alias("tags"))


_META_SQL = """meta AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS n,
  CASE WHEN o_orderkey % 9 <> 0 THEN date_trunc('second', o_orderdate) WHEN o_orderkey % 2 <> 0 THEN TIMESTAMP '2020-02-03 04:05:06' END AS base,
  'Canon' AS camera_make, 'Canon EOS R' || o_orderkey % 7 AS camera_model,
  CASE WHEN o_orderkey % 4 = 1 THEN 'RF' || (o_orderkey % 50 + 10) || 'mm F2' WHEN o_orderkey % 3 <> 0 THEN 'Lens B' END AS lens_model,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 100 * 50 AS INTEGER) END AS iso,
  CASE WHEN o_orderkey % 8 <> 0 THEN 1.0::DOUBLE / (o_orderkey % 500 + 1) END AS shutter_speed, (o_orderkey % 20 + 10)::DOUBLE / 10 AS aperture,
  (o_orderkey % 90 + 10)::DOUBLE AS focal_length,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 90 + 10)::DOUBLE * 2 WHEN o_orderkey % 7 <> 0 THEN
    round_even((o_orderkey % 90 + 10)::DOUBLE * (sqrt(1872.0::DOUBLE) / sqrt(pow(5400 / 6000.0::DOUBLE * 25.4::DOUBLE, 2) + pow(3600 / 6000.0::DOUBLE * 25.4::DOUBLE, 2))), 0) END AS focal_length_35mm,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END * ((o_orderkey % 60)::DOUBLE + 30.0::DOUBLE / 60 + 22.5::DOUBLE / 3600) END AS latitude,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 400 < 180 THEN (o_orderkey % 400)::DOUBLE + 15.0::DOUBLE / 60 END AS longitude,
  CASE WHEN o_orderkey % 10 = 1 THEN 'srgb' WHEN o_orderkey % 5 = 1 THEN 'adobergb' ELSE 'srgb' END AS colour_space FROM orders),
timed AS (SELECT *, CASE WHEN n % 5 = 0 THEN base + to_microseconds(CAST(rpad(CAST(n % 1000 AS VARCHAR), 6, '0') AS BIGINT)) WHEN n % 31 = 0 THEN NULL ELSE base END AS capture_time FROM meta)"""


def exif_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = meta.metadata(_tags(spark, sf_dir))
    return df.select(
        "path", F.date_format("capture_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("capture_time"), "camera_make", "camera_model",
        "lens_model", "iso", "shutter_speed", "aperture", "focal_length", "focal_length_35mm", F.round("latitude", 9).alias("latitude"),
        F.round("longitude", 9).alias("longitude"), "colour_space",
    )


def patched_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = meta.metadata(_tags(spark, sf_dir))
    side = df.select("path", F.lit(100).alias("iso"), F.lit("side lens").alias("lens_model"), F.lit(35.0).alias("focal_length_35mm"))
    return meta.patched(df, side.where("path % 2 = 0")).select("path", "iso", "lens_model", "focal_length_35mm")


def af_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AF modes of all orders by the package's table: three makers and one unknown, old and new records, codes without a name."""
    n = F.col("o_orderkey")
    make = F.get(F.array(*map(F.lit, ("Canon", "NIKON CORPORATION", "SONY", "Other"))), (n % 4).cast("int"))
    code = F.when(n % 3 == 0, 197 + n % 12).otherwise(n % 15)
    codes = table(spark, sf_dir, "orders").select(
        n.cast("string").alias("path"), make.alias("camera_make"), F.when(n % 5 > 0, (n % 5 * 100).cast("int")).alias("version"), code.alias("code")
    )
    return meta.af_mode(codes, meta.af_mode_table(spark)).select("path", "af_area_mode")


def shot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = meta.metadata(_tags(spark, sf_dir))
    return df.select("path", report.facts().alias("facts"))


def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    current = F.to_json(F.struct((n % 5).alias("exposure"), F.concat(F.lit("c"), n.cast("string")).alias("crop"), F.lit(1).alias("gone")))
    applied = F.to_json(F.struct(F.when(n % 3 == 0, n % 7).alias("exposure"), F.lit("other").alias("crop")))
    merged = report.merge_settings(current, applied, ["crop"], "exposure long, crop string")
    return o.select(n.alias("id"), merged.alias("settings"))


# -- faces: orders are frames, their line items faces ------------------------------------------------------------------


def _faces(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    # Line numbers repeat within an order, so faces are numbered by all that tells them apart.
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_discount", "l_quantity")
    return li.select(
        F.col("l_orderkey").alias("frame_id"), (k % 900).cast("double").alias("x"), (k % 500).cast("double").alias("y"),
        (k % 80 + 20).cast("double").alias("w"), (k % 70 + 24).cast("double").alias("h"), (F.lit(0.5) + F.col("l_discount") * 5).alias("score"),
        (k % 17).cast("double").alias("contrast"), F.col("l_quantity").alias("energy"), F.row_number().over(place).alias("idx"),
    )


_FACES_SQL = """WITH f AS (SELECT l_orderkey AS frame_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_discount, l_quantity) AS INTEGER) AS idx, (l_partkey % 900)::DOUBLE AS x, (l_partkey % 500)::DOUBLE AS y, (l_partkey % 80 + 20)::DOUBLE AS w,
  (l_partkey % 70 + 24)::DOUBLE AS h, 0.5::DOUBLE + l_discount * 5 AS score, (l_partkey % 17)::DOUBLE AS contrast, l_quantity AS energy FROM lineitem)"""


def top_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.top_faces(_faces(spark, sf_dir), 2).select("frame_id", "idx", "prominence")


def main_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.main_face(_faces(spark, sf_dir))


def central_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.central_face(_faces(spark, sf_dir), 1000.0, 600.0)


def nearest_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), (F.col("o_custkey") % 1000).cast("double").alias("x"), F.lit(300.0).alias("y"))
    return faces.nearest_face(points, _faces(spark, sf_dir))


# -- pictures: embeddings as 8 by 8 pictures, enlarged -----------------------------------------------------------------


def _levels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.5) * 255).cast("int")))
    return e.select(F.col("vec_id").alias("frame_id"), F.lit("luma").alias("channel"), F.explode(F.transform("embedding", level)).alias("level"))


_LEVELS_SQL = "WITH l AS (SELECT vec_id AS frame_id, 'luma' AS channel, greatest(0, least(255, CAST(floor((x::DOUBLE + 0.5::DOUBLE) * 255) AS INTEGER))) AS level FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)), c AS (SELECT frame_id, channel, level, count(*) AS n FROM l GROUP BY 1, 2, 3)"


def face_area_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    sizes = table(spark, sf_dir, "orders").select(n.alias("frame_id"), F.when(n % 9 == 0, 0).otherwise(1000 + n % 50).alias("width"), F.lit(600).alias("height"))
    found = faces.main_face_ratios(_faces(spark, sf_dir), sizes)
    return found.withColumn("face_area_ratio", F.round("face_area_ratio", 12))


def exif_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of all orders' tags, whole ones and short ones; focal lengths and apertures with places of their own."""
    n = F.col("path").cast("long")
    df = meta.metadata(_tags(spark, sf_dir)).withColumns({
        "name": F.concat("path", F.lit(".arw")), "focal_length": F.when(n % 10 > 0, F.col("focal_length") + n % 977 / 977), "aperture": F.col("aperture") + n % 3 / 8192
    })
    whole, short = report.caption(custom="studio"), report.caption(["lens", "focal_length"], known=n % 4 > 0)
    return df.select("path", whole["left"].alias("caption"), whole["right"].alias("custom"), short["left"].alias("short"))


def _tiled_pictures(spark, sf_dir):
    """Gray pictures of 50 by 35 pixels from embeddings, every eleventh of 40 by 35, whose tiles are too small."""
    width = F.when(F.col("vec_id") % 11 == 5, 40).otherwise(50)
    number = lambda k: F.get("embedding", (k % 64).cast("int")).cast("double")
    level = lambda i: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((number(i * i + F.floor(i / 7)) + 0.5) * 255).cast("int")))
    shown = F.transform(F.sequence(F.lit(0), width * 35 - 1), lambda i: F.lpad(F.hex(level(i).cast("long")), 2, "0"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("path"), F.lit(35).alias("height"), width.alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(shown, "")).alias("data"),
        F.lit(0.25).alias("scale"), (width * 4).alias("full_width"), F.lit(140).alias("full_height"),
    )


_TILED_SQL = """WITH px AS (SELECT vec_id, i, CASE WHEN vec_id % 11 = 5 THEN 40 ELSE 50 END AS width, embedding FROM embeddings, (SELECT unnest(range(0, 1750)) AS i)),
v AS (SELECT vec_id, i // 50 // 8 AS tr, i % 50 // 8 AS tc, i // 50 AS r, i % 50 AS c, greatest(0, least(255, CAST(floor((embedding[(i * i + i // 7) % 64 + 1]::DOUBLE + 0.5::DOUBLE) * 255) AS INTEGER))) AS v
  FROM px WHERE width = 50 AND i // 50 < 32 AND i % 50 < 48),
side AS (SELECT *, coalesce(lag(v) OVER w, lead(v) OVER w) AS l, coalesce(lead(v) OVER w, lag(v) OVER w) AS o FROM v WINDOW w AS (PARTITION BY vec_id, tr, tc, r ORDER BY c)),
near AS (SELECT *, coalesce(lag(v) OVER w, lead(v) OVER w) AS u, coalesce(lag(l) OVER w, lead(l) OVER w) AS ul, coalesce(lag(o) OVER w, lead(o) OVER w) AS uo,
  coalesce(lead(v) OVER w, lag(v) OVER w) AS d, coalesce(lead(l) OVER w, lag(l) OVER w) AS dl, coalesce(lead(o) OVER w, lag(o) OVER w) AS dq FROM side WINDOW w AS (PARTITION BY vec_id, tr, tc, c ORDER BY r)),
energy AS (SELECT vec_id, tr, tc, sum(pow((uo + 2 * o + dq) - (ul + 2 * l + dl), 2) + pow((dl + 2 * d + dq) - (ul + 2 * u + uo), 2)) AS e FROM near GROUP BY 1, 2, 3),"""

_TILE_BOX_SQL = """spread AS (SELECT vec_id, (tc * 8 - 2) * 4 AS x, (tr * 8 - 2) * 4 AS y FROM best),
box AS (SELECT vec_id, greatest(0, x) AS x, greatest(0, y) AS y, least(200, x + 48) - greatest(0, x) AS w, least(140, y + 48) - greatest(0, y) AS h FROM spread)"""


def subject_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.tile_boxes(_tiled_pictures(spark, sf_dir))
    return found.select("path", *(F.col("box")[c].alias(c) for c in "xywh"))


def background_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pictures with a face each, in every seventh so large that no tile is left."""
    k = F.col("vec_id")
    big = k % 7 == 0
    boxes = table(spark, sf_dir, "embeddings").select(
        k.cast("string").alias("path"), F.when(big, 0).otherwise(k % 40).alias("x"), F.when(big, 0).otherwise(k % 20).alias("y"), F.when(big, 50).otherwise(10).alias("w"), F.when(big, 35).otherwise(12).alias("h")
    )
    found = images.tile_boxes(_tiled_pictures(spark, sf_dir), boxes)
    return found.select("path", *(F.col("box")[c].alias(c) for c in "xywh"))


def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.histogram(_levels(spark, sf_dir)).withColumn("height", F.round("height", 9))


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.exposure(images.histogram(_levels(spark, sf_dir)))
    return found.select("frame_id", *(F.round(c, 9).alias(c) for c in ("mean_luma", "clipped_highlights", "clipped_shadows")))


def tone_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.tone_quantiles(images.histogram(_levels(spark, sf_dir)))
    return found.select("frame_id", F.posexplode("q").alias("step", "level")).withColumn("level", F.round("level", 6))


def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray pictures of 32 by 36 pixels from embeddings: blocks of one number with the grain of others; some are cut short."""
    r, c = (lambda i: F.floor(i / 36)), (lambda i: i % 36)
    number = lambda k: F.get("embedding", k.cast("int")).cast("double")
    block = lambda i: number(F.floor(r(i) / 4) * 8 + F.floor(c(i) * 8 / 36))
    grain = lambda i: number((r(i) * 7 + c(i) * 13 + r(i) * c(i) % 11) % 64)
    level = lambda i: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((block(i) * 0.8 + grain(i) * 0.2 + 0.5) * 255).cast("int")))
    shown = F.transform(F.sequence(F.lit(0), F.lit(32 * 36 - 1)), lambda i: F.lpad(F.hex(level(i).cast("long")), 2, "0"))
    data = F.unhex(F.array_join(F.when(F.col("vec_id") % 50 == 7, F.slice(shown, 1, 100)).otherwise(shown), ""))
    pictures = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("/p/"), F.col("vec_id").cast("string")).alias("path"), F.lit(32).alias("height"), F.lit(36).alias("width"), F.lit(1).alias("channels"), data.alias("data")
    )
    found = images.features(pictures, tile=24)
    measures = ("mean_luma", "clipped_highlights", "clipped_shadows", "noise", "laplacian", "tenengrad", "sharpness")
    return found.select("path", F.col("error").isNotNull().alias("failed"), "dhash", *(F.round(m, 6).alias(m) for m in measures))


_FEATURES_SQL = """WITH g AS (SELECT CAST(unnest(range(0, 1152)) AS INTEGER) AS i),
px AS MATERIALIZED (SELECT vec_id, i // 36 AS r, i % 36 AS c, greatest(0, least(255, CAST(floor((embedding[(i // 36) // 4 * 8 + (i % 36) * 8 // 36 + 1]::DOUBLE * 0.8::DOUBLE
  + embedding[((i // 36) * 7 + (i % 36) * 13 + (i // 36) * (i % 36) % 11) % 64 + 1]::DOUBLE * 0.2::DOUBLE + 0.5::DOUBLE) * 255) AS INTEGER))) AS v
  FROM embeddings, g WHERE vec_id % 50 <> 7),
side AS (SELECT vec_id, r, c, v, coalesce(lag(v) OVER w, lead(v) OVER w) AS l, coalesce(lead(v) OVER w, lag(v) OVER w) AS o FROM px WINDOW w AS (PARTITION BY vec_id, r ORDER BY c)),
near AS (SELECT *, coalesce(lag(v) OVER w, lead(v) OVER w) AS u, coalesce(lag(l) OVER w, lead(l) OVER w) AS ul, coalesce(lag(o) OVER w, lead(o) OVER w) AS uo,
  coalesce(lead(v) OVER w, lag(v) OVER w) AS d, coalesce(lead(l) OVER w, lag(l) OVER w) AS dl, coalesce(lead(o) OVER w, lag(o) OVER w) AS dq FROM side WINDOW w AS (PARTITION BY vec_id, c ORDER BY r)),
st AS MATERIALIZED (SELECT vec_id, r, c, v, u + d + l + o - 4 * v AS lap, (uo + 2 * o + dq) - (ul + 2 * l + dl) AS gx, (dl + 2 * d + dq) - (ul + 2 * u + uo) AS gy,
  abs((ul - 2 * u + uo) - 2 * (l - 2 * v + o) + (dl - 2 * d + dq)) AS mask FROM near),
tiles AS (SELECT y, x FROM (SELECT unnest([0, 2, 4, 6, 8]) AS y), (SELECT unnest([0, 3, 6, 9, 12]) AS x)),
tiled AS (SELECT vec_id, y, x, 1.4826::DOUBLE * median(mask) / 6 AS n FROM st JOIN tiles ON r >= y AND r < y + 24 AND c >= x AND c < x + 24 GROUP BY 1, 2, 3),
noise AS (SELECT vec_id, median(n) AS s FROM tiled GROUP BY 1),
small AS (SELECT vec_id, r // 4 AS y, c // 4 AS x, round_even(sum(v) / 16::DOUBLE, 0) AS m FROM px GROUP BY 1, 2, 3),
bits AS (SELECT vec_id, y, x, lead(m) OVER (PARTITION BY vec_id, y ORDER BY x) > m AS b FROM small),
hash AS (SELECT vec_id, sum(CASE WHEN b THEN CAST(1 AS HUGEINT) << CAST(63 - y * 8 - x AS INTEGER) ELSE 0 END) AS h FROM bits WHERE x < 8 GROUP BY 1),
whole AS (SELECT vec_id, avg(v) AS mean, avg(CASE WHEN v >= 250 THEN 1.0::DOUBLE ELSE 0.0 END) AS high, avg(CASE WHEN v <= 5 THEN 1.0::DOUBLE ELSE 0.0 END) AS low,
  var_pop(v) AS var, var_pop(lap) AS lap, avg(gx * gx + gy * gy) AS ten FROM st GROUP BY 1),
net AS (SELECT *, CASE WHEN var - s * s < 25 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, lap - 20 * s * s) / (var - s * s) END AS a,
  CASE WHEN var - s * s < 25 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, ten - 24 * s * s) / (var - s * s) END AS b FROM whole JOIN noise USING (vec_id)),
sat AS (SELECT *, 100 * a / (a + 0.053::DOUBLE) AS la, 100 * b / (b + 1.63::DOUBLE) AS te FROM net)
SELECT '/p/' || e.vec_id AS path, e.vec_id % 50 = 7 AS failed, CAST(CASE WHEN h >= CAST(1 AS HUGEINT) << 63 THEN h - (CAST(1 AS HUGEINT) << 64) ELSE h END AS BIGINT) AS dhash,
  round(mean, 6) AS mean_luma, round(high, 6) AS clipped_highlights, round(low, 6) AS clipped_shadows, round(s, 6) AS noise, round(la, 6) AS laplacian, round(te, 6) AS tenengrad,
  round(0.4::DOUBLE * la + 0.6::DOUBLE * te, 6) AS sharpness FROM embeddings e LEFT JOIN sat USING (vec_id) LEFT JOIN hash USING (vec_id)"""


# -- lenses: parts as a catalogue --------------------------------------------------------------------------------------


def _catalogue(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    low = F.col("p_partkey") % 90 + 10
    return p.select(
        F.col("p_brand").alias("maker"), F.concat(low.cast("string"), F.lit("-"), (low * 3).cast("string"), F.lit("mm f/"), (F.col("p_partkey") % 5 + 2).cast("string")).alias("model"),
        low.cast("double").alias("min_focal"), (low * 3).cast("double").alias("max_focal"),
    )


_CATALOGUE_SQL = "cat AS (SELECT p_brand AS maker, (p_partkey % 90 + 10) || '-' || (p_partkey % 90 + 10) * 3 || 'mm f/' || (p_partkey % 5 + 2) AS model, (p_partkey % 90 + 10)::DOUBLE AS low FROM part)"


def lens_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, low = F.col("o_orderkey"), F.col("o_orderkey") % 90 + 10
    name = F.concat(F.when(n % 3 == 0, "E ").when(n % 3 == 1, "RF").otherwise(""), low.cast("string"), F.lit("-"), (low * 3).cast("string"), F.lit("mm F"), (n % 6 + 2).cast("string"), F.when(n % 2 == 0, " A069").otherwise(""))
    shots = table(spark, sf_dir, "orders").select(n.alias("id"), F.when(n % 11 != 0, name).alias("lens_model"), F.when(n % 7 == 0, 900.0).otherwise(low.cast("double")).alias("focal_length"))
    return lenses.match_lenses(shots, _catalogue(spark, sf_dir)).select("id", "matched_model", "reason")


def camera_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    model = F.concat(F.lit("EOS R"), (n % 9).cast("string"), F.when(n % 2 == 0, " Mark III").otherwise(""))
    df = table(spark, sf_dir, "orders").select(n.alias("id"), lenses.camera_variants(model, F.when(n % 3 == 0, "CANON").otherwise("")).alias("v"))
    return df.select("id", F.posexplode("v").alias("pos", "variant"))


def available_lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.available_lenses(_catalogue(spark, sf_dir), "mm F/3", "brand#7", 40)


def catalogue_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.coverage(_catalogue(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        exif_metadata, patched_metadata, af_modes, shot_facts, settings_merge, top_faces, main_face, central_face,
        nearest_face, face_area_ratios, exif_captions, subject_tiles, background_boxes, level_histogram, exposure, tone_quantiles, image_features, lens_match, camera_variants, available_lenses,
        catalogue_coverage,
    )
}

ORACLES = {
    "exif_metadata": f"WITH {_META_SQL} SELECT path, strftime(capture_time, '%Y-%m-%d %H:%M:%S.%f') AS capture_time, camera_make, camera_model, lens_model, iso, shutter_speed, aperture, focal_length, focal_length_35mm, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, colour_space FROM timed",
    "patched_metadata": f"WITH {_META_SQL} SELECT path, CASE WHEN n % 2 = 0 THEN coalesce(iso, 100) ELSE iso END AS iso, CASE WHEN n % 2 = 0 THEN coalesce(lens_model, 'side lens') ELSE lens_model END AS lens_model, CASE WHEN n % 2 = 0 THEN coalesce(focal_length_35mm, 35.0::DOUBLE) ELSE focal_length_35mm END AS focal_length_35mm FROM meta",
    "af_modes": """WITH c AS (SELECT o_orderkey AS n, o_orderkey % 5 * 100 AS v, CASE WHEN o_orderkey % 3 = 0 THEN 197 + o_orderkey % 12 ELSE o_orderkey % 15 END AS code FROM orders)
SELECT CAST(n AS VARCHAR) AS path, CASE n % 4
  WHEN 0 THEN CASE code WHEN 0 THEN 'Off (Manual Focus)' WHEN 1 THEN 'AF Point Expansion (surround)' WHEN 2 THEN 'Single-point AF' WHEN 4 THEN 'Auto' WHEN 5 THEN 'Face Detect AF'
    WHEN 6 THEN 'Face + Tracking' WHEN 7 THEN 'Zone AF' WHEN 8 THEN 'AF Point Expansion (4 point)' WHEN 9 THEN 'Spot AF' WHEN 10 THEN 'AF Point Expansion (8 point)'
    WHEN 11 THEN 'Flexizone Multi (49 point)' WHEN 12 THEN 'Flexizone Multi (9 point)' WHEN 13 THEN 'Flexizone Single' WHEN 14 THEN 'Large Zone AF' END
  WHEN 1 THEN CASE WHEN v >= 300 THEN CASE code WHEN 197 THEN 'Auto-area' WHEN 207 THEN '3D-tracking' WHEN 208 THEN 'Wide (C1/C2)' END
    ELSE CASE code WHEN 0 THEN 'Single Area' WHEN 4 THEN 'Dynamic Area (9 points)' WHEN 14 THEN 'Dynamic Area (25 points)' END END
  WHEN 2 THEN CASE code WHEN 11 THEN 'Zone' END END AS af_area_mode FROM c""",
    "shot_facts": f"WITH {_META_SQL} SELECT path, concat_ws(' | ', camera_model, CAST(focal_length AS BIGINT) || 'mm' || CASE WHEN abs(focal_length_35mm - focal_length) > 0.02::DOUBLE * focal_length THEN ' (' || CAST(focal_length_35mm AS BIGINT) || 'mm)' ELSE '' END, concat_ws(' ', CASE WHEN shutter_speed IS NULL THEN '-' WHEN shutter_speed < 1 THEN '1/' || CAST(round_even(1 / shutter_speed, 0) AS BIGINT) || 's' ELSE '1s' END, 'f/' || printf('%.1f', aperture), 'ISO ' || iso), printf('%.3f', latitude) || ', ' || printf('%.3f', longitude)) AS facts FROM meta",
    "settings_merge": """SELECT o_orderkey AS id, '{"exposure":' || CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 ELSE o_orderkey % 5 END || ',"crop":"c' || o_orderkey || '"}' AS settings FROM orders""",
    "top_faces": f"{_FACES_SQL} SELECT frame_id, idx, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY w * h * score DESC, idx) AS INTEGER) AS prominence FROM f QUALIFY prominence <= 2",
    "main_face": f"""{_FACES_SQL}, a AS (SELECT *, max(score >= 0.75) OVER (PARTITION BY frame_id) AS sure FROM f), b AS (SELECT *, max(contrast >= 8) OVER (PARTITION BY frame_id) AS rich FROM a WHERE NOT sure OR score >= 0.75),
c AS (SELECT * FROM b WHERE NOT rich OR contrast >= 8 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY w * h * score DESC, idx) <= 8), d AS (SELECT *, max(sqrt(energy)) OVER (PARTITION BY frame_id) AS best FROM c)
SELECT frame_id, first(idx ORDER BY w * h * score DESC, idx) AS main_face FROM d WHERE sqrt(energy) >= 0.85::DOUBLE * best GROUP BY 1""",
    "central_face": f"""{_FACES_SQL}, m AS (SELECT *, round(0.25::DOUBLE * (sqrt(w * h) / max(sqrt(w * h)) OVER (PARTITION BY frame_id)) + greatest(0.0::DOUBLE, 1.0::DOUBLE - sqrt(pow((x + w / 2 - 500) / 500, 2) + pow((y + h / 2 - 300) / 300, 2)))
  + 0.25::DOUBLE * (sqrt(energy) / max(sqrt(energy)) OVER (PARTITION BY frame_id)), 9) AS mark FROM f) SELECT frame_id, first(idx ORDER BY mark DESC, idx) AS main_face FROM m GROUP BY 1""",
    "nearest_face": f"{_FACES_SQL}, p AS (SELECT o_orderkey AS frame_id, (o_custkey % 1000)::DOUBLE AS px FROM orders) SELECT frame_id, first(idx ORDER BY pow(x + w / 2 - px, 2) + pow(y + h / 2 - 300, 2), idx) AS af_face FROM f JOIN p USING (frame_id) GROUP BY 1",
    "face_area_ratios": f"""{_FACES_SQL}, a AS (SELECT *, max(score >= 0.75) OVER (PARTITION BY frame_id) AS sure FROM f), b AS (SELECT *, max(contrast >= 8) OVER (PARTITION BY frame_id) AS rich FROM a WHERE NOT sure OR score >= 0.75),
c AS (SELECT * FROM b WHERE NOT rich OR contrast >= 8 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY w * h * score DESC, idx) <= 8), d AS (SELECT *, max(sqrt(energy)) OVER (PARTITION BY frame_id) AS best FROM c),
m AS (SELECT frame_id, arg_min(struct_pack(idx := idx, area := w * h), struct_pack(p := -w * h * score, i := idx)) AS face FROM d WHERE sqrt(energy) >= 0.85::DOUBLE * best GROUP BY 1)
SELECT frame_id, face.idx AS main_face, CASE WHEN frame_id % 9 <> 0 THEN round(face.area / ((1000 + frame_id % 50) * 600::DOUBLE), 12) END AS face_area_ratio FROM m JOIN orders ON o_orderkey = frame_id""",
    "exif_captions": f"""WITH {_META_SQL}, c AS (SELECT *, CASE WHEN n % 10 > 0 THEN printf('%g', focal_length + (n % 977)::DOUBLE / 977) || 'mm' END AS focal, 'f/' || printf('%g', aperture + (n % 3)::DOUBLE / 8192) AS f FROM timed)
SELECT path, concat_ws('  ·  ', path || '.arw', camera_model, lens_model, focal, f, CASE WHEN shutter_speed < 1 THEN '1/' || CAST(round_even(1 / shutter_speed, 0) AS BIGINT) || 's' WHEN shutter_speed >= 1 THEN '1s' END, CASE WHEN iso <> 0 THEN 'ISO ' || iso END, strftime(capture_time, '%Y-%m-%d %H:%M')) AS caption,
  'studio' AS custom, CASE WHEN n % 4 = 0 THEN path || '.arw' ELSE concat_ws('  ·  ', lens_model, focal) END AS short FROM c""",
    "subject_tiles": f"""{_TILED_SQL} best AS (SELECT vec_id, tr, tc FROM energy QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, tr, tc) = 1), {_TILE_BOX_SQL}
SELECT CAST(e.vec_id AS VARCHAR) AS path, CAST(coalesce(x, 0) AS INTEGER) AS x, CAST(coalesce(y, 0) AS INTEGER) AS y, CAST(coalesce(w, 160) AS INTEGER) AS w, CAST(coalesce(h, 140) AS INTEGER) AS h FROM embeddings e LEFT JOIN box USING (vec_id)""",
    "background_boxes": f"""{_TILED_SQL} best AS (SELECT vec_id, tr, tc FROM energy WHERE vec_id % 7 <> 0 AND NOT (tc * 8 < vec_id % 40 + 10 AND vec_id % 40 < tc * 8 + 8 AND tr * 8 < vec_id % 20 + 12 AND vec_id % 20 < tr * 8 + 8)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, tr, tc) = 1), {_TILE_BOX_SQL}
SELECT CAST(e.vec_id AS VARCHAR) AS path, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h FROM embeddings e LEFT JOIN box USING (vec_id)""",
    "level_histogram": f"{_LEVELS_SQL} SELECT frame_id, channel, level, n, round(ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY frame_id)), 9) AS height FROM c",
    "exposure": f"{_LEVELS_SQL} SELECT frame_id, round(avg(level), 9) AS mean_luma, round(avg(CASE WHEN level >= 250 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS clipped_highlights, round(avg(CASE WHEN level <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS clipped_shadows FROM l GROUP BY 1",
    "tone_quantiles": f"{_LEVELS_SQL}, q AS (SELECT frame_id, quantile_cont(level::DOUBLE, [{', '.join(repr(0.02 + 0.96 * i / 15) for i in range(16))}]) AS q FROM l GROUP BY 1) SELECT frame_id, CAST(unnest(range(0, 16)) AS INTEGER) AS step, round(unnest(q), 6) AS level FROM q",
    "image_features": _FEATURES_SQL,
    "lens_match": f"""WITH {_CATALOGUE_SQL}, s AS (SELECT o_orderkey AS id, o_orderkey % 11 = 0 AS unnamed, o_orderkey % 7 = 0 AS far, o_orderkey % 90 + 10 AS low, (o_orderkey % 90 + 10) || '-' || (o_orderkey % 90 + 10) * 3 || 'mm f/' || (o_orderkey % 6 + 2) AS model FROM orders),
k AS (SELECT DISTINCT model FROM cat) SELECT id, CASE WHEN NOT unnamed AND NOT far THEN k.model END AS matched_model, CASE WHEN unnamed THEN 'no_name' WHEN k.model IS NULL THEN 'unknown_lens' WHEN far THEN 'focal_differs' ELSE 'ok' END AS reason FROM s LEFT JOIN k USING (model)""",
    "camera_variants": """WITH v AS (SELECT o_orderkey AS id, 'EOS R' || o_orderkey % 9 AS a, o_orderkey % 2 = 0 AS m FROM orders), l AS (SELECT id, CASE WHEN m THEN [a || ' Mark III', a || 'm3', 'Canon ' || a || ' Mark III', 'Canon ' || a || 'm3'] ELSE [a, 'Canon ' || a] END AS x FROM v)
SELECT id, CAST(unnest(range(0, len(x))) AS INTEGER) AS pos, unnest(x) AS variant FROM l""",
    "available_lenses": f"WITH {_CATALOGUE_SQL} SELECT maker, maker || ' ' || model AS label FROM (SELECT DISTINCT maker, model FROM cat WHERE contains(lower(maker || ' ' || model), 'mm f/3')) ORDER BY CASE WHEN lower(maker) = 'brand#7' THEN 0 ELSE 1 END, lower(label), label LIMIT 40",
    "catalogue_coverage": f"WITH {_CATALOGUE_SQL} SELECT count(DISTINCT maker) AS makers, count(*) AS lenses FROM cat",
}
