"""Queries over reports, filters, boxes, regions, files read back, and bodies of a catalogue, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.config import ScoreConfig
from framesieve.operators import calibrate, export, faces, grade, images, lenses, places, report, review, score
from framesieve.plans.archive import _EDITED_SQL, _UNDO_SQL, _edited, _entries, _log, _samples
from framesieve.plans.detail import _CATALOGUE_SQL, _FACES_SQL, _META_SQL, _catalogue, _faces, _tags
from framesieve.plans.grading import _GRADED, _PLACES, _REASON_ROWS, _graded
from framesieve.sources import files, shared
from framesieve.sources import metadata as meta
from framesieve.sources.tables import FRAMES_SQL, frames, table


def _new_path(spark, tag: str) -> str:
    return f"{shared.folder(spark)}/{tag}-{uuid.uuid4().hex}"


# -- reports -----------------------------------------------------------------------------------------------------------


def _reported(spark, sf_dir):
    """Graded frames with their reasons and the shot data of the order of their number."""
    df = review.with_final(_graded(spark, sf_dir))
    tags = meta.metadata(_tags(spark, sf_dir)).select(
        F.col("path").cast("long").alias("_n"), "lens_model", "iso", "shutter_speed"
    )
    df = df.join(tags, df["input_order"] == tags["_n"], "left").drop("_n")
    return report.with_reasons(df, grade.reasons(df))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_rows(_reported(spark, sf_dir))


def report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.json_rows(_reported(spark, sf_dir))
    return found.withColumn("reasons", F.array_join("reasons", "; "))


_REPORT_SQL = f"""{_GRADED}, {_META_SQL}, r AS ({_REASON_ROWS}),
texts AS (SELECT path, string_agg(reason, '; ' ORDER BY k) AS reasons FROM r GROUP BY 1),
rep AS (SELECT g.*, m.lens_model, m.iso, m.shutter_speed, texts.reasons,
  CASE WHEN g.capture_time IS NOT NULL THEN regexp_replace(strftime(g.capture_time, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') END AS taken,
  CASE WHEN m.shutter_speed IS NULL THEN '-' WHEN m.shutter_speed < 1 THEN '1/' || CAST(round_even(1 / m.shutter_speed, 0) AS BIGINT) || 's' ELSE '1s' END AS shutter
  FROM graded g LEFT JOIN meta m ON m.n = g.input_order LEFT JOIN texts ON texts.path = g.path)"""


def results_by_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written by place and grade, read back and counted."""
    df = places.with_places(frames(spark, sf_dir)).join(_graded(spark, sf_dir).select("path", "grade"), "path")
    path = _new_path(spark, "by-grade")
    label = F.when(F.col("place_id").isNull(), "none").otherwise(F.concat(F.lit("p"), F.col("place_id").cast("string")))
    report.write_by_grade(df.select("path", label.alias("place_label"), "grade"), path)
    read = spark.read.schema("path string, place_label string, grade string").parquet(path)
    return read.groupBy("place_label", "grade").agg(F.count("*").alias("frames"))


# -- filters -----------------------------------------------------------------------------------------------------------


def kept_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.by_grade(_edited(spark, sf_dir), "keep").select("batch_id", "path")


def failed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.failed(frames(spark, sf_dir)).select("path", "error")


def located_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.not_raw(review.located(frames(spark, sf_dir))).select("path")


def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.first_failures(frames(spark, sf_dir))


def raw_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.raw_count(frames(spark, sf_dir))


def face_size_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = score.score_lines(frames(spark, sf_dir), ScoreConfig(bonus_face_size=8.0))
    return lines.where("key = 'face_size'").select("path", F.round("value", 9).alias("value"))


# -- exports and files -------------------------------------------------------------------------------------------------


def export_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are kept, so they are unique within a folder; what is left are the folders by place and grade."""
    df = _edited(spark, sf_dir).withColumns(
        {"stem": F.regexp_replace("name", r"\.[^.]*$", ""), "suffix": F.regexp_extract("name", r"\.[^.]*$", 0)}
    )
    # Graded once, placed once; the plan, the listing and the labels come from it.
    df = df.select("batch_id", "path", "name", "input_order", "final_grade", "capture_time", "score", "stem", "suffix", "latitude", "longitude")
    df = shared.stored(places.with_places(shared.stored(df, "export-frames")), "export-placed")
    named = df.select("batch_id", "place_id", F.format_string("p%02d", "place_id").alias("label")).where("place_id is not null").distinct()
    operations, _ = export.plan(df, df.select("path"), "/out", "{name}", ["keep"], places=named)
    return operations.select("source", "destination")


def log_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations written as a log and read again."""
    log, _ = _log(spark, sf_dir)
    path = _new_path(spark, "log")
    rows = log.select(F.col("pos").alias("index"), "source", "destination", F.lit("keep").alias("grade"), "rendered")
    files.write_log(rows, path, "2024-01-01T00:00:00", "copy", "/o")
    return files.read_logs(spark, path).select("pos", "mode", "root", "source", "destination", "rendered")


def queue_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue written and read again; entries without a source are skipped."""
    path = _new_path(spark, "queue")
    n = F.col("seq")
    rows = _entries(spark, sf_dir).withColumn("source", F.when(n % 7 == 0, None).when(n % 11 == 0, "").otherwise(F.col("source")))
    files.write_queue(rows, path)
    return files.read_queue(spark, path).select("seq", "source", "preset_name")


def calibrations_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New calibrations over old ones, without removed keys, written and read again; bad gains are no calibrations."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cam"), k.cast("string")).alias("key"), F.concat(F.lit("Cam "), k.cast("string")).alias("camera"),
        F.when(k % 5 == 0, F.array(F.lit(1.0), F.lit(1.0))).when(k % 5 == 1, F.array(F.lit(0.4), F.lit(1.0), F.lit(1.0)))
        .otherwise(F.array(F.lit(1.1), F.lit(1.0), F.lit(0.9))).alias("gain"),
        (k % 9).cast("int").alias("samples"), k.alias("k"),
    )
    old, new = rows.where("k % 3 <> 0").drop("k"), rows.where("k % 2 = 0").withColumn("samples", F.lit(12)).drop("k")
    path = _new_path(spark, "calibrations")
    files.write_calibrations(old, new, path, rows.where("k % 8 = 4").select("key"))
    found = spark.read.schema(files.CALIBRATION).json(path)
    return calibrate.valid_gains(found).select("key", "samples", F.element_at("gain", 1).alias("first_gain"))


def lens_catalogue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two XML catalogues written from the parts, read as layers."""
    both = []
    for layer in (0, 1):
        path = _new_path(spark, "lenses")
        names = F.array(F.struct(F.col("model").alias("_VALUE"), F.lit(None).cast("string").alias("_lang")))
        rows = _catalogue(spark, sf_dir).where(F.col("min_focal") % 2 == layer).select(
            "maker", names.alias("model"), F.array(F.lit("E"), F.lit("Z")).alias("mount"), F.lit(1.5).alias("cropfactor"),
            F.struct(F.col("min_focal").alias("_min"), F.col("max_focal").alias("_max")).alias("focal"),
        )
        rows.write.format("xml").option("rowTag", "lens").option("rootTag", "lensdatabase").save(path)
        both.append(path)
    found = lenses.read_lenses(spark, *both)
    return found.groupBy("layer", "maker", "model").agg(F.count("*").alias("n"), F.max("min_focal").alias("low"), F.max("max_focal").alias("high"), F.max(F.size("mounts")).alias("mounts"))


# -- boxes and regions -------------------------------------------------------------------------------------------------


def _boxed(spark, sf_dir):
    k = F.col("l_partkey")
    box = F.struct(
        ((k * 7) % 900 - 20 + F.col("l_discount")).alias("x"), ((k * 3) % 700 - 15 + 0.5).alias("y"),
        ((k % 90) + F.col("l_quantity") / 4).alias("w"), ((k % 70) + 1.5).alias("h"),
    )
    turn = F.element_at(F.array(*map(F.lit, (1, 3, 6, 8))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), k.alias("part"), F.col("l_discount").alias("d"), F.col("l_quantity").alias("q"),
        F.col("l_suppkey").alias("s"), box.alias("box"), turn.alias("turn"), F.lit(900).alias("width"), F.lit(600).alias("height"), F.lit(450).alias("pw"), F.lit(337).alias("ph"),
    )


_BOX_SQL = """b AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_discount AS d, l_quantity AS q, l_suppkey AS s,
  ((l_partkey * 7) % 900 - 20)::DOUBLE + l_discount AS x, ((l_partkey * 3) % 700 - 15)::DOUBLE + 0.5::DOUBLE AS y, (l_partkey % 90)::DOUBLE + l_quantity / 4 AS w, (l_partkey % 70)::DOUBLE + 1.5::DOUBLE AS h,
  ([1, 3, 6, 8])[l_suppkey % 4 + 1] AS turn FROM lineitem)"""


def _flat(df, name="found"):
    return df.select("id", "line", "part", "s", "d", "q", *(F.col(name)[c].alias(c) for c in "xywh"))


def rotated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_boxed(spark, sf_dir).withColumn("found", faces.rotate_box("box", "turn", "width", "height")))


def preview_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_boxed(spark, sf_dir).withColumn("found", faces.scale_box("box", ("width", "height"), ("pw", "ph"))))


def clipped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_boxed(spark, sf_dir).withColumn("found", faces.clip_box("box", "width", "height")))


def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.struct(F.lit(300.0).alias("x"), F.lit(200.0).alias("y"), F.lit(150.0).alias("w"), F.lit(150.0).alias("h"))
    df = _boxed(spark, sf_dir).withColumn("tile", other).where(faces.overlap("box", "tile"))
    return df.groupBy("id").agg(F.count("*").alias("boxes"))


def main_face_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen face's box as shares of the picture; the choice may be none or name no face."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("idx", "x", "y", "w", "h"))), lambda f: F.struct(f["x"].alias("x"), f["y"].alias("y"), f["w"].alias("w"), f["h"].alias("h")))
    df = _faces(spark, sf_dir).groupBy("frame_id").agg(cells.alias("faces"))
    df = df.withColumns({"main": (F.col("frame_id") % 4 - 1).cast("int"), "width": F.when(F.col("frame_id") % 9 == 0, 0).otherwise(1000), "height": F.lit(600)})
    box = faces.main_face_box("faces", "main", "width", "height")
    return df.select("frame_id", *(F.round(box[c], 9).alias(c) for c in "xywh"))


def _eyes(spark, sf_dir):
    at = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    up = F.col("contrast") / 4
    row = _faces(spark, sf_dir).withColumns({
        "face_idx": F.floor((F.col("idx") - 1) / 2).cast("int"), "p0": at(F.lit(0.0), F.lit(0.0)), "p1": at(F.col("w") / 12, up),
        "p2": at(F.col("w") / 6, up), "p3": at(F.col("w") / 4, F.lit(0.0)), "p4": at(F.col("w") / 6, -up / 2), "p5": at(F.col("w") / 12, -up / 2),
    })
    return row


def eye_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.eye_ratio(_eyes(spark, sf_dir)).withColumn("ear", F.round("ear", 9))


def eye_ratio_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.eye_ratio(_eyes(spark, sf_dir), mean=True).withColumn("ear", F.round("ear", 9))


def background_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile of most energy that no face touches, by order: line items are tiles, orders' customers faces."""
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("path"), (k % 4).cast("int").alias("row"), (k % 6).cast("int").alias("col"), (k % 6 * 100).cast("int").alias("x"),
        (k % 4 * 100).cast("int").alias("y"), F.lit(100).alias("w"), F.lit(100).alias("h"), F.col("l_quantity").alias("energy"),
    )
    c = F.col("o_custkey")
    boxes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), (c % 500).cast("int").alias("x"), (c % 300).cast("int").alias("y"), F.lit(80).alias("w"), F.lit(60).alias("h"))
    return images.best_tile(rows, boxes).select("path", F.col("tile.x").alias("x"), F.col("tile.y").alias("y"), "energy")


def chosen_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    box = lambda big, there: F.when(there, F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), big.cast("int").alias("w"), F.lit(30).alias("h")))
    df = table(spark, sf_dir, "orders").select(
        n.alias("id"), box(n % 50, n % 3 == 0).alias("eye"), box(n % 40, n % 4 == 0).alias("face"), box(n % 60, n % 5 == 0).alias("af"), box(n % 30, n % 2 == 0).alias("tile")
    )
    pick = images.choose_region(use_af=True)
    return df.select("id", pick["source"].alias("source"), pick["roi"]["w"].alias("w"))


def channel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of colour pictures of 640 pixels from embeddings: nearly gray ones, and every third in strong colours."""
    number = lambda k: F.get("embedding", (k % 64).cast("int")).cast("double")
    level = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.5) * 255).cast("int"))).cast("long")), 2, "0")
    strong = F.col("vec_id") % 3 == 0
    other = lambda i, step, share: F.when(strong, number(i + step)).otherwise(number(i) + number(i * step) * share)
    pixels = F.transform(F.sequence(F.lit(0), F.lit(639)), lambda i: F.concat(level(number(i)), level(other(i, 7, 0.05)), level(other(i, 11, 0.05))))
    df = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("path"), F.lit(20).alias("height"), F.lit(32).alias("width"), F.lit(3).alias("channels"), F.unhex(F.array_join(pixels, "")).alias("data")
    )
    found = images.channel_means(df)
    return found.select("path", *(F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in "bgr"), "pixels")


# -- bodies and calibration --------------------------------------------------------------------------------------------


def _cameras(spark, sf_dir):
    k = F.col("s_suppkey")
    model = F.concat(F.lit("EOS R"), (k % 6).cast("string"), F.when(k % 2 == 0, "m3").otherwise(""))
    return table(spark, sf_dir, "supplier").select(F.lit("Canon").alias("maker"), model.alias("model"), k.alias("position"))


_CAMERAS_SQL = "cams AS (SELECT 'Canon EOS R' || s_suppkey % 6 || CASE WHEN s_suppkey % 2 = 0 THEN 'm3' ELSE '' END AS label, s_suppkey AS position FROM supplier)"


def camera_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    model = F.concat(F.lit("EOS R"), (n % 9).cast("string"), F.when(n % 2 == 0, " Mark III").otherwise(""))
    shots = table(spark, sf_dir, "orders").select(n.alias("id"), F.when(n % 13 != 0, model).alias("camera_model"), F.when(n % 3 == 0, "CANON").alias("camera_make"))
    return lenses.match_cameras(shots, _cameras(spark, sf_dir)).select("id", "camera")


def available_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.available_cameras(_cameras(spark, sf_dir), "m3", 9)


def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.coverage(_catalogue(spark, sf_dir), _cameras(spark, sf_dir))


def first_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.first_camera(_samples(spark, sf_dir).withColumn("camera_model", F.concat(F.lit("X"), (F.col("input_order") % 5).cast("string"))))


QUERIES = {
    f.__name__: f
    for f in (
        report_rows, report_records, results_by_grade, kept_frames, failed_frames, located_pictures, first_failures, raw_count,
        face_size_bonus, export_folders, log_read_back, queue_read_back, calibrations_read_back, lens_catalogue_files,
        rotated_boxes, preview_boxes, clipped_boxes, overlapping_boxes, main_face_boxes, eye_ratios, eye_ratio_means,
        background_tiles, chosen_regions, channel_means, camera_match, available_cameras, catalogue_counts, first_camera,
    )
}

_BOX_HEAD = f"WITH {_BOX_SQL} SELECT id, line, part, s, d, q"
_EYE_SQL = f"""{_FACES_SQL}, e AS (SELECT frame_id, CAST((idx - 1) // 2 AS INTEGER) AS face_idx, w / 4 AS width, contrast / 4 * 1.5::DOUBLE AS opening FROM f),
r AS (SELECT *, CASE WHEN width >= 12 THEN 2 * opening / (2 * width) END AS ear FROM e)"""

ORACLES = {
    "report_rows": f"{_REPORT_SQL} SELECT name, grade AS final_grade, printf('%.2f', score) AS score, CAST(group_id AS VARCHAR) AS group_id, CAST(group_rank AS VARCHAR) AS group_rank, coalesce(printf('%.2f', sharpness), '') AS sharpness, printf('%.2f', frame_sharpness) AS frame_sharpness, CASE WHEN sharpness IS NULL THEN '' ELSE source END AS source, CASE WHEN sharpness IS NULL THEN '0' ELSE CAST(face_count AS VARCHAR) END AS face_count, coalesce(taken, '') AS capture_time, coalesce(lens_model, '') AS lens, coalesce(CAST(iso AS VARCHAR), '') AS iso, shutter, reasons, coalesce(error, '') AS error FROM rep",
    "report_records": f"{_REPORT_SQL} SELECT path, grade, CAST(printf('%.2f', score) AS DOUBLE) AS score, group_id, group_rank, CAST(printf('%.2f', sharpness) AS DOUBLE) AS sharpness, CAST(printf('%.2f', frame_sharpness) AS DOUBLE) AS frame_sharpness, CASE WHEN sharpness IS NOT NULL THEN source END AS focus_source, CASE WHEN sharpness IS NULL THEN 0 ELSE face_count END AS face_count, taken AS capture_time, lens_model AS lens, iso, shutter, reasons, error FROM rep",
    "results_by_grade": f"{_PLACES}, {_GRADED.removeprefix('WITH RECURSIVE ').replace(FRAMES_SQL + ',', '', 1)} SELECT coalesce('p' || place_id, 'none') AS place_label, grade, count(*) AS frames FROM graded LEFT JOIN placed USING (path) GROUP BY 1, 2",
    "kept_frames": f"{_EDITED_SQL} SELECT batch_id, path FROM final WHERE final_grade = 'keep'",
    "failed_frames": f"WITH {FRAMES_SQL} SELECT path, error FROM frames WHERE error IS NOT NULL OR sharpness IS NULL",
    "located_pictures": f"WITH {FRAMES_SQL} SELECT path FROM frames WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND lower(name) SIMILAR TO '.*\\.(jpg|jpeg|hif|heic|heif)'",
    "first_failures": f"WITH {FRAMES_SQL} SELECT batch_id, name, coalesce(error, '') AS error FROM frames WHERE error IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY input_order) <= 5",
    "raw_count": f"WITH {FRAMES_SQL} SELECT count(*) FILTER (name SIMILAR TO '.*\\.(ARW|CR3|NEF)') AS raws, count(*) FILTER (NOT name SIMILAR TO '.*\\.(ARW|CR3|NEF)') AS others FROM frames",
    "face_size_bonus": f"WITH {FRAMES_SQL} SELECT path, round(8.0::DOUBLE * least(1.0::DOUBLE, face_area_ratio / 0.10::DOUBLE), 9) AS value FROM frames WHERE error IS NULL AND sharpness IS NOT NULL AND face_count > 0",
    "export_folders": f"{_PLACES}, {_EDITED_SQL.removeprefix('WITH RECURSIVE ').replace(FRAMES_SQL + ',', '', 1)} SELECT path AS source, '/out/' || coalesce(printf('p%02d', place_id), '_위치없음') || '/_keep/' || name AS destination FROM final LEFT JOIN placed USING (path) WHERE final_grade = 'keep'",
    "log_read_back": f"{_UNDO_SQL} SELECT pos, 'copy' AS mode, '/o' AS root, CASE WHEN n % 37 <> 0 THEN '/a/' || n END AS source, path AS destination, n % 4 = 0 AS rendered FROM log",
    "queue_read_back": "SELECT o_orderkey AS seq, '/q/' || o_custkey AS source, o_orderpriority AS preset_name FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0",
    "calibrations_read_back": "SELECT 'cam' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 12 ELSE CAST(c_custkey % 9 AS INTEGER) END AS samples, 1.1::DOUBLE AS first_gain FROM customer WHERE c_custkey % 5 > 1 AND (c_custkey % 2 = 0 OR c_custkey % 3 <> 0) AND c_custkey % 8 <> 4",
    "lens_catalogue_files": f"WITH {_CATALOGUE_SQL} SELECT CAST(low % 2 AS INTEGER) AS layer, maker, model, count(*) AS n, max(low) AS low, max(low) * 3 AS high, 2 AS mounts FROM cat GROUP BY 1, 2, 3",
    "rotated_boxes": f"{_BOX_HEAD}, CASE turn WHEN 3 THEN 900 - x - w WHEN 6 THEN 600 - y - h WHEN 8 THEN y ELSE x END AS x, CASE turn WHEN 3 THEN 600 - y - h WHEN 6 THEN x WHEN 8 THEN 900 - x - w ELSE y END AS y, CASE WHEN turn IN (6, 8) THEN h ELSE w END AS w, CASE WHEN turn IN (6, 8) THEN w ELSE h END AS h FROM b",
    "preview_boxes": f"WITH {_BOX_SQL}, p AS (SELECT *, greatest(0, least(449, CAST(round_even((x - w / 2) * (450::DOUBLE / 900), 0) AS INTEGER))) AS px, greatest(0, least(336, CAST(round_even((y - h / 2) * (337::DOUBLE / 600), 0) AS INTEGER))) AS py FROM b) SELECT id, line, part, s, d, q, px AS x, py AS y, greatest(1, least(450 - px, CAST(round_even(w * (450::DOUBLE / 900), 0) AS INTEGER))) AS w, greatest(1, least(337 - py, CAST(round_even(h * (337::DOUBLE / 600), 0) AS INTEGER))) AS h FROM p",
    "clipped_boxes": f"WITH {_BOX_SQL}, p AS (SELECT *, greatest(0, CAST(round_even(x, 0) AS INTEGER)) AS x0, greatest(0, CAST(round_even(y, 0) AS INTEGER)) AS y0, least(900, CAST(round_even(x + w, 0) AS INTEGER)) AS x1, least(600, CAST(round_even(y + h, 0) AS INTEGER)) AS y1 FROM b) SELECT id, line, part, s, d, q, x0 AS x, y0 AS y, greatest(0, x1 - x0) AS w, greatest(0, y1 - y0) AS h FROM p",
    "overlapping_boxes": f"WITH {_BOX_SQL} SELECT id, count(*) AS boxes FROM b WHERE x < 450 AND 300 < x + w AND y < 350 AND 200 < y + h GROUP BY 1",
    "main_face_boxes": f"{_FACES_SQL}, g AS (SELECT DISTINCT frame_id FROM f) SELECT g.frame_id, round(x / 1000, 9) AS x, round(y / 600, 9) AS y, round(w / 1000, 9) AS w, round(h / 600, 9) AS h FROM g LEFT JOIN f ON f.frame_id = g.frame_id AND f.idx = g.frame_id % 4 AND g.frame_id % 4 > 0 AND g.frame_id % 9 <> 0",
    "eye_ratios": f"{_EYE_SQL} SELECT frame_id, face_idx, round(coalesce(max(ear), -1.0::DOUBLE), 9) AS ear FROM r GROUP BY 1, 2",
    "eye_ratio_means": f"{_EYE_SQL} SELECT frame_id, face_idx, round(coalesce(avg(ear), -1.0::DOUBLE), 9) AS ear FROM r GROUP BY 1, 2",
    "background_tiles": "WITH t AS (SELECT l_orderkey AS id, l_partkey % 4 AS r, l_partkey % 6 AS c, l_quantity AS energy FROM lineitem), m AS (SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = id AND c * 100 < o_custkey % 500 + 80 AND o_custkey % 500 < c * 100 + 100 AND r * 100 < o_custkey % 300 + 60 AND o_custkey % 300 < r * 100 + 100)) SELECT CAST(id AS VARCHAR) AS path, CAST(first(c ORDER BY energy DESC, r, c) * 100 AS INTEGER) AS x, CAST(first(r ORDER BY energy DESC, r, c) * 100 AS INTEGER) AS y, max(energy) AS energy FROM m GROUP BY 1",
    "chosen_regions": "WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 50 >= 24 THEN 'eye' WHEN o_orderkey % 4 = 0 AND o_orderkey % 40 >= 24 THEN 'face' WHEN o_orderkey % 5 = 0 AND o_orderkey % 60 >= 24 THEN 'af' WHEN o_orderkey % 2 = 0 AND o_orderkey % 30 >= 24 THEN 'tile' ELSE 'frame' END AS source FROM orders) SELECT id, source, CAST(CASE source WHEN 'eye' THEN id % 50 WHEN 'face' THEN id % 40 WHEN 'af' THEN id % 60 WHEN 'tile' THEN id % 30 END AS INTEGER) AS w FROM c",
    "channel_means": """WITH p AS (SELECT vec_id, embedding AS e, vec_id % 3 = 0 AS strong, unnest(range(0, 640)) AS i FROM embeddings),
x AS (SELECT vec_id, e[i % 64 + 1]::DOUBLE AS b, CASE WHEN strong THEN e[(i + 7) % 64 + 1]::DOUBLE ELSE e[i % 64 + 1]::DOUBLE + e[i * 7 % 64 + 1]::DOUBLE * 0.05::DOUBLE END AS g,
  CASE WHEN strong THEN e[(i + 11) % 64 + 1]::DOUBLE ELSE e[i % 64 + 1]::DOUBLE + e[i * 11 % 64 + 1]::DOUBLE * 0.05::DOUBLE END AS r FROM p),
v AS (SELECT vec_id, greatest(0, least(255, CAST(floor((b + 0.5::DOUBLE) * 255) AS INTEGER))) AS b, greatest(0, least(255, CAST(floor((g + 0.5::DOUBLE) * 255) AS INTEGER))) AS g,
  greatest(0, least(255, CAST(floor((r + 0.5::DOUBLE) * 255) AS INTEGER))) AS r FROM x),
u AS (SELECT *, greatest(b, g, r) - least(b, g, r) <= 0.1::DOUBLE * greatest(b, g, r) AS neutral FROM v WHERE least(b, g, r) > 16 AND greatest(b, g, r) < 240),
c AS (SELECT *, count(*) FILTER (neutral) OVER (PARTITION BY vec_id) >= 100 AS enough FROM u)
SELECT CAST(e.vec_id AS VARCHAR) AS path, round(coalesce(avg(b), 0), 6) AS mean_b, round(coalesce(avg(g), 0), 6) AS mean_g, round(coalesce(avg(r), 0), 6) AS mean_r, count(c.vec_id) AS pixels
FROM embeddings e LEFT JOIN c ON c.vec_id = e.vec_id AND (neutral OR NOT enough) GROUP BY e.vec_id""",
    "camera_match": f"WITH {_CAMERAS_SQL}, k AS (SELECT DISTINCT label FROM cams) SELECT o_orderkey AS id, label AS camera FROM orders LEFT JOIN k ON o_orderkey % 13 <> 0 AND label = 'Canon EOS R' || o_orderkey % 9 || CASE WHEN o_orderkey % 2 = 0 THEN 'm3' ELSE '' END",
    "available_cameras": f"WITH {_CAMERAS_SQL} SELECT DISTINCT label FROM (SELECT label FROM cams WHERE contains(lower(label), 'm3') ORDER BY position LIMIT 9)",
    "catalogue_counts": "SELECT (SELECT count(*) FROM part) AS lenses, (SELECT count(*) FROM supplier) AS cameras",
    "first_camera": "WITH s AS (SELECT 'maker_X_' || l_partkey % 97 AS camera_key, l_orderkey * 8 + l_linenumber AS input_order FROM lineitem), g AS (SELECT camera_key, min(input_order) AS f, count(*) AS samples FROM s GROUP BY 1 HAVING count(*) >= 4) SELECT camera_key, 'X' || f % 5 AS camera, samples FROM g ORDER BY f LIMIT 1",
}
