"""Queries over inventories, the analysis store, exports, undo, queues and calibration, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.operators import calibrate, export, review, store
from framesieve.plans.grading import _GRADED, _graded
from framesieve.sources import inventory as inv
from framesieve.sources.shared import stored
from framesieve.sources.tables import frames, table

KEY, SCHEMA = "k1", 3


# -- derived tables ----------------------------------------------------------------------------------------------------


def _files(spark, sf_dir) -> DataFrame:
    """A manifest from orders: raw files, their compressed twins, hidden names and output folders."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    folder = F.when(n % 17 == 0, "/_keep").when(n % 13 == 0, "/sub").otherwise("")
    ending = F.element_at(F.array(*map(F.lit, [".ARW", ".jpg", ".CR3", ".HIF", ".txt", ".JPG", ".xmp", ".nef"])), (n % 8 + 1).cast("int"))
    stem = F.concat(F.when(n % 19 == 0, "._").otherwise(""), F.when((n / 8).cast("long") % 3 == 0, "DSC").otherwise("dsc"), (n / 8).cast("long").cast("string"))
    path = F.concat(F.lit("/arc/b"), (F.col("o_custkey") % 7).cast("string"), folder, F.lit("/"), stem, ending)
    path8 = F.concat(F.lit("/arc/b"), ((n / 64).cast("long") % 7).cast("string"), folder, F.lit("/"), stem, ending)
    return o.select(F.when(n % 5 == 0, path).otherwise(path8).alias("path")).distinct()


_FILES_SQL = """files AS (SELECT DISTINCT '/arc/b' || CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 7 ELSE (o_orderkey // 64) % 7 END AS VARCHAR)
  || CASE WHEN o_orderkey % 17 = 0 THEN '/_keep' WHEN o_orderkey % 13 = 0 THEN '/sub' ELSE '' END || '/'
  || CASE WHEN o_orderkey % 19 = 0 THEN '._' ELSE '' END || CASE WHEN (o_orderkey // 8) % 3 = 0 THEN 'DSC' ELSE 'dsc' END || CAST(o_orderkey // 8 AS VARCHAR)
  || (['.ARW', '.jpg', '.CR3', '.HIF', '.txt', '.JPG', '.xmp', '.nef'])[o_orderkey % 8 + 1] AS path FROM orders),
named AS (SELECT path, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS parent,
  lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS suffix, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')) AS stem FROM files),
photos AS (SELECT *, CASE WHEN suffix IN ('arw', 'cr3', 'nef') THEN 'raw' WHEN suffix = 'jpg' THEN 'jpeg' ELSE 'heif' END AS kind FROM named
  WHERE suffix IN ('arw', 'cr3', 'nef', 'jpg', 'hif') AND name NOT LIKE '.%' AND parent NOT LIKE '%/\\_keep' ESCAPE '\\'),
listed AS (SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS input_order FROM photos p
  WHERE kind = 'raw' OR NOT EXISTS (SELECT 1 FROM photos r WHERE r.kind = 'raw' AND r.parent = p.parent AND r.stem = p.stem))"""


def _store_tables(spark, sf_dir):
    """An inventory and a store from orders: some files changed since, some were measured under other parameters."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    files = o.where(n % 11 != 0).select(
        F.concat(F.lit("/s/"), n.cast("string")).alias("path"),
        (F.lit(1.5) * n + F.when(n % 7 == 0, 1.0).otherwise(0.0)).alias("mtime"),
        (n * 10).alias("size"),
        n.alias("input_order"),
    )
    kept = o.where(n % 3 != 0).select(
        F.concat(F.lit("/s/"), n.cast("string")).alias("path"),
        (F.lit(1.5) * n).alias("mtime"),
        (n * 10).alias("size"),
        F.when(n % 5 == 0, "k0").otherwise(KEY).alias("params_key"),
        F.when(n % 23 == 0, 2).otherwise(SCHEMA).alias("schema_version"),
        F.lit(1).cast("long").alias("written_at"),
        F.when(n % 31 == 0, "decode").alias("error"),
        F.col("o_totalprice").alias("sharpness"),
    )
    older = kept.where("size % 40 = 0").withColumn("written_at", F.lit(0).cast("long")).withColumn("params_key", F.lit("k9"))
    return files, kept.unionByName(older)


_STORE_SQL = """inv AS (SELECT '/s/' || o_orderkey AS path, 1.5::DOUBLE * o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mtime,
  o_orderkey * 10 AS size, o_orderkey AS input_order FROM orders WHERE o_orderkey % 11 <> 0),
kept AS (SELECT '/s/' || o_orderkey AS path, 1.5::DOUBLE * o_orderkey AS mtime, o_orderkey * 10 AS size,
  CASE WHEN o_orderkey % 5 = 0 THEN 'k0' ELSE 'k1' END AS params_key, CASE WHEN o_orderkey % 23 = 0 THEN 2 ELSE 3 END AS schema_version,
  1::BIGINT AS written_at, CASE WHEN o_orderkey % 31 = 0 THEN 'decode' END AS error, o_totalprice AS sharpness FROM orders WHERE o_orderkey % 3 <> 0),
good AS (SELECT * FROM kept WHERE params_key = 'k1' AND schema_version = 3)"""


def _fresh(files, spark, sf_dir):
    return store.pending(files, _store_tables(spark, sf_dir)[1], KEY, SCHEMA).select(
        "path", "mtime", "size", F.lit(KEY).alias("params_key"), F.lit(SCHEMA).alias("schema_version"),
        F.lit(9).cast("long").alias("written_at"), F.when(F.col("size") % 290 == 0, "decode").alias("error"), F.col("mtime").alias("sharpness"),
    )


# -- queries -----------------------------------------------------------------------------------------------------------


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.inventory(_files(spark, sf_dir), "/arc").select("path", "kind", "input_order")


def file_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    raws = inv.with_names(files).where("kind = 'raw'")
    return inv.companions(raws, files)


def store_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, kept = _store_tables(spark, sf_dir)
    return store.hits(files, kept, KEY, SCHEMA).select("path", "input_order", "sharpness", "error")


def pending_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, kept = _store_tables(spark, sf_dir)
    return store.pending(files, kept, KEY, SCHEMA).select("path", "input_order")


def count_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, kept = _store_tables(spark, sf_dir)
    return store.count_ready(files, kept, KEY, SCHEMA)


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, kept = _store_tables(spark, sf_dir)
    return store.upsert(kept, _fresh(files, spark, sf_dir)).select("path", "params_key", "written_at")


def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.statistics(store.latest(_store_tables(spark, sf_dir)[1]))


def store_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.invalidated(store.latest(_store_tables(spark, sf_dir)[1]), SCHEMA).select("path", "params_key")


def _store_files(spark, sf_dir):
    """Files of 60 folders' stores from orders: measurements, previews, logs of up to three parts, and strangers."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = n.cast("string")
    folder = F.concat(F.lit("/s/"), (F.col("o_custkey") % 60).cast("string"))
    log = F.concat(F.lit("/logs/log=export_"), F.floor(n / 12).cast("string"), F.lit("/part-"), name, F.lit(".json"))
    file = (
        F.when(F.col("o_custkey") % 60 < 50, F.when(n % 4 == 1, log).when(n % 20 == 2, F.concat(F.lit("/note-"), name)))
        .otherwise(F.lit(None).cast("string"))
    )
    file = F.coalesce(file, F.when(n % 3 == 0, F.concat(F.lit("/analysis/part-"), name, F.lit(".parquet"))), F.concat(F.lit("/thumbs/"), name, F.lit(".jpg")))
    return o.select(F.concat(folder, file).alias("path"), (n % 1000).alias("size"))


_STORE_FILES_SQL = """WITH named AS (SELECT '/s/' || o_custkey % 60 AS folder, o_orderkey AS n, o_orderkey % 1000 AS size, o_orderkey // 12 AS log,
  CASE WHEN o_custkey % 60 < 50 AND o_orderkey % 4 = 1 THEN 'log' WHEN o_custkey % 60 < 50 AND o_orderkey % 20 = 2 THEN 'other' WHEN o_orderkey % 3 = 0 THEN 'analysis' ELSE 'thumbnail' END AS kind FROM orders)"""


def store_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "customer").where("c_custkey % 7 > 0").select(F.concat(F.lit("/s/"), (F.col("c_custkey") % 45).cast("string")).alias("folder"))
    return store.statistics_by_kind(_store_files(spark, sf_dir), entries)


def store_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.after_clearing(_store_files(spark, sf_dir))


def store_cleared_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.after_clearing(_store_files(spark, sf_dir), keep_logs=False)


def gathered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, kept = _store_tables(spark, sf_dir)
    return store.gathered(files, kept, _fresh(files, spark, sf_dir), KEY, SCHEMA).select("path", "input_order", "sharpness")


def analysis_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, kept = _store_tables(spark, sf_dir)
    fresh = _fresh(files, spark, sf_dir)
    done = store.gathered(files, kept, fresh, KEY, SCHEMA)
    return store.progress(files, kept, done, KEY, SCHEMA)


def _edited(spark, sf_dir):
    edits = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") * 7).alias("frame"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", "keep").when(F.col("o_orderstatus") == "O", "reject").otherwise("review").alias("manual_grade"),
    )
    known = frames(spark, sf_dir).select("path", "input_order")  # every frame is graded, so none need be graded for this
    return review.with_final(_graded(spark, sf_dir), edits.join(known, edits["frame"] == known["input_order"]).select("path", "manual_grade", "seq"))


_EDITED_SQL = f"""{_GRADED}, edits AS (SELECT path, arg_max(CASE o_orderstatus WHEN 'F' THEN 'keep' WHEN 'O' THEN 'reject' ELSE 'review' END, o_orderkey) AS manual_grade
  FROM orders JOIN graded ON o_custkey * 7 = input_order GROUP BY path),
final AS (SELECT graded.*, coalesce(manual_grade, grade) AS final_grade, regexp_replace(name, '\\.[^.]*$', '') AS stem, regexp_extract(name, '\\.[^.]*$') AS ext FROM graded LEFT JOIN edits USING (path))"""


def manual_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.summary(_edited(spark, sf_dir), "final_grade")


def _plan(spark, sf_dir, make=export.plan):
    """What make says of the frames, which is their plan.

    All batches go into one folder, in which some names stand already, in capitals and with numbers."""
    df = _edited(spark, sf_dir).withColumns(
        {"stem": F.regexp_replace("name", r"\.[^.]*$", ""), "suffix": F.regexp_extract("name", r"\.[^.]*$", 0)}
    )
    n = F.col("input_order")
    standing = F.concat(
        F.lit("/out/_"), "final_grade", F.lit("/"), F.upper("final_grade"), F.lit("_"), (n % 90).cast("string"),
        F.when(n % 4 > 0, F.concat(F.lit("_"), (n % 12).cast("string"))).otherwise(""), "suffix",
    )
    # Graded once; the plan and the listing both come from it.
    develop = F.when(n % 3 == 0, F.concat(F.lit("preset "), (n % 5).cast("string"))).alias("develop")
    df = stored(df.select("batch_id", "path", "input_order", "final_grade", "capture_time", "score", "stem", "suffix", develop), "export-frames")
    existing = df.where(n % 29 != 0).select("path").union(df.where(n % 31 == 0).select(standing.alias("path")))
    return make(df, existing, "/out", "{grade}_{score}", ["keep", "review"], shared_root=True)


_PLAN_SQL = f"""{_EDITED_SQL}, numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY input_order) AS INTEGER) AS index FROM final WHERE final_grade IN ('keep', 'review')),
ops AS (SELECT *, final_grade || '_' || CAST(CAST(round_even(score, 0) AS BIGINT) AS VARCHAR) AS base FROM numbered WHERE input_order % 29 <> 0),
turns AS (SELECT *, row_number() OVER (PARTITION BY lower(base || ext) ORDER BY batch_id, index) - 1 AS r FROM ops),
stands AS (SELECT DISTINCT lower(final_grade || '_' || input_order % 90 || ext) AS name, CASE WHEN input_order % 4 > 0 THEN input_order % 12 ELSE 0 END AS k
  FROM final WHERE input_order % 31 = 0 AND NOT (input_order % 4 > 0 AND input_order % 12 = 0)),
free AS (SELECT name, list(k - j) AS gs FROM (SELECT name, k, row_number() OVER (PARTITION BY name ORDER BY k) - 1 AS j FROM stands) GROUP BY 1),
placed AS (SELECT turns.*, r + coalesce(len(list_filter(gs, lambda g: g <= r)), 0) AS k FROM turns LEFT JOIN free ON free.name = lower(base || ext)),
plan AS (SELECT batch_id, index, path AS source, '/out/_' || final_grade || '/' || base || CASE WHEN k = 0 THEN '' ELSE '_' || k END || ext AS destination, final_grade AS grade, CASE WHEN input_order % 3 = 0 THEN 'preset ' || input_order % 5 END AS develop FROM placed)"""


def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[0]


def export_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, export.chosen)[1]


def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.plan_counts(_plan(spark, sf_dir, export.chosen)[0])


def _log(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    log = o.select(
        (F.col("o_custkey") % 20).alias("batch_id"), n.alias("pos"),
        F.when(F.col("o_custkey") % 20 == 3, "link").when(F.col("o_custkey") % 2 == 0, "move").otherwise("copy").alias("mode"),
        F.when(n % 37 != 0, F.concat(F.lit("/a/"), n.cast("string"))).alias("source"),
        F.when(n % 41 != 0, F.concat(F.lit("/o/"), n.cast("string"))).alias("destination"),
        (n % 4 == 0).alias("rendered"),
    )
    existing = o.where(n % 6 != 0).select(F.concat(F.lit("/o/"), n.cast("string")).alias("path")).union(
        o.where(n % 10 == 0).select(F.concat(F.lit("/a/"), n.cast("string")).alias("path"))
    )
    return log, existing


_UNDO_SQL = """WITH log AS (SELECT o_custkey % 20 AS batch_id, o_orderkey AS pos, o_orderkey AS n, CASE WHEN o_custkey % 20 = 3 THEN 'link' WHEN o_custkey % 2 = 0 THEN 'move' ELSE 'copy' END AS mode,
  o_orderkey % 37 = 0 OR o_orderkey % 41 = 0 AS malformed, CASE WHEN o_orderkey % 41 <> 0 THEN '/o/' || o_orderkey END AS path FROM orders),
steps AS (SELECT batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY pos DESC) AS INTEGER) AS step, CASE WHEN mode = 'move' AND n % 4 <> 0 THEN 'move_back' ELSE 'delete' END AS action, path,
  CASE WHEN mode = 'link' THEN 'refused' WHEN malformed THEN 'malformed' WHEN n % 6 = 0 THEN 'missing' WHEN mode = 'move' AND n % 4 <> 0 AND n % 10 = 0 THEN 'occupied' ELSE 'ok' END AS status FROM log)"""


def undo_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.undo(*_log(spark, sf_dir))


def undo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.undo_counts(export.undo(*_log(spark, sf_dir)))


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("/q/"), F.col("o_custkey").cast("string")).alias("source"), F.col("o_orderpriority").alias("preset_name")
    )


def queue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.queue(_entries(spark, sf_dir))


def queue_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _entries(spark, sf_dir)
    return export.queue_changes(export.queue(df.where("seq % 3 = 0")), df.where("seq % 3 <> 0"))


def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue with settings: a source's last entry decides whether it is developed, if that has none too."""
    develop = F.when(F.col("seq") % 5 < 3, F.concat(F.lit("s"), (F.col("seq") % 7).cast("string")))
    return export.queue_counts(_entries(spark, sf_dir).withColumn("develop", develop))


def queue_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _entries(spark, sf_dir)
    return export.without(export.queue(df), df.where("seq % 4 = 0")).select("source", "seq")


def newest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return export.newest_log(
        o.select((F.col("o_custkey") % 20).alias("root"), F.col("o_orderkey").alias("created"), F.concat(F.lit("log"), F.col("o_orderkey").cast("string")).alias("file"))
    )


def _samples(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        calibrate.camera_key(F.lit("Maker"), F.concat(F.lit("maker X/"), (F.col("l_partkey") % 97).cast("string"))).alias("camera_key"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("input_order"),
        (F.col("l_quantity") * 2).alias("camera_b"), (F.col("l_quantity") * 2 + 3).alias("camera_g"), (F.col("l_quantity") + 30).alias("camera_r"),
        (F.col("l_quantity") * 2 + F.col("l_discount") * 20).alias("ours_b"), (F.col("l_quantity") * 2 + 2).alias("ours_g"), (F.col("l_quantity") + 29.5).alias("ours_r"),
    )


_SAMPLES_SQL = """WITH s AS (SELECT 'maker_X_' || l_partkey % 97 AS camera_key, l_orderkey * 8 + l_linenumber AS input_order, l_quantity * 2 AS cb, l_quantity * 2 + 3 AS cg, l_quantity + 30 AS cr,
  l_quantity * 2 + l_discount * 20 AS ob, l_quantity * 2 + 2 AS og, l_quantity + 29.5::DOUBLE AS orr FROM lineitem),
first AS (SELECT *, row_number() OVER (PARTITION BY camera_key ORDER BY input_order) AS pos FROM s),
g AS (SELECT camera_key, cb / ob AS b, cg / og AS g, cr / orr AS r FROM first WHERE pos <= 12 AND least(cb, cg, cr, ob, og, orr) > 1),
m AS (SELECT camera_key, count(*) AS samples, median(b) AS b, median(g) AS g, median(r) AS r FROM g WHERE least(b, g, r) >= 0.5 AND greatest(b, g, r) <= 2 GROUP BY 1 HAVING count(*) >= 4),
k AS (SELECT *, exp((ln(b) + ln(g) + ln(r)) / 3) AS mean FROM m),
d AS (SELECT *, greatest(abs(b / mean - 1), abs(g / mean - 1), abs(r / mean - 1)) < 0.02 AS neutral FROM k)"""


def camera_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calibrate.camera_gains(calibrate.sample_gains(calibrate.first_samples(_samples(spark, sf_dir))))
    return found.select("camera_key", "samples", *(F.round(f"gain_{c}", 9).alias(f"gain_{c}") for c in "bgr"))


def uncalibrated_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _samples(spark, sf_dir)
    stored = df.select(F.col("camera_key").alias("key")).distinct().where("substring(key, -1) IN ('1', '2', '3')")
    stored = stored.withColumn("gain", F.when(F.endswith("key", F.lit("3")), F.array(F.lit(3.0), F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(1.1), F.lit(0.9))))
    return calibrate.needed(df, stored).groupBy("camera_key").agg(F.count("*").alias("frames"))


QUERIES = {
    f.__name__: f
    for f in (
        file_inventory, file_companions, store_hits, pending_frames, count_ready, store_upsert, store_statistics,
        store_invalidated, gathered_frames, analysis_progress, manual_grades, export_plan, export_skipped, export_counts,
        undo_plan, undo_counts, queue_merge, queue_changes, queue_removal, queue_counts, store_by_kind, store_cleared, store_cleared_whole, newest_logs, camera_gain, uncalibrated_cameras,
    )
}

_FRESH_SQL = "todo AS (SELECT * FROM inv ANTI JOIN good USING (path, mtime, size))"

ORACLES = {
    "file_inventory": f"WITH {_FILES_SQL} SELECT path, kind, input_order FROM listed",
    "file_companions": f"WITH {_FILES_SQL} SELECT DISTINCT r.path, c.path AS companion FROM named r JOIN named c ON r.parent = c.parent AND r.path <> c.path AND ((c.stem = r.stem AND c.suffix IN ('jpg', 'hif', 'xmp')) OR lower(c.name) = lower(r.name) || '.xmp') WHERE r.suffix IN ('arw', 'cr3', 'nef')",
    "store_hits": f"WITH {_STORE_SQL} SELECT path, input_order, sharpness, error FROM inv JOIN good USING (path, mtime, size)",
    "pending_frames": f"WITH {_STORE_SQL} SELECT path, input_order FROM inv ANTI JOIN good USING (path, mtime, size)",
    "count_ready": f"WITH {_STORE_SQL} SELECT count(*) AS ready FROM inv SEMI JOIN good USING (path, mtime, size)",
    "store_upsert": f"WITH {_STORE_SQL}, {_FRESH_SQL} SELECT path, 'k1' AS params_key, 9::BIGINT AS written_at FROM todo UNION ALL SELECT path, params_key, written_at FROM kept ANTI JOIN todo USING (path)",
    "store_statistics": f"WITH {_STORE_SQL} SELECT params_key, count(*) AS entries, count(error) AS failed, CAST(sum(size) AS BIGINT) AS bytes FROM kept GROUP BY 1",
    "store_invalidated": f"WITH {_STORE_SQL} SELECT path, params_key FROM kept WHERE schema_version = 3",
    "store_by_kind": f"{_STORE_FILES_SQL}, e AS (SELECT '/s/' || c_custkey % 45 AS folder, count(*) AS c FROM customer WHERE c_custkey % 7 > 0 GROUP BY 1), k AS (SELECT folder, coalesce(sum(size) FILTER (kind = 'analysis'), 0) AS a, count(*) FILTER (kind = 'thumbnail') AS thumbnails, coalesce(sum(size) FILTER (kind = 'thumbnail'), 0) AS t, count(DISTINCT log) FILTER (kind = 'log') AS logs FROM named GROUP BY 1) SELECT folder, CAST(a AS BIGINT) AS analysis_bytes, thumbnails, CAST(t AS BIGINT) AS thumbnail_bytes, logs, coalesce(c, 0) AS analysis_entries, CAST(a + t AS BIGINT) AS total_bytes FROM k LEFT JOIN e USING (folder)",
    "store_cleared": f"{_STORE_FILES_SQL} SELECT folder, CAST(coalesce(sum(size) FILTER (kind IN ('analysis', 'thumbnail')), 0) AS BIGINT) AS freed, count(*) FILTER (kind IN ('log', 'other')) AS left, count(*) FILTER (kind IN ('log', 'other')) = 0 AS gone FROM named GROUP BY 1",
    "store_cleared_whole": f"{_STORE_FILES_SQL} SELECT folder, CAST(coalesce(sum(size) FILTER (kind <> 'other'), 0) AS BIGINT) AS freed, count(*) FILTER (kind = 'other') AS left, count(*) FILTER (kind = 'other') = 0 AS gone FROM named GROUP BY 1",
    "gathered_frames": f"WITH {_STORE_SQL}, {_FRESH_SQL} SELECT path, input_order, sharpness FROM inv JOIN good USING (path, mtime, size) UNION ALL SELECT path, input_order, mtime FROM todo",
    "analysis_progress": f"WITH {_STORE_SQL}, {_FRESH_SQL} SELECT count(*) AS done, count(*) AS total, (SELECT count(*) FROM inv SEMI JOIN good USING (path, mtime, size)) AS cached, (SELECT count(error) FROM inv JOIN good USING (path, mtime, size)) + (SELECT count(*) FROM todo WHERE size % 290 = 0) AS failed FROM inv",
    "manual_grades": f"{_EDITED_SQL} SELECT batch_id, count(*) FILTER (final_grade = 'keep') AS keep, count(*) FILTER (final_grade = 'review') AS review, count(*) FILTER (final_grade = 'reject') AS reject FROM final GROUP BY 1",
    "export_plan": f"{_PLAN_SQL} SELECT * FROM plan",
    "export_skipped": f"{_PLAN_SQL} SELECT batch_id, path, 'missing source' AS reason FROM numbered WHERE input_order % 29 = 0",
    "export_counts": f"{_PLAN_SQL} SELECT batch_id, count(*) FILTER (grade = 'keep') AS keep, count(*) FILTER (grade = 'review') AS review, count(*) FILTER (grade = 'reject') AS reject, count(develop) AS develop FROM plan GROUP BY 1",
    "undo_plan": f"{_UNDO_SQL} SELECT * FROM steps",
    "undo_counts": f"{_UNDO_SQL} SELECT batch_id, count(*) FILTER (status = 'ok' AND action = 'move_back') AS restored, count(*) FILTER (status = 'ok' AND action = 'delete') AS deleted, count(*) FILTER (status <> 'ok') AS failed FROM steps GROUP BY 1",
    "queue_merge": "SELECT '/q/' || o_custkey AS source, min(o_orderkey) AS seq, arg_max(o_orderpriority, o_orderkey) AS preset_name FROM orders GROUP BY 1",
    "queue_changes": "WITH o AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 3 <> 0) SELECT count(*) FILTER (o.c IS NULL) AS added, count(o.c) AS updated FROM n LEFT JOIN o USING (c)",
    "queue_counts": "SELECT count(*) AS entries, count(*) FILTER (last % 5 < 3) AS develop FROM (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1)",
    "queue_removal": "SELECT '/q/' || o_custkey AS source, min(o_orderkey) AS seq FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0) GROUP BY 1",
    "newest_logs": "SELECT o_custkey % 20 AS root, 'log' || max(o_orderkey) AS file, max(o_orderkey) AS created FROM orders GROUP BY 1",
    "camera_gain": f"{_SAMPLES_SQL} SELECT camera_key, samples, round(CASE WHEN neutral THEN 1.0::DOUBLE ELSE b / mean END, 9) AS gain_b, round(CASE WHEN neutral THEN 1.0::DOUBLE ELSE g / mean END, 9) AS gain_g, round(CASE WHEN neutral THEN 1.0::DOUBLE ELSE r / mean END, 9) AS gain_r FROM d",
    "uncalibrated_cameras": f"{_SAMPLES_SQL} SELECT camera_key, count(*) AS frames FROM s WHERE right(camera_key, 1) NOT IN ('1', '2') GROUP BY 1",
}
