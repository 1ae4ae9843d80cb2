"""Queries over scores, scenes, grades and places, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.config import GroupConfig, ScoreConfig
from framesieve.operators import grade, places, review, scenes, score
from framesieve.sources.tables import FRAMES_SQL, frames

#: Event days hold a frame every few minutes, so scenes are cut at five.
TIGHT = GroupConfig(time_gap_seconds=300.0, scene_change_distance=30)
TARGET = ScoreConfig(target_keep_ratio=0.35, min_keep_score=40.0)


def _graded(spark, sf_dir, config=None):
    df = scenes.with_scenes(frames(spark, sf_dir), TIGHT)
    return grade.graded(score.scored(df, config).drop("lines"), config)


def keep_review_reject_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.summary(_graded(spark, sf_dir))


def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score_lines(frames(spark, sf_dir))


def score_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scored(frames(spark, sf_dir)).select("path", F.round("score", 9).alias("score"))


def score_without_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = ScoreConfig(face_priority=False)
    return score.scored(frames(spark, sf_dir), config).select("path", F.round("score", 9).alias("score"))


def scene_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.with_scenes(frames(spark, sf_dir), TIGHT).select("batch_id", "path", "group_id")


def scene_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.scene_sizes(scenes.with_scenes(frames(spark, sf_dir), TIGHT))


def scene_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.scene_count(scenes.with_scenes(frames(spark, sf_dir), TIGHT))


def capture_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.gaps(frames(spark, sf_dir)).select("path", "gap")


def grade_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select(
        "batch_id", "path", "group_id", "group_rank", "threshold", "grade",
        F.round(F.col("group_best") - F.col("score"), 9).alias("deficit"),
    )


def target_keep_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _graded(spark, sf_dir, TARGET)
    return df.groupBy("batch_id").agg(
        F.round(F.first("keep_at"), 9).alias("keep_at"), F.count_if(F.col("grade") == "keep").alias("keep")
    )


def achievable_keep_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade.achievable_keep_floor(_graded(spark, sf_dir, TARGET), TARGET).withColumn("floor", F.round("floor", 9))


def grade_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade.reasons(_graded(spark, sf_dir))


def scenes_without_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.frames_of_scenes_without_keep(review.with_final(_graded(spark, sf_dir, TARGET))).select("batch_id", "path", "group_id")


def dropped_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.dropped_scenes(review.with_final(_graded(spark, sf_dir, TARGET)), TARGET)


def score_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.score_statistics(score.scored(frames(spark, sf_dir)), 0.25)


def sorted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.sorted_frames(score.scored(frames(spark, sf_dir)), "score_desc").select("batch_id", "path", "position")


def main_face_regrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another main face in every 50th frame: its measurements change and its whole batch is graded again."""
    df = frames(spark, sf_dir)
    edits = df.where("input_order % 50 = 3").select(
        "path", (F.col("sharpness") - 20).alias("sharpness"), F.lit(0.02).alias("face_area_ratio"), F.lit(0.1).alias("eyes_open")
    )
    changed = review.with_measurements(df, edits)
    redone = grade.graded(score.scored(scenes.with_scenes(changed, TIGHT)).drop("lines"))
    return redone.select("batch_id", "path", "grade")


def place_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = places.with_places(frames(spark, sf_dir))
    return df.where("place_id is not null").select("batch_id", "path", "place_id")


def place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.places(places.with_places(frames(spark, sf_dir)))


def place_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.coverage(places.with_places(frames(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        keep_review_reject_by_batch, score_lines, score_totals, score_without_faces, scene_split, scene_sizes, scene_count,
        capture_gaps, grade_ladder, target_keep_threshold, achievable_keep_floor, grade_reasons, scenes_without_keep,
        dropped_scenes, score_statistics, sorted_frames, main_face_regrade, place_clusters, place_labels, place_coverage,
    )
}


# -- SQL ---------------------------------------------------------------------------------------------------------------

_WEIGHT = """CASE WHEN greatest(0.0::DOUBLE, face_area_ratio) >= 0.03::DOUBLE THEN 1.0::DOUBLE
  WHEN greatest(0.0::DOUBLE, face_area_ratio) < 0.03::DOUBLE * 0.01::DOUBLE THEN 0.0::DOUBLE
  ELSE sqrt(greatest(0.0::DOUBLE, face_area_ratio) / 0.03::DOUBLE) END"""


def _terms_sql(face_priority: bool = True, source: str = "frames") -> str:
    fp, scale = ("true", "0.5") if face_priority else ("false", "1.0")
    return f"""
terms AS (SELECT *, error IS NULL AND sharpness IS NOT NULL AS ok,
  CASE source WHEN 'eye' THEN 0.75::DOUBLE WHEN 'face' THEN 0.6::DOUBLE WHEN 'af' THEN 0.55::DOUBLE
    WHEN 'tile' THEN 0.55::DOUBLE WHEN 'frame' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS trust,
  face_count > 0 AND source IN ('eye', 'face') AS on_face, {_WEIGHT} AS weight,
  0.0 <= eyes_open AND eyes_open < 0.25::DOUBLE AS closed FROM {source}),
lines AS (SELECT *,
  {scale}::DOUBLE * (trust * sharpness + (1.0::DOUBLE - trust) * frame_sharpness) AS t0,
  CASE WHEN {fp} AND on_face AND background_sharpness - sharpness > 0 THEN
    -(15.0::DOUBLE * least(1.0::DOUBLE, (background_sharpness - sharpness) / 40.0::DOUBLE)
      * greatest(0.5::DOUBLE, greatest(0.0::DOUBLE, least(1.0::DOUBLE, face_confidence)))) END AS t1,
  CASE WHEN {fp} AND on_face THEN 5.0::DOUBLE END AS t2,
  CASE WHEN {fp} AND face_count = 0 THEN -10.0::DOUBLE END AS t3,
  CASE WHEN {fp} AND face_count > 0 THEN 20.0::DOUBLE * weight END AS t4,
  CASE WHEN {fp} AND source = 'eye' THEN 15.0::DOUBLE * weight END AS t6,
  CASE WHEN {fp} AND closed THEN -20.0::DOUBLE END AS t7,
  CASE WHEN {fp} AND NOT closed AND eyes_open >= 0 THEN 10.0::DOUBLE END AS t8,
  CASE WHEN {fp} AND NOT closed AND eyes_open < 0 THEN 0.0::DOUBLE END AS t9,
  CASE WHEN clipped_highlights > 0.25::DOUBLE THEN -least(1.0::DOUBLE, (clipped_highlights - 0.25::DOUBLE) * 100.0::DOUBLE) END AS t10,
  CASE WHEN clipped_shadows > 0.5::DOUBLE THEN -least(2.5::DOUBLE, (clipped_shadows - 0.5::DOUBLE) * 100.0::DOUBLE) END AS t11,
  CASE WHEN mean_luma < 8 OR mean_luma > 247 THEN -15.0::DOUBLE END AS t12 FROM terms),
totals AS (SELECT *, t0 + coalesce(t1, 0) + coalesce(t2, 0) + coalesce(t3, 0) + coalesce(t4, 0) + coalesce(t6, 0)
  + coalesce(t7, 0) + coalesce(t8, 0) + coalesce(t9, 0) + coalesce(t10, 0) + coalesce(t11, 0) + coalesce(t12, 0) AS total FROM lines),
scored AS (SELECT *, CASE WHEN ok THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, total)) ELSE 0.0::DOUBLE END AS score FROM totals)"""


_ORDER = "capture_time IS NULL, capture_time, name, input_order"
_GAPS = f"""
gapped AS MATERIALIZED (SELECT *, (epoch_us(capture_time) - epoch_us(lag(capture_time) OVER (PARTITION BY batch_id ORDER BY {_ORDER}))) / 1e6::DOUBLE AS gap,
  row_number() OVER (PARTITION BY batch_id ORDER BY {_ORDER}) AS rn FROM scored)"""
_WALK = """
fold AS (
  SELECT batch_id, rn, path, 0 AS group_id, 1 AS size, h1 AS a1, h2 AS a2 FROM gapped WHERE rn = 1
  UNION ALL
  SELECT batch_id, rn, path, CASE WHEN cut THEN prev + 1 ELSE prev END, CASE WHEN cut THEN 1 ELSE size + 1 END,
    CASE WHEN cut THEN h1 ELSE a1 END, CASE WHEN cut THEN h2 ELSE a2 END
  FROM (SELECT g.batch_id, g.rn, g.path, f.group_id AS prev, f.size, f.a1, f.a2, g.h1, g.h2,
      coalesce(g.gap > 300, false) OR f.size >= 40
      OR coalesce(bit_count(xor(g.h1, f.a1)) + bit_count(xor(g.h2, f.a2)) > CASE WHEN g.gap IS NULL THEN 16 ELSE 30 END, false) AS cut
    FROM fold f JOIN gapped g ON g.batch_id = f.batch_id AND g.rn = f.rn + 1))"""
_SCENED = f"""{_GAPS}, {_WALK},
scened AS (SELECT gapped.*, fold.group_id FROM gapped JOIN fold USING (batch_id, rn))"""


def _grades_sql(ratio=None, least: float = 0.0) -> str:
    if ratio is None:
        keep = "SELECT DISTINCT batch_id, 65.0::DOUBLE AS keep_at FROM ranked"
    else:
        keep = f"""
  SELECT w.batch_id, CASE WHEN n = 0 THEN 65.0::DOUBLE WHEN extra <= 0 THEN CAST('Infinity' AS DOUBLE)
    WHEN extra >= others THEN 0.0::DOUBLE ELSE r.score END AS keep_at
  FROM (SELECT batch_id, count(*) FILTER (ok) AS n,
          CAST(round_even(count(*) FILTER (ok) * {ratio}::DOUBLE, 0) AS BIGINT)
            - count(*) FILTER (ok AND group_rank = 0 AND score >= {least}) AS extra,
          count(*) FILTER (ok AND group_rank <> 0) AS others FROM ranked GROUP BY batch_id) w
  LEFT JOIN (SELECT batch_id, score, row_number() OVER (PARTITION BY batch_id ORDER BY score DESC) AS place
             FROM ranked WHERE ok AND group_rank <> 0) r ON r.batch_id = w.batch_id AND r.place = w.extra"""
    return f"""
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY batch_id, group_id ORDER BY score DESC, name, input_order) - 1 AS INTEGER) AS group_rank,
  max(score) OVER (PARTITION BY batch_id, group_id) AS group_best FROM scened),
cut AS (SELECT batch_id, round(greatest(15.0::DOUBLE, coalesce(quantile_cont(score, 0.15) FILTER (ok), 15.0::DOUBLE)), 9) AS threshold FROM ranked GROUP BY batch_id),
keeps AS ({keep}),
graded AS (SELECT ranked.*, threshold, keep_at, CASE WHEN NOT ok THEN 'reject' WHEN score >= keep_at AND face_count > 0 THEN 'keep'
  WHEN group_rank < 1 AND score >= {least} THEN 'keep' WHEN round(score, 9) < threshold THEN 'reject'
  WHEN group_best - score >= 10 THEN 'reject' ELSE 'review' END AS grade
  FROM ranked JOIN cut USING (batch_id) JOIN keeps USING (batch_id))"""


_PLAIN = f"WITH RECURSIVE {FRAMES_SQL}, {_terms_sql()}"
_GRADED = f"{_PLAIN}, {_SCENED}, {_grades_sql()}"
_TARGET = f"{_PLAIN}, {_SCENED}, {_grades_sql(0.35, 40.0)}"

_FOLD = f"WITH RECURSIVE {FRAMES_SQL}, scored AS (SELECT * FROM frames), {_GAPS}, {_WALK}"

_HAVERSINE = """2 * 6371000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(g.latitude - f.lat) / 2), 2)
  + cos(radians(f.lat)) * cos(radians(g.latitude)) * pow(sin(radians(g.longitude - f.lon) / 2), 2))))"""
_PLACES = f"""WITH RECURSIVE {FRAMES_SQL},
located AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY capture_time NULLS FIRST, name, input_order) AS rn
  FROM frames WHERE latitude IS NOT NULL),
walk AS (
  SELECT batch_id, rn, path, 0 AS cluster, 1 AS n, latitude AS lat, longitude AS lon FROM located WHERE rn = 1
  UNION ALL
  SELECT batch_id, rn, path, CASE WHEN near THEN cluster ELSE cluster + 1 END, CASE WHEN near THEN n + 1 ELSE 1 END,
    CASE WHEN near THEN lat + (latitude - lat) / (n + 1) ELSE latitude END, CASE WHEN near THEN lon + (longitude - lon) / (n + 1) ELSE longitude END
  FROM (SELECT g.batch_id, g.rn, g.path, g.latitude, g.longitude, f.cluster, f.n, f.lat, f.lon, {_HAVERSINE} <= 250 AS near
    FROM walk f JOIN located g ON g.batch_id = f.batch_id AND g.rn = f.rn + 1)),
big AS (SELECT batch_id, cluster, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY cluster) AS INTEGER) AS place_id
  FROM (SELECT batch_id, cluster FROM walk GROUP BY 1, 2 HAVING count(*) >= 2)),
placed AS (SELECT walk.batch_id, path, place_id FROM walk JOIN big USING (batch_id, cluster))"""

_REASON_ROWS = """
  SELECT path, 0 AS k, 'error' AS key, coalesce(error, '') AS reason FROM graded WHERE NOT ok
  UNION ALL SELECT path, 1, 'roi_sharpness', 'measured sharpness ' || CAST(CAST(round_even(sharpness, 0) AS BIGINT) AS VARCHAR) || ', region: ' ||
    CASE source WHEN 'eye' THEN 'eyes' WHEN 'tile' THEN 'likely subject' WHEN 'frame' THEN 'full picture' ELSE source END FROM graded WHERE ok
  UNION ALL SELECT path, 2, 'not_raw', upper(regexp_extract(name, '\\.([^./]+)$', 1)) || ' file, not a RAW file' FROM graded WHERE ok AND lower(name) SIMILAR TO '.*\\.(jpg|jpeg|hif|heic|heif)'
  UNION ALL SELECT path, 3, 'face_count', 'faces found: ' || face_count FROM graded WHERE ok AND face_count > 0
  UNION ALL SELECT path, 4, 'face_defocus', 'background is ' || CAST(CAST(round_even(background_sharpness - sharpness, 0) AS BIGINT) AS VARCHAR) || ' points sharper than the face' FROM graded WHERE ok AND t1 IS NOT NULL
  UNION ALL SELECT path, 5, 'highlight_clip', CAST(CAST(round_even(clipped_highlights * 100, 0) AS BIGINT) AS VARCHAR) || '% of the picture has burnt highlights' FROM graded WHERE ok AND clipped_highlights > 0.25::DOUBLE
  UNION ALL SELECT path, 6, 'shadow_clip', CAST(CAST(round_even(clipped_shadows * 100, 0) AS BIGINT) AS VARCHAR) || '% of the picture has blocked shadows' FROM graded WHERE ok AND clipped_shadows > 0.5::DOUBLE
  UNION ALL SELECT path, 7, 'eyes_unknown', 'no eye could be measured' FROM graded WHERE ok AND eyes_open < 0
  UNION ALL SELECT path, 8, 'eyes_closed', 'closed eyes: ratio ' || printf('%.2f', eyes_open) || ' under 0.25' FROM graded WHERE ok AND closed
  UNION ALL SELECT path, 9, 'eyes_open', 'open eyes: ratio ' || printf('%.2f', eyes_open) FROM graded WHERE ok AND NOT closed AND eyes_open >= 0
  UNION ALL SELECT path, 10, 'frame_black', 'nearly no light in the picture' FROM graded WHERE ok AND mean_luma < 8
  UNION ALL SELECT path, 11, 'frame_white', 'nearly only white in the picture' FROM graded WHERE ok AND mean_luma > 247
  UNION ALL SELECT path, 12, 'batch_bottom', 'among the weakest of the batch, under ' || CAST(CAST(round_even(threshold, 0) AS BIGINT) AS VARCHAR) FROM graded WHERE ok AND round(score, 9) < threshold
  UNION ALL SELECT path, 13, 'better_in_group', 'the scene has a picture ' || CAST(CAST(round_even(group_best - score, 0) AS BIGINT) AS VARCHAR) || ' points better' FROM graded WHERE ok AND group_best - score >= 10"""

_KEYS = [(0, "sharpness"), (1, "face_defocus"), (2, "focus_on_face"), (3, "no_face"), (4, "face_detected"), (6, "eye_detected"),
         (7, "eyes_closed"), (8, "eyes_open"), (9, "eyes_unknown"), (10, "highlight_clip"), (11, "shadow_clip"), (12, "extreme_luma")]
_LINE_ROWS = "\n  UNION ALL ".join(
    [f"SELECT path, {k} AS k, '{name}' AS key, t{k} AS value FROM scored WHERE ok AND t{k} IS NOT NULL" for k, name in _KEYS]
    + ["SELECT path, 0, 'failed', 0.0::DOUBLE FROM scored WHERE NOT ok",
       "SELECT path, 99, 'clamped', score - total FROM scored WHERE ok AND score <> total"]
)

ORACLES = {
    "keep_review_reject_by_batch": f"{_GRADED} SELECT batch_id, count(*) FILTER (grade = 'keep') AS keep, count(*) FILTER (grade = 'review') AS review, count(*) FILTER (grade = 'reject') AS reject FROM graded GROUP BY batch_id",
    "score_lines": f"{_PLAIN}, l AS ({_LINE_ROWS}) SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS INTEGER) AS pos, key, value FROM l",
    "score_totals": f"{_PLAIN} SELECT path, round(score, 9) AS score FROM scored",
    "score_without_faces": f"WITH {FRAMES_SQL}, {_terms_sql(False)} SELECT path, round(score, 9) AS score FROM scored",
    "scene_split": f"{_FOLD} SELECT batch_id, path, group_id FROM fold",
    "scene_sizes": f"{_FOLD} SELECT batch_id, group_id, count(*) AS frames FROM fold GROUP BY 1, 2",
    "scene_count": f"{_FOLD} SELECT batch_id, count(DISTINCT group_id) AS scenes FROM fold GROUP BY 1",
    "capture_gaps": f"{_PLAIN}, {_GAPS} SELECT path, gap FROM gapped",
    "grade_ladder": f"{_GRADED} SELECT batch_id, path, group_id, group_rank, threshold, grade, round(group_best - score, 9) AS deficit FROM graded",
    "target_keep_threshold": f"{_TARGET} SELECT batch_id, round(any_value(keep_at), 9) AS keep_at, count(*) FILTER (grade = 'keep') AS keep FROM graded GROUP BY 1",
    "achievable_keep_floor": f"{_TARGET} SELECT batch_id, round(CASE WHEN count(*) FILTER (ok) = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (ok AND group_rank = 0 AND score >= 40)::DOUBLE / count(*) FILTER (ok) END, 9) AS floor FROM graded GROUP BY 1",
    "grade_reasons": f"{_GRADED}, r AS ({_REASON_ROWS}) SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS INTEGER) AS pos, key, reason FROM r",
    "scenes_without_keep": f"{_TARGET} SELECT batch_id, path, group_id FROM graded WHERE (batch_id, group_id) IN (SELECT (batch_id, group_id) FROM graded GROUP BY batch_id, group_id HAVING count(*) FILTER (grade = 'keep') = 0)",
    "dropped_scenes": f"{_TARGET} SELECT batch_id, count(*) FILTER (k = 0) AS dropped FROM (SELECT batch_id, group_id, count(*) FILTER (grade = 'keep') AS k FROM graded GROUP BY 1, 2) GROUP BY 1",
    "score_statistics": f"{_PLAIN}, n AS (SELECT batch_id, count(*) AS n FROM scored GROUP BY 1), p AS (SELECT batch_id, score, row_number() OVER (PARTITION BY batch_id ORDER BY score DESC) AS place FROM scored) SELECT batch_id, round(min(score), 9) AS low, round(avg(score), 6) AS mean, round(max(score), 9) AS high, round(max(score) FILTER (place = greatest(1, CAST(round_even(n * 0.25::DOUBLE, 0) AS BIGINT))), 9) AS cutoff FROM p JOIN n USING (batch_id) GROUP BY 1",
    "sorted_frames": f"{_PLAIN} SELECT batch_id, path, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY score DESC, name, input_order) AS INTEGER) AS position FROM scored",
    "main_face_regrade": f"WITH RECURSIVE {FRAMES_SQL}, changed AS (SELECT * REPLACE (CASE WHEN input_order % 50 = 3 THEN sharpness - 20 ELSE sharpness END AS sharpness, CASE WHEN input_order % 50 = 3 THEN 0.02::DOUBLE ELSE face_area_ratio END AS face_area_ratio, CASE WHEN input_order % 50 = 3 THEN 0.1::DOUBLE ELSE eyes_open END AS eyes_open) FROM frames), {_terms_sql(True, 'changed')}, {_SCENED}, {_grades_sql()} SELECT batch_id, path, grade FROM graded",
    "place_clusters": f"{_PLACES} SELECT batch_id, path, place_id FROM placed",
    "place_labels": f"{_PLACES}, g AS (SELECT p.batch_id, place_id, count(*) AS n, CAST(sum(CAST(latitude AS DECIMAL(12, 9))) AS DOUBLE) / count(*) AS lat, CAST(sum(CAST(longitude AS DECIMAL(12, 9))) AS DOUBLE) / count(*) AS lon FROM placed p JOIN frames USING (path) GROUP BY 1, 2) SELECT batch_id, place_id, n, printf('%02d_%.4f%s_%.4f%s', place_id, abs(lat), CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, abs(lon), CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) AS label, lat AS latitude, lon AS longitude FROM g",
    "place_coverage": f"{_PLACES} SELECT f.batch_id, count(DISTINCT place_id) AS places, count(latitude) AS located, count(*) AS total FROM frames f LEFT JOIN placed USING (path) GROUP BY 1",
}
