"""Queries over tone tables, lens lookups, catalogue files, settings and export options, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.operators import images, lenses, options, settings
from framesieve.plans.wider import _new_path
from framesieve.sources.tables import table

# -- tone tables: embeddings as pictures of 64 pixels, their targets brighter and harder ---------------------------------


def _level(x, gain: float = 1.0, lift: float = 0.5):
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") * gain + lift) * 255).cast("int")))


def _pixels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), "embedding", F.posexplode("embedding").alias("i", "x"))
    other = lambda k: _level(F.get("embedding", F.pmod(F.col("i") + k, F.lit(64))))
    return e.select(
        "frame_id", _level(F.col("x")).alias("luma"), other(1).alias("cb"), other(3).alias("cr"),
        _level(F.col("x"), 1.2, 0.55).alias("target_luma"), other(2).alias("target_cb"), other(5).alias("target_cr"),
    )


def _tones(spark, sf_dir):
    pixels = _pixels(spark, sf_dir)
    counts = lambda c: images.histogram(pixels.select("frame_id", F.lit("luma").alias("channel"), F.col(c).alias("level")))
    return images.tone_table(counts("luma"), counts("target_luma"))


def tone_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in steps of 1/1024 of a level: unlike decimal places these have no ties that engines round apart."""
    found = _tones(spark, sf_dir).select("frame_id", F.posexplode("tone").alias("level", "tone"))
    return found.withColumn("tone", F.floor(F.col("tone") * 1024).cast("long"))


def look_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.look_errors(_pixels(spark, sf_dir), _tones(spark, sf_dir))
    return found.select("frame_id", *(F.round(c, 6).alias(c) for c in ("luma_before", "luma_error", "chroma_error")))


_SHARES = ", ".join(repr(0.02 + 0.96 * i / 15) for i in range(16))
_TONE_SQL = f"""WITH e AS (SELECT vec_id AS frame_id, embedding, unnest(range(0, 64)) AS i FROM embeddings),
lev AS (SELECT frame_id, i, list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor((x::DOUBLE + 0.5::DOUBLE) * 255) AS INTEGER)))) AS l,
  greatest(0, least(255, CAST(floor((embedding[i + 1]::DOUBLE * 1.2::DOUBLE + 0.55::DOUBLE) * 255) AS INTEGER))) AS target_luma FROM e),
p AS (SELECT frame_id, l[i + 1] AS luma, l[(i + 1) % 64 + 1] AS cb, l[(i + 3) % 64 + 1] AS cr, target_luma,
  l[(i + 2) % 64 + 1] AS target_cb, l[(i + 5) % 64 + 1] AS target_cr FROM lev),
q AS (SELECT frame_id, quantile_cont(luma::DOUBLE, [{_SHARES}]) AS a, quantile_cont(target_luma::DOUBLE, [{_SHARES}]) AS b FROM p GROUP BY 1),
c AS (SELECT frame_id, list_concat([0.0::DOUBLE], list_transform(a, lambda v: round(v, 9)), [255.0::DOUBLE]) AS src,
  list_concat([0.0::DOUBLE], list_transform(b, lambda v: round(v, 9)), [255.0::DOUBLE]) AS dst FROM q),
x AS (SELECT *, CAST(unnest(range(0, 256)) AS INTEGER) AS level FROM c),
j AS (SELECT *, len(list_filter(src, lambda v: v <= level)) AS j FROM x),
t AS (SELECT frame_id, level, CASE WHEN j = 18 THEN dst[18] ELSE dst[j] + (level - src[j]) * (dst[j + 1] - dst[j]) / (src[j + 1] - src[j]) END AS tone FROM j)"""

# -- lens lookup: parts as lenses, suppliers as bodies, orders as shots ----------------------------------------------------


def _bodies(spark, sf_dir):
    k = F.col("s_suppkey")
    model = F.concat(F.lit("EOS R"), (k % 6).cast("string"), F.when(k % 2 == 0, "m3").otherwise(""))
    mount = F.when(k % 5 < 3, "RF").when(k % 5 == 3, "EF")
    return table(spark, sf_dir, "supplier").select(F.lit("Canon").alias("maker"), model.alias("model"), mount.alias("mount"), k.alias("position"))


def _lenses(spark, sf_dir):
    k = F.col("p_partkey")
    low = k % 90 + 10
    placeholder = k % 17 == 0
    name = F.concat(low.cast("string"), F.lit("-"), (low * 3).cast("string"), F.lit("mm f/"), (k % 5 + 2).cast("string"))
    mounts = F.when(k % 2 == 0, F.array(F.lit("RF"))).when(k % 3 != 0, F.array(F.lit("EF"), F.lit("EF-S")))
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("maker"),
        F.when(placeholder, F.concat(F.lit("Rectilinear "), name)).otherwise(name).alias("model"), mounts.alias("mounts"),
        low.cast("double").alias("min_focal"), F.when(k % 19 == 0, low * 26).otherwise(low * 3).cast("double").alias("max_focal"), k.alias("position"),
    )


def _shots(spark, sf_dir):
    n, low = F.col("o_orderkey"), F.col("o_orderkey") % 90 + 10
    body = F.concat(F.lit("EOS R"), (n % 9).cast("string"), F.when(n % 2 == 0, " Mark III").otherwise(""))
    plain = F.concat(low.cast("string"), F.lit("-"), (low * 3).cast("string"), F.lit("mm F"), (n % 6 + 2).cast("string"))
    name = F.when(n % 17 == 0, F.concat(F.lit("Rectilinear "), plain)).otherwise(
        F.concat(F.when(n % 3 == 0, "E ").when(n % 3 == 1, "RF").otherwise(""), plain, F.when(n % 4 == 0, " A069").otherwise(""))
    )
    return table(spark, sf_dir, "orders").select(
        n.alias("id"), F.when(n % 23 != 0, body).alias("camera_model"), F.when(n % 3 == 0, "CANON").alias("camera_make"),
        F.when(n % 11 != 0, name).alias("lens_model"),
        F.when(n % 7 == 0, 900.0).when(n % 7 == 1, 0.0).when(n % 7 != 2, low.cast("double")).alias("focal_length"),
    )


def lens_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lenses.find_lenses(_shots(spark, sf_dir), _bodies(spark, sf_dir), _lenses(spark, sf_dir))
    return found.select("id", "camera", "lens", "reason")


def lens_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _shots(spark, sf_dir).select("id", "camera_model", "lens_model")
    found = lenses.find_lenses_by_name(requests, _bodies(spark, sf_dir), _lenses(spark, sf_dir))
    return found.select("id", "camera", "lens", "reason")


def _lookup_sql(focal: str) -> str:
    return f"""WITH bodies AS (
  SELECT 'Canon EOS R' || s_suppkey % 6 || CASE WHEN s_suppkey % 2 = 0 THEN 'm3' ELSE '' END AS camera, s_suppkey AS position,
    CASE WHEN s_suppkey % 5 < 3 THEN 'RF' WHEN s_suppkey % 5 = 3 THEN 'EF' END AS mount FROM supplier),
body AS (SELECT camera, arg_min({{'m': mount}}, position).m AS mount FROM bodies GROUP BY 1),
lens AS (
  SELECT (p_partkey % 90 + 10) || '-' || (p_partkey % 90 + 10) * 3 || 'mm f/' || (p_partkey % 5 + 2) AS name, p_partkey % 17 = 0 AS named,
    p_partkey % 17 = 0 OR p_partkey % 19 = 0 AS placeholder, p_partkey AS position, (p_partkey % 90 + 10)::DOUBLE AS low,
    CASE WHEN p_partkey % 2 = 0 THEN ['RF'] WHEN p_partkey % 3 <> 0 THEN ['EF', 'EF-S'] END AS mounts FROM part),
shot AS (
  SELECT o_orderkey AS id, o_orderkey % 23 = 0 AS no_body, o_orderkey % 11 = 0 AS no_lens, o_orderkey % 17 = 0 AS named, {focal} AS focal,
    'Canon EOS R' || o_orderkey % 9 || CASE WHEN o_orderkey % 2 = 0 THEN 'm3' ELSE '' END AS camera,
    (o_orderkey % 90 + 10) || '-' || (o_orderkey % 90 + 10) * 3 || 'mm f/' || (o_orderkey % 6 + 2) AS name FROM orders),
met AS (
  SELECT s.id, b.camera, l.position, CASE WHEN l.named THEN 'Rectilinear ' ELSE '' END || l.name AS lens,
    CASE WHEN b.mount IS NOT NULL AND NOT coalesce(list_contains(l.mounts, b.mount), true) THEN 0 WHEN l.placeholder THEN 1
      WHEN coalesce(s.focal, 0) > 0 AND NOT (s.focal >= 0.9::DOUBLE * l.low AND s.focal <= 1.1::DOUBLE * l.low * 3) THEN 2 ELSE 3 END AS stage
  FROM shot s JOIN body b ON NOT s.no_body AND s.camera = b.camera JOIN lens l ON NOT s.no_lens AND l.name = s.name AND l.named = s.named),
best AS (SELECT id, max(stage) AS stage, arg_min(lens, position) FILTER (stage = 3) AS lens FROM met GROUP BY 1)
SELECT s.id, b.camera, best.lens, CASE WHEN s.no_body THEN 'no_camera_name' WHEN b.camera IS NULL THEN 'unknown_camera'
  WHEN s.no_lens THEN 'no_lens_name' WHEN stage IS NULL THEN 'unknown_lens'
  ELSE (['other_mount', 'placeholder', 'focal_differs', 'ok'])[stage + 1] END AS reason
FROM shot s LEFT JOIN body b ON NOT s.no_body AND s.camera = b.camera LEFT JOIN best USING (id)"""


# -- catalogue files of both versions ----------------------------------------------------------------------------------


def _as_xml(rows: DataFrame, tag: str, path: str) -> str:
    rows.write.format("xml").option("rowTag", tag).option("rootTag", "lensdatabase").save(path)
    return path


def _names(*pairs):
    return F.array(*(F.struct(F.lit(v).alias("_VALUE") if isinstance(v, str) else v.alias("_VALUE"), F.lit(lang).cast("string").alias("_lang")) for v, lang in pairs))


def catalogue_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two XML catalogues of bodies written from the suppliers, read as layers."""
    both = []
    for layer in (0, 1):
        rows = _bodies(spark, sf_dir).where(F.col("position") % 2 == layer)
        rows = rows.select(
            _names(("Canon", None)).alias("maker"),
            (_names((F.col("model"), None), (F.concat(F.lit("E "), "model"), "en")) if layer else _names((F.col("model"), None))).alias("model"),
            "mount", (F.lit(1.0) + layer).alias("cropfactor"),
        )
        both.append(_as_xml(rows, "camera", _new_path(spark, "cameras")))
    found = lenses.read_cameras(spark, *both)
    return found.groupBy("layer", "maker", "model", "model_en", "mount", "cropfactor").agg(F.count("*").alias("n"))


def catalogue_distortions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lens catalogues of version 2 (even parts) and version 1 (odd ones) written as XML; their distortions read alike."""
    k = F.col("position")
    focals = lambda f: [F.col("min_focal"), F.col("max_focal"), f]
    none = F.lit(None).cast("double")
    real = lambda f: f * 0.98
    both = []
    for version in (2, 1):
        rows = _lenses(spark, sf_dir).where(k % 2 == version % 2)
        elements = []
        for i, f in enumerate(focals(F.when(k % 5 != 0, F.lit(33.0)))):
            attribute = real(F.coalesce(f, F.lit(1.0))) if version == 2 else none
            if i == 1:
                attribute = F.when(k % 3 == 0, attribute)
            elements.append(
                F.struct(
                    F.lit("ptlens" if i else "poly3").alias("_model"), f.alias("_focal"), (k % 7 / 8).alias("_a" if i else "_k1"),
                    (F.lit(0.25) if i else none).alias("_b"), attribute.alias("_real-focal"),
                )
            )
        # One element type for all: the terms that an element lacks are left out of it.
        even = [
            F.struct(
                e["_model"].alias("_model"), e["_focal"].alias("_focal"), (e["_a"] if i else none).alias("_a"), e["_b"].alias("_b"),
                (none if i else e["_k1"]).alias("_k1"), e["_real-focal"].alias("_real-focal"),
            )
            for i, e in enumerate(elements)
        ]
        parts = [F.array(*even).alias("distortion")]
        if version == 1:
            paired = F.array(*(F.struct(f.alias("_focal"), real(f).alias("_real-focal")) for f in focals(F.lit(34.0))[:1]))
            parts.append(paired.alias("real-focal-length"))
        rows = rows.select("maker", _names((F.concat("model", F.lit(" #"), k.cast("string")), None)).alias("model"), F.struct(*parts).alias("calibration"))
        both.append(_as_xml(rows, "lens", _new_path(spark, "distortions")))
    found = lenses.read_distortions(spark, *both)
    return found.select(
        "layer", "maker", "model", "kind", "focal", F.round("real_focal", 9).alias("real_focal"), F.size("terms").alias("n_terms"),
        F.round(F.aggregate("terms", F.lit(0.0), lambda a, x: a + x), 9).alias("sum_terms"),
    )


_CAMERA_FILES_SQL = """SELECT CAST(s_suppkey % 2 AS INTEGER) AS layer, 'Canon' AS maker, model, CASE WHEN s_suppkey % 2 = 1 THEN 'E ' ELSE '' END || model AS model_en,
  CASE WHEN s_suppkey % 5 < 3 THEN 'RF' WHEN s_suppkey % 5 = 3 THEN 'EF' END AS mount, 1.0::DOUBLE + s_suppkey % 2 AS cropfactor, count(*) AS n
FROM (SELECT *, 'EOS R' || s_suppkey % 6 || CASE WHEN s_suppkey % 2 = 0 THEN 'm3' ELSE '' END AS model FROM supplier) GROUP BY ALL"""
_DISTORTION_SQL = """WITH p AS (SELECT p_partkey AS k, p_brand AS maker, (p_partkey % 90 + 10)::DOUBLE AS low,
  CASE WHEN p_partkey % 17 = 0 THEN 'Rectilinear ' ELSE '' END || (p_partkey % 90 + 10) || '-' || (p_partkey % 90 + 10) * 3 || 'mm f/' || (p_partkey % 5 + 2) || ' #' || p_partkey AS model FROM part),
d AS (
  SELECT k, maker, model, 'poly3' AS kind, low AS focal, low * 0.98::DOUBLE AS real_focal, 1 AS n_terms, (k % 7) / 8::DOUBLE AS sum_terms FROM p
  UNION ALL SELECT k, maker, model, 'ptlens', high, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN high * 0.98::DOUBLE WHEN k % 2 = 1 AND high = low THEN low * 0.98::DOUBLE END, 2, (k % 7) / 8::DOUBLE + 0.25
    FROM (SELECT *, CASE WHEN k % 19 = 0 THEN low * 26 ELSE low * 3 END AS high FROM p)
  UNION ALL SELECT k, maker, model, 'ptlens', CASE WHEN k % 5 <> 0 THEN 33.0 END,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 OR low = 33 THEN 33.0 * 0.98::DOUBLE END, 2, (k % 7) / 8::DOUBLE + 0.25 FROM p)
SELECT CAST(k % 2 AS INTEGER) AS layer, maker, model, kind, focal, round(real_focal, 9) AS real_focal, n_terms, round(sum_terms, 9) AS sum_terms FROM d"""

# -- settings: JSON of every kind made from orders ----------------------------------------------------------------------

DEFAULTS = {
    "basic": {"exposure": 0.0, "contrast": 0, "look": "standard", "auto": False},
    "geometry": {"angle": 0.0, "left": 0},
    "masks": [],
    "watermark": {"enabled": False, "text": ""},
}


def _picked(n, values):
    """One of the values by the remainder of n; null leaves the key out."""
    out = None
    for i, v in enumerate(values):
        v = F.lit(None).cast("string") if v is None else F.lit(v)
        out = F.when(n % len(values) == i, v) if out is None else out.when(n % len(values) == i, v)
    return out


def _stored_settings(spark, sf_dir):
    n = F.col("o_orderkey")
    basic = F.concat_ws(
        ",",
        _picked(n, ['"exposure":"1.5"', '"exposure":0.25', '"exposure":true', '"exposure":"bright"', '"exposure":null', '"exposure":-2', None]),
        _picked(n, ['"contrast":12.9', '"contrast":"7"', '"contrast":false', '"contrast":[1]', '"contrast":-3.5']),
        _picked(n, ['"look":"film"', '"look":5', None]),
        _picked(n, ['"auto":true', '"auto":0', '"auto":3', '"auto":"yes"']),
        F.lit('"old":1'),
    )
    basic = F.when(n % 11 == 0, F.lit('"basic":"broken"')).otherwise(F.concat(F.lit('"basic":{'), basic, F.lit("}")))
    geometry = F.when(n % 6 != 5, F.concat(F.lit('"geometry":{"left":'), (n % 6).cast("string"), F.lit(',"angle":"0.5"}')))
    masks = F.when(n % 2 == 0, F.concat(F.lit('"masks":[{"kind":"radial","x":'), n.cast("string"), F.lit("}]"))).otherwise('"masks":{"x":1}')
    mark = F.concat(F.lit('"watermark":{"enabled":'), F.when(n % 2 == 0, "1").otherwise("false"), F.lit(',"text":"w'), (n % 3).cast("string"), F.lit('"}'))
    whole = F.concat(F.lit("{"), F.concat_ws(",", basic, geometry, masks, mark), F.lit("}"))
    return table(spark, sf_dir, "orders").select(n.alias("id"), F.when(n % 13 == 0, "{oops").otherwise(whole).alias("stored"))


def _flat(df: DataFrame, column: str = "s") -> DataFrame:
    return df.select("id", f"{column}.basic.*", f"{column}.geometry.*", f"{column}.masks", f"{column}.watermark.*")


def settings_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _stored_settings(spark, sf_dir)
    return _flat(df.select("id", settings.typed(F.col("stored"), DEFAULTS).alias("s")))


def _two_settings(spark, sf_dir, neutral_every: int):
    df = _stored_settings(spark, sf_dir)
    own = F.when(F.col("id") % 8 != 0, settings.typed(F.col("stored"), DEFAULTS))
    other = '{"basic":{"exposure":0.5,"contrast":4},"geometry":{"left":9},"masks":[{"x":9}],"watermark":{"text":"given"}}'
    given = spark.createDataFrame([(False, other), (True, '{"geometry":{"left":9}}')], "is_neutral boolean, stored string")
    given = given.select("is_neutral", settings.typed(F.col("stored"), DEFAULTS).alias("given"))  # two rows, for all frames
    rows = df.select("id", own.alias("own"), (F.col("id") % neutral_every == 0).alias("is_neutral"))
    return rows.join(F.broadcast(given), "is_neutral").drop("is_neutral")


def settings_apply_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _two_settings(spark, sf_dir, 10)
    return _flat(df.select("id", settings.shared(F.col("own"), F.col("given"), DEFAULTS).alias("s")))


def settings_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _two_settings(spark, sf_dir, 10)
    return _flat(df.select("id", settings.with_preset(F.col("own"), F.col("given"), DEFAULTS).alias("s")))


_SETTINGS_SQL = """WITH o AS (SELECT o_orderkey AS n, o_orderkey % 13 <> 0 AS fine, o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AS basic FROM orders),
typed AS (SELECT n,
  CASE WHEN NOT basic THEN 0.0::DOUBLE ELSE (CASE n % 7 WHEN 0 THEN 1.5 WHEN 1 THEN 0.25 WHEN 5 THEN -2 ELSE 0 END)::DOUBLE END AS exposure,
  CASE WHEN NOT basic THEN 0::BIGINT ELSE (CASE n % 5 WHEN 0 THEN 12 WHEN 1 THEN 7 WHEN 4 THEN -3 ELSE 0 END)::BIGINT END AS contrast,
  CASE WHEN basic AND n % 3 = 0 THEN 'film' ELSE 'standard' END AS look,
  basic AND n % 4 IN (0, 2) AS auto,
  CASE WHEN fine AND n % 6 <> 5 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS angle,
  CASE WHEN fine AND n % 6 <> 5 THEN n % 6 ELSE 0::BIGINT END AS "left",
  CASE WHEN fine AND n % 2 = 0 THEN '[{"kind":"radial","x":' || n || '}]' ELSE '[]' END AS masks,
  fine AND n % 2 = 0 AS enabled, CASE WHEN fine THEN 'w' || n % 3 ELSE '' END AS text FROM o)"""

# -- export options made from orders -----------------------------------------------------------------------------------


def _options(spark, sf_dir):
    n = F.col("o_orderkey")
    pick = lambda k, *v: F.get(F.array(*(F.lit(x) for x in v)), (k % len(v)).cast("int"))
    return table(spark, sf_dir, "orders").select(
        n.alias("id"), pick(n, "jpeg", "png", "webp", "tiff", "heif", None).alias("image_format"),
        pick(n, "none", "long_edge", "percent", "fit").alias("resize_mode"),
        pick(F.floor(n / 6), "srgb", "adobe_rgb", "p3", None).alias("color_space"),
        pick(F.floor(n / 5), 8, 16, 12, None).cast("int").alias("bit_depth"),
        F.when(n % 3 == 0, F.array(F.lit("reject"), F.lit("best"), F.lit("keep"))).when(n % 3 == 1, F.array(F.lit("nope"))).alias("grades"),
        (n % 5000).cast("int").alias("resize_long_edge"), (n % 100).cast("int").alias("resize_percent"),
        F.when(n % 10 != 0, n % 7000).alias("source"),
    )


def export_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = options.coerced(_options(spark, sf_dir)).withColumn("long_edge", options.long_edge(F.col("source")))
    return found.select("id", "image_format", "resize_mode", "color_space", "bit_depth", F.array_join("grades", ",").alias("grades"), "suffix", "long_edge")


def export_option_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options.changes(options.coerced(_options(spark, sf_dir)), "id")


_OPTIONS_SQL = """WITH g AS (SELECT o_orderkey AS id, (['jpeg', 'png', 'webp', 'tiff', 'heif', NULL])[o_orderkey % 6 + 1] AS f0, (['none', 'long_edge', 'percent', 'fit'])[o_orderkey % 4 + 1] AS r0,
  (['srgb', 'adobe_rgb', 'p3', NULL])[(o_orderkey // 6) % 4 + 1] AS c0, ([8, 16, 12, NULL])[(o_orderkey // 5) % 4 + 1] AS b0,
  o_orderkey % 5000 AS edge, o_orderkey % 100 AS percent, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 7000 END AS source FROM orders),
h AS (SELECT *, CASE WHEN f0 IN ('jpeg', 'png', 'webp', 'tiff') THEN f0 ELSE 'jpeg' END AS f, CASE WHEN r0 = 'fit' THEN 'none' ELSE r0 END AS r FROM g),
k AS (SELECT *, CASE WHEN c0 = 'adobe_rgb' AND f <> 'webp' THEN c0 ELSE 'srgb' END AS c, CASE WHEN b0 = 16 AND f IN ('png', 'tiff') THEN 16 ELSE 8 END AS b FROM h)"""

QUERIES = {
    f.__name__: f
    for f in (
        tone_table, look_errors, lens_lookup, lens_by_name, catalogue_cameras, catalogue_distortions, settings_typed,
        settings_apply_all, settings_preset, export_options, export_option_changes,
    )
}

_GIVEN = "CASE WHEN n % 8 <> 0 THEN {0} ELSE {1} END AS {2}"
_OWN = ", ".join(_GIVEN.format(c, d, c if c != '"left"' else c) for c, d in (("angle", "0.0::DOUBLE"), ('"left"', "0::BIGINT"), ("masks", "'[]'")))
_MARKED = ", ".join(_GIVEN.format(c, d, c) for c, d in (("enabled", "false"), ("text", "''")))

ORACLES = {
    "tone_table": f"{_TONE_SQL} SELECT frame_id, level, CAST(floor(tone * 1024) AS BIGINT) AS tone FROM t",
    "look_errors": f"{_TONE_SQL} SELECT p.frame_id, round(avg(abs(luma - target_luma)), 6) AS luma_before, round(avg(abs(tone - target_luma)), 6) AS luma_error, round(avg((abs(cb - target_cb) + abs(cr - target_cr)) / 2::DOUBLE), 6) AS chroma_error FROM p JOIN t ON p.frame_id = t.frame_id AND p.luma = t.level GROUP BY 1",
    "lens_lookup": _lookup_sql("CASE o_orderkey % 7 WHEN 0 THEN 900.0::DOUBLE WHEN 1 THEN 0.0 WHEN 2 THEN NULL ELSE (o_orderkey % 90 + 10)::DOUBLE END"),
    "lens_by_name": _lookup_sql("NULL::DOUBLE"),
    "catalogue_cameras": _CAMERA_FILES_SQL,
    "catalogue_distortions": _DISTORTION_SQL,
    "settings_typed": f"{_SETTINGS_SQL} SELECT n AS id, * EXCLUDE (n) FROM typed",
    "settings_apply_all": f"""{_SETTINGS_SQL}, s AS (SELECT n, n % 10 <> 0 AS given, {_OWN} FROM typed)
SELECT n AS id, CASE WHEN given THEN 0.5::DOUBLE END AS exposure, CASE WHEN given THEN 4::BIGINT END AS contrast, CASE WHEN given THEN 'standard' END AS look, CASE WHEN given THEN false END AS auto,
  CASE WHEN given THEN angle END AS angle, CASE WHEN given THEN "left" END AS "left", CASE WHEN given THEN masks END AS masks, CASE WHEN given THEN false END AS enabled, CASE WHEN given THEN 'given' END AS text FROM s""",
    "settings_preset": f"""{_SETTINGS_SQL}, s AS (SELECT n, n % 10 <> 0 AS given, {_OWN}, {_MARKED} FROM typed)
SELECT n AS id, CASE WHEN given THEN 0.5::DOUBLE ELSE 0.0 END AS exposure, CASE WHEN given THEN 4::BIGINT ELSE 0 END AS contrast, 'standard' AS look, false AS auto, angle, "left", masks, enabled, text FROM s""",
    "export_options": f"""{_OPTIONS_SQL} SELECT id, f AS image_format, r AS resize_mode, c AS color_space, b AS bit_depth, CASE WHEN id % 3 = 0 THEN 'reject,keep' ELSE 'keep,review,reject' END AS grades,
  CASE f WHEN 'jpeg' THEN '.jpg' WHEN 'png' THEN '.png' WHEN 'webp' THEN '.webp' ELSE '.tif' END AS suffix,
  CAST(CASE WHEN r = 'long_edge' THEN greatest(64, edge) WHEN r = 'percent' AND source > 0 THEN greatest(64, source * percent // 100) END AS BIGINT) AS long_edge FROM k""",
    "export_option_changes": f"""{_OPTIONS_SQL} SELECT id, 'image_format' AS field, f0 AS given, f AS became FROM k WHERE f0 IS DISTINCT FROM f
  UNION ALL SELECT id, 'resize_mode', r0, r FROM k WHERE r0 IS DISTINCT FROM r UNION ALL SELECT id, 'color_space', c0, c FROM k WHERE c0 IS DISTINCT FROM c
  UNION ALL SELECT id, 'bit_depth', CAST(b0 AS VARCHAR), CAST(b AS VARCHAR) FROM k WHERE b0 IS DISTINCT FROM b""",
}
