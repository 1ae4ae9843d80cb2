"""Tone tables, lens lookups, settings and options against small plain versions."""

import numpy as np
from pyspark.sql import functions as F

from framesieve.operators import images, lenses, options, settings
from framesieve.plans import develop


def test_tone_table_is_the_interpolation_of_quantiles(spark):
    rng = np.random.default_rng(4)
    frames = {}
    for i in range(12):
        a = rng.integers(0, 256, 500) if i else np.zeros(500, int)
        b = np.clip(a + rng.integers(-40, 60, 500), 0, 255) if i % 3 else np.full(500, 200)
        frames[i] = a, b
    table = lambda k: spark.createDataFrame(
        [(i, "luma", int(v)) for i, ab in frames.items() for v in ab[k]], "frame_id long, channel string, level int"
    )
    got = {r.frame_id: r.tone for r in images.tone_table(images.histogram(table(0)), images.histogram(table(1))).collect()}
    shares = np.linspace(0.02, 0.98, 16)
    for i, (a, b) in frames.items():
        src = np.maximum.accumulate(np.concatenate(([0.0], np.round(np.quantile(a, shares), 9), [255.0])))
        dst = np.maximum.accumulate(np.concatenate(([0.0], np.round(np.quantile(b, shares), 9), [255.0])))
        want = np.interp(np.arange(256), src, dst)
        assert np.allclose(got[i], want, atol=1e-7) and all(x <= y + 1e-9 for x, y in zip(got[i], got[i][1:]))
    pixels = [(i, int(x), 1, 2, int(y), 4, 2) for i, ab in frames.items() for x, y in zip(*ab)]
    df = spark.createDataFrame(pixels, "frame_id long, luma int, cb int, cr int, target_luma int, target_cb int, target_cr int")
    tones = spark.createDataFrame(list(got.items()), "frame_id long, tone array<double>")
    for r in images.look_errors(df, tones).collect():
        a, b = frames[r.frame_id]
        assert np.isclose(r.luma_before, np.abs(a - b).mean()) and r.chroma_error == 1.5
        assert np.isclose(r.luma_error, np.abs(np.array(got[r.frame_id])[a] - b).mean())
        assert r.luma_error <= r.luma_before + 1e-9 or r.frame_id


def test_lens_reasons(spark):
    cameras = spark.createDataFrame([("Canon", "EOS R5", "RF", 2), ("Canon", "EOS R5", "EF", 1), ("Sony", "A7", None, 3)], "maker string, model string, mount string, position int")
    catalogue = spark.createDataFrame(
        [
            ("24-70mm f/2", ["EF"], 24.0, 70.0, 5), ("70-24mm f/2", ["RF"], 24.0, 70.0, 4), ("50mm f/1", ["RF"], 50.0, 50.0, 3),
            ("Rectilinear 10-1000mm f/1", ["EF"], 10.0, 1000.0, 2), ("85mm f/1", None, 85.0, 85.0, 1), ("85mm f/1", ["EF"], 85.0, 85.0, 0),
            ("35mm f/2", ["EF"], 0.0, 0.0, 6),
        ],
        "model string, mounts array<string>, min_focal double, max_focal double, position int",
    )
    shots = [
        (1, None, "Canon", "50mm f/1", 50.0), (2, "EOS X", None, "50mm f/1", 50.0), (3, "EOS R5", "Canon", None, 50.0),
        (4, "EOS R5", "Canon", "nothing 9mm", 9.0), (5, "EOS R5", "Canon", "50mm f/1", 50.0), (6, "EOS R5", None, "24-70mm F2", 90.0),
        (7, "EOS R5", "Canon", "24-70mm F2", 60.0), (8, "EOS R5", "Canon", "24-70mm F2", None), (9, "EOS R5", "Canon", "Rectilinear 10-1000mm f/1", 20.0),
        (10, "EOS R5", "Canon", "85mm f/1", -1.0), (11, "A7", "Sony", "50mm f/1", 0.0), (12, "EOS R5", "", "35mm f/2", 35.0),
    ]
    df = spark.createDataFrame(shots, "id int, camera_model string, camera_make string, lens_model string, focal_length double")
    got = {r.id: (r.lens, r.reason) for r in lenses.find_lenses(df, cameras, catalogue).collect()}
    assert got == {
        1: (None, "no_camera_name"), 2: (None, "unknown_camera"), 3: (None, "no_lens_name"), 4: (None, "unknown_lens"),
        5: (None, "other_mount"), 6: (None, "focal_differs"), 7: ("24-70mm f/2", "ok"), 8: ("24-70mm f/2", "ok"),
        9: (None, "placeholder"), 10: ("85mm f/1", "ok"), 11: ("50mm f/1", "ok"), 12: ("35mm f/2", "ok"),
    }
    by_name = lenses.find_lenses_by_name(df.select("id", "camera_model", "lens_model"), cameras, catalogue)
    assert {r.id: r.reason for r in by_name.collect()}[6] == "ok"
    assert lenses.find_lenses(df.limit(0), cameras, catalogue).collect() == []


def test_every_reason_is_in_the_query(spark):
    found = develop.lens_lookup(spark, "/root/testdata/sf0.01").groupBy("reason").count().collect()
    assert {r.reason for r in found} == {"no_camera_name", "unknown_camera", "no_lens_name", "unknown_lens", *lenses.STAGES}


def test_odd_settings(spark):
    defaults = {"a": {"n": 7, "x": 1.5, "t": "d", "b": True}, "masks": []}
    odd = [None, "", "null", "[]", "3", '"text"', '{"a":null}', '{"a":[1]}', '{"a":{"n":1e400,"x":"nan","t":null,"b":null}}', '{"a":{"n":"1e3","x":"-Infinity","b":{}}}']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "id int, s string")
    got = {r.id: r.v for r in df.select("id", settings.typed(F.col("s"), defaults).alias("v")).collect()}
    assert all(tuple(got[i].a) == (7, 1.5, "d", True) and got[i].masks == "[]" for i in range(9))
    assert tuple(got[9].a) == (1000, 1.5, "d", True)


def test_option_rules(spark):
    rows = [("webp", "none", "adobe_rgb", 16, ["keep", "keep"]), ("tiff", "percent", "adobe_rgb", 16, []), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "image_format string, resize_mode string, color_space string, bit_depth int, grades array<string>")
    got = options.coerced(df).collect()
    assert [tuple(r)[:4] for r in got] == [("webp", "none", "srgb", 8), ("tiff", "percent", "adobe_rgb", 16), ("jpeg", "none", "srgb", 8)]
    assert [[tuple(c) for c in r.changed] for r in got][:2] == [[("color_space", "adobe_rgb", "srgb"), ("bit_depth", "16", "8")], []]
    assert got[0].grades == ["keep", "keep"] and got[1].grades == got[2].grades == ["keep", "review", "reject"]


def test_settings_are_parsed_once_a_row(spark):
    """However many keys and sections are taken from them: what a plan parses, it parses in one place."""
    defaults = {"a": {"n": 0, "x": 0.0, "on": False, "name": "p"}, "geometry": {"left": 0}, "masks": [], "watermark": {"text": ""}}
    stored = spark.createDataFrame([(1, '{"a":{"n":"7.9","x":2},"masks":[1]}'), (2, "{oops"), (3, None)], "id int, s string").repartition(2)
    given = settings.neutral(defaults)
    own = F.when(F.col("id") > 0, settings.typed(F.col("s"), defaults))
    df = stored.select("id", own.alias("own")).select("id", settings.with_preset(F.col("own"), given, defaults).alias("p"), "own")
    most = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", most)
    assert plan.lower().replace("_", "").count("parsejson(") == 1, plan
    got = {r.id: r.own for r in df.collect()}
    assert (got[1].a.n, got[1].a.x, got[1].a.on, got[1].a.name, got[1].masks) == (7, 2.0, False, "p", "[1]")
    assert got[2] == got[3] and got[2].a.n == 0 and got[2].masks == "[]"
