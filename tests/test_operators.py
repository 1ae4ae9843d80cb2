"""Edge cases of the photo operators against small plain versions."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesieve import config
from framesieve.config import GroupConfig, ScoreConfig
from framesieve.operators import calibrate, export, faces, grade, images, lenses, places, report, review, scenes, score, store
from framesieve.sources import inventory, metadata

FRAME = (
    "batch_id string, path string, name string, input_order long, error string, capture_time timestamp_ntz, dhash long, "
    "sharpness double, frame_sharpness double, source string, face_count int, face_confidence double, "
    "face_area_ratio double, background_sharpness double, clipped_highlights double, clipped_shadows double, "
    "mean_luma double, eyes_open double, latitude double, longitude double"
)
START = datetime.datetime(2024, 5, 1, 12)


def frame(i, batch="b", t=None, dhash=None, lat=None, lon=None, **more):
    row = dict(
        batch_id=batch, path=f"/{batch}/{i:05d}.ARW", name=f"{i % 7}.ARW", input_order=i, error=None,
        capture_time=None if t is None else START + datetime.timedelta(seconds=t), dhash=dhash, sharpness=50.0,
        frame_sharpness=40.0, source="frame", face_count=0, face_confidence=0.5, face_area_ratio=0.0,
        background_sharpness=0.0, clipped_highlights=0.0, clipped_shadows=0.0, mean_luma=100.0, eyes_open=-1.0,
        latitude=lat, longitude=lon,
    )
    return tuple((row | more).values())


def slow_scenes(rows, c):
    key = lambda r: (r[5] is None, r[5] or START, r[2], r[3])
    out, n, size, anchor, last = {}, -1, 0, None, None
    for r in sorted(rows, key=key):
        gap = (r[5] - last).total_seconds() if r[5] and last else None
        apart = bin((r[6] ^ anchor) & (2**64 - 1)).count("1") if r[6] is not None and anchor is not None else 0
        limit = c.no_time_hash_distance if gap is None else c.scene_change_distance
        if n < 0 or (gap is not None and gap > c.time_gap_seconds) or apart > limit or size >= c.max_group_size:
            n, size, anchor = n + 1, 0, r[6]
        size, last = size + 1, r[5]
        out[r[1]] = n
    return out


def test_scenes_match_the_plain_walk(spark):
    rng, rows = random.Random(4), []
    for b in range(25):
        t = 0.0
        for i in range(rng.randrange(1, 90)):
            t += rng.choice([0.0, 0.2, 3.0, 3.000001, 8.0])
            mark = rng.choice([None, -1, 0, 1 << 62, -(1 << 63), rng.getrandbits(63)])
            rows.append(frame(i, f"b{b}", rng.choice([None, t, t, t]), mark))
    c = GroupConfig(max_group_size=11)
    got = {r.path: r.group_id for r in scenes.with_scenes(spark.createDataFrame(rows, FRAME), c).collect()}
    want = {}
    for b in range(25):
        want |= slow_scenes([r for r in rows if r[0] == f"b{b}"], c)
    assert got == want


def slow_places(rows):
    own = [r for r in rows if r[18] is not None]
    own.sort(key=lambda r: (r[5] is not None, r[5] or START, r[2], r[3]))
    clusters = []
    for r in own:
        if clusters and places._metres(clusters[-1][1], 5.0, r[18], 5.0) <= 250:
            paths, lat = clusters[-1]
            paths.append(r[1])
            clusters[-1] = (paths, lat + (r[18] - lat) / len(paths))
        else:
            clusters.append(([r[1]], r[18]))
    big = [c for c, _ in clusters if len(c) > 1]
    return {r[1]: None for r in rows} | {p: k for k, c in enumerate(big, 1) for p in c}


def test_one_batch_spreads_over_all_tasks(spark):
    """Scenes and places of one large batch: every task holds its share."""
    rng, rows, t, lat = random.Random(8), [], 0.0, 10.0
    for i in range(6000):
        t += rng.choice([0.0, 0.2, 0.2, 2.0, 4.0])
        lat += rng.choice([0, 0.0005, 0.0015, 0.02, -0.02])
        rows.append(frame(i, "b", rng.choice([None, t, t, t]), rng.choice([None, 0, rng.getrandbits(63)]), rng.choice([None, lat]), 5.0))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frames = spark.createDataFrame(rows, FRAME)
        parts = [r["count"] for r in scenes._ranged(frames).groupBy("_part").count().collect()]
        assert len(parts) == 4 and max(parts) < 2500
        got = {r.path: r.group_id for r in scenes.with_scenes(frames).collect()}
        assert got == slow_scenes(rows, GroupConfig())
        by_time = {r.path: r.group_id for r in scenes.scenes_by_time(frames).collect()}
        assert by_time == slow_scenes([(*r[:6], None, *r[7:]) for r in rows], GroupConfig(max_group_size=10**6))
        assert {r.path: r.place_id for r in places.with_places(frames).collect()} == slow_places(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_places_match_the_plain_walk(spark):
    rng, rows = random.Random(9), []
    for b in range(15):
        lat = 10.0
        for i in range(60):
            lat += rng.choice([0, 0.0005, 0.0015, 0.02, -0.02])
            rows.append(frame(i, f"b{b}", rng.choice([None, i]), lat=rng.choice([None, lat, lat]), lon=5.0))
    got = {r.path: r.place_id for r in places.with_places(spark.createDataFrame(rows, FRAME)).collect()}
    for b in range(15):
        want = slow_places([r for r in rows if r[0] == f"b{b}"])
        assert {p: k for p, k in got.items() if p.startswith(f"/b{b}/")} == want


def test_score_is_the_sum_of_its_lines(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        rows.append(
            frame(
                i, error=rng.choice([None, None, None, "x"]), sharpness=rng.uniform(0, 100), source=rng.choice(["eye", "face", "af", "tile", "frame", "odd"]),
                face_count=rng.randrange(3), face_area_ratio=rng.choice([0.0, 0.0002, 0.0003, 0.01, 0.03, 0.4]), background_sharpness=rng.uniform(0, 100),
                clipped_highlights=rng.choice([0.25, 0.254, 0.9]), clipped_shadows=rng.choice([0.5, 0.51, 0.9]), mean_luma=rng.choice([8.0, 247.0, 7.9, 250.0]),
                eyes_open=rng.choice([-1.0, 0.0, 0.25, 0.2]),
            )
        )
    for c in (ScoreConfig(), ScoreConfig(face_priority=False), ScoreConfig(bonus_face_size=8.0)):
        for r in score.scored(spark.createDataFrame(rows, FRAME), c).collect():
            keys = [x.key for x in r.lines]
            assert math.isclose(sum(x.value for x in r.lines), r.score, abs_tol=1e-9) and 0 <= r.score <= 100
            assert keys == ["failed"] if r.error else keys[0] == "sharpness"
            if c.face_priority and not r.error:
                assert sum(k.startswith("eyes_") for k in keys) == 1


def test_grades_of_edge_batches(spark):
    rows = [frame(i, "failed", i, error="x") for i in range(3)] + [frame(0, "one", None)]
    rows += [frame(i, "ties", i * 0.1, face_count=1, source="eye", face_area_ratio=0.2) for i in range(5)]
    df = score.scored(scenes.with_scenes(spark.createDataFrame(rows, FRAME)))
    got = {r.path: r.grade for r in grade.graded(df).collect()}
    assert [got[f"/failed/{i:05d}.ARW"] for i in range(3)] == ["reject"] * 3
    assert got["/one/00000.ARW"] == "keep"
    for ratio in (0.0, 0.5, 1.0):
        c = ScoreConfig(target_keep_ratio=ratio)
        kept = review.summary(grade.graded(df, c)).where("batch_id = 'ties'").first().keep
        assert kept >= 1
    assert grade.graded(df, ScoreConfig(keep_per_group=0, keep_above=101.0)).where("grade = 'keep'").count() == 0
    assert grade.graded(df.limit(0)).collect() == []


def test_config():
    c = config.load({"score": {"keep_above": 70.0, "unknown": 1}, "group": "broken", "other": {}})
    assert c.score.keep_above == 70.0 and c.group == GroupConfig()
    clean = config.sanitise(ScoreConfig(keep_above=float("nan"), target_keep_ratio=float("inf"), reject_percentile=900.0))
    assert (clean.keep_above, clean.target_keep_ratio, clean.reject_percentile) == (65.0, None, 100.0)
    with pytest.raises(TypeError):
        config.sanitise(c)
    base = config.params_key(config.AnalyzeConfig())
    assert len(base) == 16 and base != config.params_key(config.AnalyzeConfig(demosaic_small_preview=True))


def test_inventory_names(spark):
    paths = ["/r/_DSC1.ARW", "/r/_dsc1.JPG", "/r/._x.JPG", "/r/s/_DSC1.JPG", "/r/_keep/a.ARW", "/r/noext", "/r/a.b.heic", "/x/b.ARW"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [(r.input_order, r.path) for r in inventory.inventory(files, "/r/").orderBy("input_order").collect()]
    assert got == [(0, "/r/_DSC1.ARW"), (1, "/r/a.b.heic"), (2, "/r/s/_DSC1.JPG")]
    assert [r.path for r in inventory.inventory(files, "/r", recursive=False).orderBy("path").collect()] == ["/r/_DSC1.ARW", "/r/a.b.heic"]
    pairs = inventory.companions(files.where("path = '/r/_DSC1.ARW'"), files).collect()
    assert [r.companion for r in pairs] == ["/r/_dsc1.JPG"]


def test_image_measures(spark):
    rng = np.random.default_rng(1)
    flat, rough = np.full((120, 160), 128, np.uint8), rng.integers(0, 256, (120, 160)).astype(np.uint8)
    step = np.repeat(np.arange(9, dtype=np.uint8)[::-1] * 20, 16)[None, :].repeat(64, 0)
    assert images.difference_hash(step.astype(float)) == 0 and images.difference_hash(step[:, ::-1].astype(float)) == -1
    assert images.noise(flat.astype(float)) == 0 and images.noise(rough.astype(float)) > 30
    assert images.patch_sharpness(flat.astype(float)) == (0.0, 0.0)
    rows = [("/a", 120, 160, 1, flat.tobytes()), ("/b", 120, 160, 1, rough.tobytes()), ("/bad", 9, 9, 3, b"x")]
    got = {r.path: r for r in images.features(spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary")).collect()}
    assert got["/a"].mean_luma == 128 and got["/a"].error is None and got["/bad"].error and got["/bad"].dhash is None
    assert got["/b"].dhash == images.difference_hash(rough.astype(float))


def test_lens_catalogue_and_variants(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<lensdatabase version="2"><lens><maker>Tamron</maker><model>50-300mm f/4.5-6.3</model><mount>Sony E</mount>'
        '<focal min="50" max="300"/><cropfactor>1.0</cropfactor></lens><lens><maker>X</maker><model>A</model>'
        '<model lang="en">B 35mm</model><mount>M</mount><focal value="35"/><cropfactor>1.5</cropfactor></lens></lensdatabase>'
    )
    found = {r.model: r for r in lenses.read_lenses(spark, f"file://{tmp_path}").collect()}
    assert found["50-300mm f/4.5-6.3"].max_focal == 300 and found["A"].model_en == "B 35mm" and found["A"].min_focal == 35
    shots = spark.createDataFrame([("E 50-300mm F4.5-6.3 A069", 200.0), ("E 50-300mm F4.5-6.3 A069", 900.0), (None, None)], "lens_model string, focal_length double")
    got = sorted((r.reason, r.matched_model) for r in lenses.match_lenses(shots, lenses.read_lenses(spark, f"file://{tmp_path}")).collect())
    assert got == [("focal_differs", None), ("no_name", None), ("ok", "50-300mm f/4.5-6.3")]


def test_small_rules(spark):
    one = spark.range(1)
    text = lambda c: one.select(c.alias("x")).first().x
    assert text(report.fixed(F.lit(2.5), 0)) == "2" and text(report.fixed(F.lit(None).cast("double"), 2)) is None
    assert text(calibrate.camera_key(F.lit("Canon "), F.lit("Canon EOS R6/3"))) == "Canon_EOS_R6_3"
    assert text(metadata.number(F.lit("1/0"))) is None and text(metadata.number(F.lit("1/4"))) == 0.25
    assert export.wanted_grades([]) == ["keep", "review", "reject"] and export.wanted_grades(["reject", "keep"]) == ["keep", "reject"]
    row = spark.createDataFrame([("a:b", "keep", START, 7.5, None)], "stem string, final_grade string, capture_time timestamp_ntz, score double, x string")
    name = lambda p: row.select(export.filename(p, F.lit(3), "20000101000000", F.lit(".ARW")).alias("n")).first().n
    assert name("{name}_{index}_{date}{odd}_{score}") == "a_b_0003_20240501{odd}_8.ARW" and name(" . ") == "a_b.ARW"
    assert store.latest(spark.createDataFrame([("p", 1, 5), ("p", 2, 6)], "path string, written_at int, v int")).first().v == 6


def test_regions_and_means(spark):
    image = np.full((80, 120), 100, np.uint8)
    image[20:40, 40:60] = np.random.default_rng(3).integers(0, 255, (20, 20))
    image[60:80, 108:114] = 130
    colour = np.full((20, 20, 3), 120, np.uint8)
    colour[:, :, 2] = 126
    rows = [("/a", 80, 120, 1, image.tobytes()), ("/c", 20, 20, 3, colour.tobytes()), ("/bad", 5, 5, 3, b"x"), ("/none", 5, 5, 3, None)]
    pictures = spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary")
    tiles = images.tiles(pictures.where("path = '/a'"))
    assert images.best_tile(tiles).first().tile.asDict() == {"x": 40, "y": 20, "w": 20, "h": 20}
    face = spark.createDataFrame([("/a", 45, 25, 5, 5)], "path string, x int, y int, w int, h int")
    assert images.best_tile(tiles, face).first().tile.asDict() == {"x": 100, "y": 60, "w": 20, "h": 20}
    big = pictures.where("path in ('/a', '/bad')").withColumns({"scale": F.lit(0.5), "full_width": F.lit(240), "full_height": F.lit(160)})
    box = lambda faces=None: {r.path: r.box and tuple(r.box) for r in images.tile_boxes(big, faces).collect()}
    assert box() == {"/a": (70, 30, 60, 60), "/bad": (0, 0, 240, 160)}
    assert box(face) == {"/a": (190, 110, 50, 50), "/bad": None}
    whole = spark.createDataFrame([("/a", 0, 0, 120, 80)], "path string, x int, y int, w int, h int")
    assert box(whole) == {"/a": None, "/bad": None}
    # Stripes that alternate from pixel to pixel have no gradient across two pixels.
    assert images.gradient_energy(np.tile([0.0, 9.0], (8, 4))) == 0 < images.gradient_energy(np.tile([0.0, 0.0, 9.0, 9.0], (8, 2)))
    one = spark.range(1).select(faces.area_ratio(F.lit(30), F.lit(20), F.lit(100), F.lit(60)).alias("a"), faces.area_ratio(F.lit(3), F.lit(2), F.lit(0), F.lit(6)).alias("b")).first()
    assert (one.a, one.b) == (0.1, None)
    means = images.channel_means(pictures).collect()
    assert [(r.path, r.mean_b, r.mean_r) for r in means] == [("/c", 120.0, 126.0)]
    box = "struct<x:int,y:int,w:int,h:int>"
    chosen = spark.createDataFrame([((0, 0, 9, 9), None, None, (1, 2, 30, 30))], f"eye {box}, face {box}, af {box}, tile {box}")
    assert chosen.select(images.choose_region().alias("c")).first().c.source == "tile"
    cams = spark.createDataFrame([(2, "A", "x1"), (1, "b", "x2"), (3, "A", "x0")], "position int, maker string, model string")
    assert [r.label for r in lenses.available_cameras(cams, "X", 2).collect()] == ["A x1", "b x2"]
    assert tuple(review.raw_count(spark.createDataFrame([("a.ARW",), ("b.jpg",), ("c",)], "name string")).first()) == (1, 2)


def test_export_names_are_free(spark):
    """A name is held against existing files, other frames' own names and, in a shared root, other batches."""
    rows = [(1, "/a/x.arw", 1, "x"), (1, "/b/x.arw", 2, "x"), (1, "/c/x_1.arw", 3, "x_1"), (1, "/d/y.arw", 4, "y"), (2, "/e/X.arw", 1, "X")]
    frames = spark.createDataFrame(rows, "batch_id long, path string, input_order int, stem string").withColumns(
        {"final_grade": F.lit("keep"), "capture_time": F.lit(None).cast("timestamp"), "score": F.lit(1.0), "suffix": F.lit(".arw")}
    )
    there = frames.select("path").union(spark.createDataFrame([("/out/_keep/y.arw",), ("/out/_keep/Y_1.arw",), ("/other/x.arw",)], "path string"))
    want = {"/a/x.arw": "x", "/b/x.arw": "x_1", "/c/x_1.arw": "x_1_1", "/d/y.arw": "y_2", "/e/X.arw": "X"}
    for shared in (False, True):
        operations, skipped = export.plan(frames, there, "/out", shared_root=shared)
        got = {r.source: r.destination for r in operations.collect()}
        assert got == {k: f"/out/_keep/{v}.arw" for k, v in (want | ({"/e/X.arw": "X_2"} if shared else {})).items()}
        assert skipped.count() == 0


@pytest.mark.parametrize("shared", [True, False])
def test_export_names_match_the_plain_walk(spark, shared):
    """Stems that are others with a number behind, in chains, against names that stand: one after the other by hand."""
    rng = random.Random(12)
    pool = ["x", "X", "x_1", "x_2", "x_1_1", "x_1_2", "X_3", "x_01", "y_2", "y", "z_1_1", "z"]
    rows = [(rng.randrange(3), f"/s/{i}.arw", i, rng.choice(pool)) for i in range(160)]
    frames = spark.createDataFrame(rows, "batch_id int, path string, input_order int, stem string").withColumns(
        {"final_grade": F.lit("keep"), "capture_time": F.lit(None).cast("timestamp"), "score": F.lit(1.0), "suffix": F.lit(".arw")}
    )
    standing = [f"/out/_keep/{x}.ARW" for x in ("x_2", "x_4", "x_5", "X_1_1", "y", "y_1", "z_1_1_1", "x_1_1_2", "z_0")]
    there = frames.select("path").union(spark.createDataFrame([(x,) for x in standing], "path string"))
    operations, _ = export.plan(frames, there, "/out", shared_root=shared)
    got = {r.source: r.destination for r in operations.collect()}
    want, used = {}, {}
    for batch, path, _, stem in sorted(rows, key=lambda r: (r[0], r[2])):
        names = used.setdefault(0 if shared else batch, {x.lower() for x in standing})
        k, name = 0, f"/out/_keep/{stem}.arw"
        while name.lower() in names:
            k += 1
            name = f"/out/_keep/{stem}_{k}.arw"
        names.add(name.lower())
        want[path] = name
    assert got == want


def test_listing_order_keeps_every_row(spark):
    """Ranges that adaptive execution joins in different ways must not lose or repeat rows."""
    from pyspark.sql import functions as F

    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        files = spark.range(200_000).select(
            F.concat(F.lit("/a/b"), (F.col("id") % 97).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit(".ARW")).alias("path"),
            F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"),
        )
        got = inventory.with_order(files, F.split("path", "/"))
        n = got.agg(F.count("*"), F.count_distinct("input_order"), F.min("input_order"), F.max("input_order")).first()
        assert tuple(n) == (200_000, 200_000, 0, 199_999)
        names = [r.path for r in got.where("input_order < 500").orderBy("input_order").collect()]
        assert names == sorted(names, key=lambda x: x.split("/"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)


def test_unknown_grades_are_errors(spark):
    with pytest.raises(ValueError):
        export.wanted_grades(["keep", "best"])
    with pytest.raises(ValueError):
        review.by_grade(spark.createDataFrame([("keep",)], "final_grade string"), "best")
    assert export.wanted_grades(["reject", "keep"]) == ["keep", "reject"] and export.wanted_grades([]) == export.GRADES


def test_listing_order_is_by_path_parts_whatever_they_hold(spark):
    paths = ["/r/a/b.jpg", "/r/a b/c.jpg", "/r/a-b/c.jpg", "/r/a\x01/c.jpg", "/r/a\x00/c.jpg", "/r/a\x01\x01/d.jpg", "/r/a.b/c.jpg", "/r/ä/c.jpg"]
    files = spark.createDataFrame([(p,) for p in reversed(paths)], "path string").repartition(3)
    df = inventory.inventory(files, "/r")
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString().replace("Window [sum", "")
    got = [r.path for r in df.orderBy("input_order").collect()]
    assert got == sorted(paths, key=lambda p: [x.encode() for x in p.split("/")])


def test_a_place_and_grade_has_one_file(spark, tmp_path):
    rows = spark.range(4000).selectExpr("cast(id as string) as path", "concat('p', id % 20) as place_label", "'keep' as grade").repartition(8)
    report.write_by_grade(rows, str(tmp_path / "out"))
    found = [len(list(d.glob("*.parquet"))) for d in (tmp_path / "out").glob("place_label=*/grade=*")]
    assert len(found) == 20 and max(found) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4000


def test_skipped_and_counts_need_no_names(spark, tmp_path, monkeypatch):
    frames = spark.createDataFrame([("b", f"/s/{i}", i, "keep", 50.0, "x", ".jpg") for i in range(6)], "batch_id string, path string, input_order long, final_grade string, score double, stem string, suffix string")
    frames = frames.withColumn("capture_time", F.lit(None).cast("timestamp_ntz"))
    there = frames.where("input_order <> 2").select("path")
    operations, skipped = export.plan(frames, there, "/out")
    monkeypatch.setattr(export, "_free_names", None)
    rows, missing = export.chosen(frames, there, "/out")
    assert missing.collect() == skipped.collect() and missing.count() == 1
    assert export.plan_counts(rows).collect() == export.plan_counts(operations).collect()


def test_graded_frames_are_ranked_once(spark):
    base = spark.range(40).selectExpr("'b' as batch_id", "cast(id / 4 as int) as group_id", "cast(id as double) as score", "cast(id as string) as name", "id as input_order", "cast(null as string) as error", "1.0D as sharpness", "1 as face_count")
    plan = grade.graded(base)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
