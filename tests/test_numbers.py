"""Rounding, captions and labels against Python's own formatting."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from framesieve.operators import numbers, places, report


def test_rounding_on_the_exact_double(spark):
    rng = random.Random(3)
    ties = [k / 8 for k in range(-40, 40)] + [k / 1000 for k in range(-3000, 3000, 5)] + [2.675, 1.005, 1e13 + 0.125]
    values = ties + [rng.uniform(-1e6, 1e6) for _ in range(500)] + [-0.0, -0.001, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", *(numbers.fixed(F.col("x"), d).alias(f"t{d}") for d in (0, 1, 2, 4)), numbers.rounded(F.col("x"), 2).alias("r")).collect()
    for r in got:
        for d in (0, 1, 2, 4):
            assert r[f"t{d}"] == f"{r.x:.{d}f}", (r.x, d)
        assert r.r == round(r.x, 2)
    odd = spark.createDataFrame([(None,), (float("nan"),), (1e300,)], "x double").select(numbers.fixed(F.col("x"), 2).alias("t")).collect()
    assert odd[0].t is None and odd[1].t == "NaN" and float(odd[2].t) == 1e300


def test_labels_of_means(spark):
    rows = [("b", f"/{i}", 1, lat, -70.00005) for i, lat in enumerate((-1.00005, -1.00015, -1.0002))]
    df = spark.createDataFrame(rows, "batch_id string, path string, place_id int, latitude double, longitude double")
    mean = round(sum(round(r[3] * 1e9) for r in rows) / 1e9, 9) / 3
    assert places.places(df).first().label == f"01_{abs(mean):.4f}S_{70.00005:.4f}W"


def test_short_numbers(spark):
    rng = random.Random(5)
    values = [24.0, 2.8, 0.0125, 10.0, 100.0, 123456.0, 70.123456, 99.99995, 999999.4, 1e-4, 35.0000001] + [rng.uniform(0.001, 9999) for _ in range(200)]
    for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", numbers.short(F.col("x")).alias("t")).collect():
        assert r.t == f"{r.x:g}"


def test_captions(spark):
    rows = [
        ("a.arw", "R5", "RF50", 50.0, 2.8, 0.004, 200, datetime.datetime(2024, 5, 6, 7, 8, 9)),
        ("b.arw", None, None, None, None, None, None, None),
        ("c.arw", "R5", "", 0.0, None, None, 0, None),
    ]
    df = spark.createDataFrame(rows, "name string, camera_model string, lens_model string, focal_length double, aperture double, shutter_speed double, iso int, capture_time timestamp")
    left = lambda **k: [r.x for r in df.orderBy("name").select(report.caption(**k)["left"].alias("x")).collect()]
    assert left() == ["a.arw  ·  R5  ·  RF50  ·  50mm  ·  f/2.8  ·  1/250s  ·  ISO 200  ·  2024-05-06 07:08", "b.arw", "c.arw  ·  R5"]
    assert left(include=["iso", "camera"]) == ["R5  ·  ISO 200", "b.arw", "R5"]
    assert left(include=[]) == ["", "b.arw", ""]
    assert left(include=["iso"], known=F.lit(True)) == ["ISO 200", "", ""]
    assert df.select(report.caption(custom="me")["right"].alias("x")).first().x == "me"
    with pytest.raises(ValueError):
        report.caption(include=["weight"])
