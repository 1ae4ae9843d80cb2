"""Colour gains per camera from samples of its photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def camera_key(make: Column, model: Column) -> Column:
    """Maker and model as one name: the maker once, and an underscore for what a file name cannot hold."""
    a, b = F.trim(F.coalesce(make, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))
    both = F.when(b == "", a).when((a == "") | F.startswith(F.lower(b), F.lower(a)), b).otherwise(F.concat(a, F.lit(" "), b))
    return F.btrim(F.regexp_replace(both, r'[<>:"/\\|?*\s]+', "_"), F.lit("_"))


def valid_gains(calibrations: DataFrame) -> DataFrame:
    """Stored calibrations with three gains between a half and two."""
    return calibrations.where((F.size("gain") == 3) & F.forall("gain", lambda g: (g >= 0.5) & (g <= 2.0)))


def needed(frames: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Frames whose camera has no valid calibration; frames without a camera need none."""
    keyed = frames.where(F.col("camera_key") != "")
    return keyed.join(valid_gains(calibrations).select(F.col("key").alias("camera_key")), "camera_key", "left_anti")


def first_samples(frames: DataFrame, most: int = 12) -> DataFrame:
    """The first frames of every camera in input order."""
    w = Window.partitionBy("camera_key").orderBy("input_order")
    return frames.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def sample_gains(samples: DataFrame) -> DataFrame:
    """samples (camera_b, camera_g, camera_r, ours_b, ours_g, ours_r: channel means) with gain, an array of three.

    Null where a mean is 1 or less, or a gain lies outside a half to two.
    """
    pairs = [(F.col(f"camera_{c}"), F.col(f"ours_{c}")) for c in "bgr"]
    ok = None
    for a, b in pairs:
        one = (a > 1) & (b > 1)
        ok = one if ok is None else ok & one
    gain = F.array(*(F.when(ok, a / b) for a, b in pairs))
    inside = ok & F.forall(gain, lambda g: (g >= 0.5) & (g <= 2.0))
    return samples.withColumn("gain", F.when(inside, gain))


def camera_gains(gains: DataFrame, least: int = 4, neutral: float = 0.02) -> DataFrame:
    """(camera_key, samples, gain_b, gain_g, gain_r): medians over a camera's samples, divided by their geometric mean.

    Cameras with fewer than least samples have none; drifts below neutral make a camera neutral.
    """
    df = gains.where(F.col("gain").isNotNull()).groupBy("camera_key").agg(
        F.count("*").alias("samples"), *(F.median(F.col("gain")[i]).alias(f"m{i}") for i in range(3))
    )
    df = df.where(F.col("samples") >= least)
    mean = F.exp((F.ln("m0") + F.ln("m1") + F.ln("m2")) / 3)
    df = df.withColumn("_mean", mean)
    parts = [F.col(f"m{i}") / F.col("_mean") for i in range(3)]
    drift = F.greatest(*(F.abs(p - 1) for p in parts))
    return df.select(
        "camera_key", "samples", *(F.when(drift < neutral, 1.0).otherwise(p).alias(f"gain_{c}") for p, c in zip(parts, "bgr"))
    )


def first_camera(frames: DataFrame, least: int = 4) -> DataFrame:
    """(camera_key, camera, samples) of the camera that comes first in input order among those with least frames.

    camera is the name on its first frame.  frames needs camera_key, camera_model and input_order.
    """
    cameras = frames.where(F.col("camera_key") != "").groupBy("camera_key").agg(
        F.min_by("camera_model", "input_order").alias("camera"), F.min("input_order").alias("_first"), F.count("*").alias("samples")
    )
    return cameras.where(F.col("samples") >= least).orderBy("_first").limit(1).drop("_first")
