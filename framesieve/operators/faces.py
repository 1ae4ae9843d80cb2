"""Choices among the faces of a frame, as columns over arrays or ranks over exploded faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_faces(faces: DataFrame, most: int = 8) -> DataFrame:
    """The most prominent faces of every frame by area times confidence; index order settles ties."""
    w = Window.partitionBy("frame_id").orderBy(F.desc(F.col("w") * F.col("h") * F.col("score")), "idx")
    return faces.withColumn("prominence", F.row_number().over(w)).where(F.col("prominence") <= most)


def main_face(faces: DataFrame, sure: float = 0.75, contrast: float = 8.0, near_best: float = 0.85, most: int = 8) -> DataFrame:
    """(frame_id, main_face): of the sure faces, else all, those with contrast, else all; of the most prominent of them
    those nearly as sharp as the sharpest; of these the one with the largest area times confidence.

    faces needs frame_id, idx, w, h, score, contrast and energy (its sharpness before the root).
    """
    frame = Window.partitionBy("frame_id")
    pool = faces
    for wanted in (F.col("score") >= sure, F.col("contrast") >= contrast):
        any_ = F.max(wanted.cast("int")).over(frame)
        pool = pool.withColumn("_any", any_).where((F.col("_any") == 0) | wanted).drop("_any")
    pool = top_faces(pool, most)
    sharp = F.sqrt("energy")
    pool = pool.withColumn("_best", F.max(sharp).over(frame)).where(sharp >= near_best * F.col("_best"))
    return pool.groupBy("frame_id").agg(F.min_by("idx", F.struct(-(F.col("w") * F.col("h") * F.col("score")), "idx")).alias("main_face"))


def central_face(faces: DataFrame, width: float, height: float) -> DataFrame:
    """(frame_id, main_face) by a quarter of area, all of centrality and a quarter of sharpness, each against the best."""
    frame = Window.partitionBy("frame_id")
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    off = F.sqrt(F.pow((cx - width / 2) / (width / 2), F.lit(2)) + F.pow((cy - height / 2) / (height / 2), F.lit(2)))
    share = lambda c: F.coalesce(F.try_divide(c, F.max(c).over(frame)), F.lit(0.0))
    mark = 0.25 * share(F.sqrt(F.col("w") * F.col("h"))) + F.greatest(F.lit(0.0), F.lit(1.0) - off) + 0.25 * share(F.sqrt("energy"))
    ranked = faces.withColumn("_mark", F.round(mark, 9))
    return ranked.groupBy("frame_id").agg(F.min_by("idx", F.struct(-F.col("_mark"), "idx")).alias("main_face"))


def nearest_face(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(frame_id, af_face): the face whose centre is nearest the frame's point (x, y); the first of equals."""
    p = points.select("frame_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    df = faces.join(p, "frame_id")
    dx, dy = F.col("x") + F.col("w") / 2 - F.col("_x"), F.col("y") + F.col("h") / 2 - F.col("_y")
    return df.groupBy("frame_id").agg(F.min_by("idx", F.struct(dx * dx + dy * dy, "idx")).alias("af_face"))


def area_ratio(w: Column, h: Column, width: Column, height: Column) -> Column:
    """The share of a picture that a box covers, both in the same pixels; null where the picture has no size."""
    return F.when((width > 0) & (height > 0), w.cast("double") * h / (width.cast("double") * height))


def main_face_ratios(faces: DataFrame, sizes: DataFrame) -> DataFrame:
    """(frame_id, main_face, face_area_ratio): the main face and its share of the frame's picture (frame_id, width, height)."""
    chosen = main_face(faces).select("frame_id", F.col("main_face").alias("idx"))
    rows = faces.select("frame_id", "idx", "w", "h").join(chosen, ["frame_id", "idx"]).join(sizes.select("frame_id", "width", "height"), "frame_id")
    ratio = area_ratio(F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    return rows.select("frame_id", F.col("idx").alias("main_face"), ratio.alias("face_area_ratio"))


def overlap(a: str, b: str) -> Column:
    """Whether two boxes (structs x, y, w, h) share area."""
    p, q = F.col(a), F.col(b)
    return (p["x"] < q["x"] + q["w"]) & (q["x"] < p["x"] + p["w"]) & (p["y"] < q["y"] + q["h"]) & (q["y"] < p["y"] + p["h"])


def eye_ratio(points: DataFrame, least_width: float = 12.0, mean: bool = False) -> DataFrame:
    """(frame_id, face_idx, ear): height over width of the wider-open eye, or of both eyes on average; -1 where no eye is
    least_width wide.

    points: eye, and the eye's six points p0..p5 as structs x, y: corner, two above, corner, two below.
    """
    d = lambda a, b: F.sqrt(F.pow(F.col(a)["x"] - F.col(b)["x"], F.lit(2)) + F.pow(F.col(a)["y"] - F.col(b)["y"], F.lit(2)))
    width = d("p0", "p3")
    ear = F.when(width >= least_width, (d("p1", "p5") + d("p2", "p4")) / (2 * width))
    return points.groupBy("frame_id", "face_idx").agg(F.coalesce(F.avg(ear) if mean else F.max(ear), F.lit(-1.0)).alias("ear"))


def rotate_box(box: str, orientation: str, width: str, height: str) -> Column:
    """A box of the sensor's frame in the upright picture, for orientations 1, 3, 6 and 8."""
    b, o, w, h = F.col(box), F.col(orientation), F.col(width), F.col(height)
    make = lambda x, y, p, q: F.struct(x.alias("x"), y.alias("y"), p.alias("w"), q.alias("h"))
    return (
        F.when(o == 3, make(w - b["x"] - b["w"], h - b["y"] - b["h"], b["w"], b["h"]))
        .when(o == 6, make(h - b["y"] - b["h"], b["x"], b["h"], b["w"]))
        .when(o == 8, make(b["y"], w - b["x"] - b["w"], b["h"], b["w"]))
        .otherwise(make(b["x"], b["y"], b["w"], b["h"]))
    )


def main_face_box(faces: str, index: str, width: str, height: str) -> Column:
    """The main face's box as shares of the picture; null where the index or the size is none."""
    f = F.get(F.col(faces), F.when(F.col(index) >= 0, F.col(index)))
    ok = f.isNotNull() & (F.col(width) > 0) & (F.col(height) > 0)
    return F.when(ok, F.struct((f["x"] / F.col(width)).alias("x"), (f["y"] / F.col(height)).alias("y"), (f["w"] / F.col(width)).alias("w"), (f["h"] / F.col(height)).alias("h")))


def _whole(value: Column) -> Column:
    return F.bround(value, 0).cast("int")


def scale_box(box: str, base: tuple[str, str], preview: tuple[str, str]) -> Column:
    """A box around a centre (struct x, y, w, h in the base picture) in the preview, at least a pixel and never outside.

    Null where the base picture has no size.
    """
    b, (width, height), (most_x, most_y) = F.col(box), map(F.col, base), map(F.col, preview)
    across, down = most_x / width, most_y / height
    x = F.greatest(F.lit(0), F.least(most_x - 1, _whole((b["x"] - b["w"] / 2) * across)))
    y = F.greatest(F.lit(0), F.least(most_y - 1, _whole((b["y"] - b["h"] / 2) * down)))
    w = F.greatest(F.lit(1), F.least(most_x - x, _whole(b["w"] * across)))
    h = F.greatest(F.lit(1), F.least(most_y - y, _whole(b["h"] * down)))
    return F.when((width > 0) & (height > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def clip_box(box: str, width: str, height: str) -> Column:
    """A box cut at the borders of the picture, its corners rounded half to even."""
    b = F.col(box)
    left, top = F.greatest(F.lit(0), _whole(b["x"])), F.greatest(F.lit(0), _whole(b["y"]))
    right, bottom = F.least(F.col(width), _whole(b["x"] + b["w"])), F.least(F.col(height), _whole(b["y"] + b["h"]))
    w, h = F.greatest(F.lit(0), right - left), F.greatest(F.lit(0), bottom - top)
    return F.struct(left.alias("x"), top.alias("y"), w.alias("w"), h.alias("h"))
