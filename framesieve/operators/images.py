"""Measurements of decoded pictures: one row in, one feature row out, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesieve.operators.faces import clip_box

FEATURES = (
    "path string, error string, mean_luma double, clipped_highlights double, clipped_shadows double, dhash long, "
    "noise double, laplacian double, tenengrad double, sharpness double"
)


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of a BGR picture, or the picture itself where it has one channel."""
    p = pixels.astype(np.float64)
    return p if p.ndim == 2 else p[..., 0] * 0.114 + p[..., 1] * 0.587 + p[..., 2] * 0.299


def area_resize(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean of the source area behind each target pixel."""

    def weights(source, target):
        edges = np.arange(target + 1) * source / target
        low, high = edges[:-1, None], edges[1:, None]
        at = np.arange(source)[None, :]
        return np.clip(np.minimum(at + 1, high) - np.maximum(at, low), 0, None) * target / source

    return weights(image.shape[0], rows) @ image @ weights(image.shape[1], cols).T


def difference_hash(image: np.ndarray) -> int:
    """64 bits, highest first: whether each pixel of an 8 by 9 reduction is darker than its right neighbour."""
    small = np.rint(area_resize(image, 8, 9))
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def noise(image: np.ndarray, tile: int = 96, grid: int = 5) -> float:
    """Median noise over tiles, from a mask that lines and edges cancel in."""
    p = np.pad(image, 1, mode="reflect")
    rows = p[:-2] - 2 * p[1:-1] + p[2:]
    mask = rows[:, :-2] - 2 * rows[:, 1:-1] + rows[:, 2:]
    h, w = image.shape
    found = []
    for y in np.linspace(0, max(0, h - tile), grid).astype(int):
        for x in np.linspace(0, max(0, w - tile), grid).astype(int):
            part = mask[y : y + tile, x : x + tile]
            found.append(1.4826 * np.median(np.abs(part)) / 6)
    return float(np.median(found))


def patch_sharpness(patch: np.ndarray, sigma: float = 0.0) -> tuple[float, float]:
    """Shares of the patch's variance that its Laplacian and its gradient hold, the noise's part taken off."""
    p = np.pad(patch, 1, mode="reflect")
    var = patch.var() - sigma**2
    if var < 25:
        return 0.0, 0.0
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * patch
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    a = max(0.0, lap.var() - 20 * sigma**2) / var
    b = max(0.0, (gx**2 + gy**2).mean() - 24 * sigma**2) / var
    return float(a), float(b)


def saturate(value: float, k: float) -> float:
    return 100 * value / (value + k) if value > 0 else 0.0


def measure(pixels: np.ndarray, tile: int = 96) -> dict:
    image = gray(pixels)
    sigma = noise(image, tile)
    lap, ten = patch_sharpness(image, sigma)
    lap, ten = saturate(lap, 0.053), saturate(ten, 1.63)
    return {
        "mean_luma": float(image.mean()),
        "clipped_highlights": float((image >= 250).mean()),
        "clipped_shadows": float((image <= 5).mean()),
        "dhash": difference_hash(image),
        "noise": sigma,
        "laplacian": lap,
        "tenengrad": ten,
        "sharpness": 0.4 * lap + 0.6 * ten,
    }


def _measure_all(tile: int):
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(frames):
        for frame in frames:
            out = []
            for path, height, width, channels, data in frame.itertuples(index=False):
                try:
                    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).squeeze()
                    out.append({"path": path, "error": None, **measure(pixels, tile)})
                except Exception as failed:  # one bad picture is a row with an error, not a failed job
                    out.append({"path": path, "error": f"{type(failed).__name__}: {failed}"})
            rows = pd.DataFrame(out, columns=names)
            # From whole numbers: beside a missing hash pandas would turn all others into doubles.
            rows["dhash"] = pd.array([x.get("dhash") for x in out], dtype="Int64")
            yield rows

    return run


def features(images: DataFrame, tile: int = 96) -> DataFrame:
    """images (path, height, width, channels, data: BGR or gray bytes) measured; errors become text.

    tile is the side of the squares over which noise is taken.
    """
    return images.select("path", "height", "width", "channels", "data").mapInPandas(_measure_all(tile), FEATURES)


# -- histograms --------------------------------------------------------------------------------------------------------


def histogram(levels: DataFrame) -> DataFrame:
    """(frame_id, channel, level, n, height): counts of levels 0 to 255 and their log height against the fullest."""
    counts = levels.groupBy("frame_id", "channel", "level").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy("frame_id", "channel"))
    return counts.withColumn("height", F.log1p("n") / F.log1p(most))


def exposure(counts: DataFrame) -> DataFrame:
    """(frame_id, mean_luma, clipped_highlights, clipped_shadows) of the luma rows of a histogram."""
    n, level = F.col("n"), F.col("level")
    total = F.sum(n)
    return counts.where("channel = 'luma'").groupBy("frame_id").agg(
        (F.sum(level * n) / total).alias("mean_luma"),
        (F.sum(F.when(level >= 250, n).otherwise(0)) / total).alias("clipped_highlights"),
        (F.sum(F.when(level <= 5, n).otherwise(0)) / total).alias("clipped_shadows"),
    )


def tone_quantiles(counts: DataFrame, steps: int = 16) -> DataFrame:
    """(frame_id, q): levels at even shares from 2 to 98 percent, weighted by counts, never falling."""
    shares = [0.02 + 0.96 * i / (steps - 1) for i in range(steps)]
    q = F.expr(f"percentile(level, array({', '.join(f'{s!r}D' for s in shares)}), n)")
    return counts.where("channel = 'luma'").groupBy("frame_id").agg(q.alias("q"))


def interpolated(x: Column, xs: Column, ys: Column) -> Column:
    """The value at x of the line through (xs, ys); xs ascends, of equal ones the last counts, outside the ends hold."""
    at = F.size(F.filter(xs, lambda v: v <= x))
    left, right = F.get(xs, at - 1), F.get(xs, at)
    low, high = F.get(ys, at - 1), F.get(ys, at)
    return (
        F.when(at == 0, F.get(ys, F.lit(0)))
        .when(at == F.size(xs), low)
        .otherwise(low + (x - left) * (high - low) / (right - left))
    )


def tone_table(render: DataFrame, target: DataFrame, steps: int = 16) -> DataFrame:
    """(frame_id, tone): 256 levels that lead each frame's luma to its target's.

    render and target are histograms (frame_id, channel, level, n).  Equal shares of both are paired, held by (0, 0) and
    (255, 255), and made to never fall; between them the table is linear.  Quantiles are settled at nine places.  Frames
    that one of the tables lacks get none.
    """

    def curve(q: str) -> Column:
        ends = F.concat(F.array(F.lit(0.0)), F.transform(q, lambda v: F.round(v, 9)), F.array(F.lit(255.0)))
        return F.transform(ends, lambda v, i: F.array_max(F.slice(ends, 1, i + 1)))

    both = tone_quantiles(render, steps).select("frame_id", curve("q").alias("src"))
    both = both.join(tone_quantiles(target, steps).select("frame_id", curve("q").alias("dst")), "frame_id")
    levels = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: i.cast("double"))
    return both.select("frame_id", F.transform(levels, lambda x: interpolated(x, F.col("src"), F.col("dst"))).alias("tone"))


def look_errors(pixels: DataFrame, tones: DataFrame) -> DataFrame:
    """(frame_id, luma_before, luma_error, chroma_error): mean absolute differences before and after the tone table.

    pixels (frame_id, luma, cb, cr, target_luma, target_cb, target_cr) has integer luma levels; the chroma error is the mean
    over both chroma channels, which a tone table leaves alone.
    """
    means = pixels.join(tones, "frame_id").select(
        "frame_id",
        F.abs(F.col("luma") - F.col("target_luma")).cast("double").alias("before"),
        F.abs(F.get("tone", F.col("luma")) - F.col("target_luma")).alias("after"),
        ((F.abs(F.col("cb") - F.col("target_cb")) + F.abs(F.col("cr") - F.col("target_cr"))) / 2).alias("chroma"),
    )
    return means.groupBy("frame_id").agg(
        F.avg("before").alias("luma_before"), F.avg("after").alias("luma_error"), F.avg("chroma").alias("chroma_error")
    )


# -- regions -----------------------------------------------------------------------------------------------------------

#: Fixed value: tiles with fewer pixels on a side are none.
LEAST_TILE = 8
TILES = "path string, row int, col int, x int, y int, w int, h int, energy double"


def gradient_energy(patch: np.ndarray) -> float:
    """Mean square of the patch's own gradient, not measured against its variance: tiles of one picture share their light."""
    p = np.pad(patch, 1, mode="reflect")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return float((gx**2 + gy**2).mean())


def _tiles_of(frames):
    names = [x.split()[0] for x in TILES.split(", ")]
    for frame in frames:
        out = []
        for path, height, width, channels, data in frame.itertuples(index=False):
            down, across = height // 4, width // 6
            if data is None or len(data) != height * width * channels or min(down, across) < LEAST_TILE:
                continue
            image = gray(np.frombuffer(data, np.uint8).reshape(height, width, channels).squeeze())
            for r in range(4):
                for c in range(6):
                    y, x = r * down, c * across
                    out.append((path, r, c, x, y, across, down, gradient_energy(image[y : y + down, x : x + across])))
        yield pd.DataFrame(out, columns=names)


def tiles(images: DataFrame) -> DataFrame:
    """The 6 by 4 equal tiles of every picture with their gradient energy, what is left at the far edges in none.

    Pictures of a wrong size have none, nor have those with tiles below 8 pixels.
    """
    return images.select("path", "height", "width", "channels", "data").mapInPandas(_tiles_of, TILES)


def widened(rows: DataFrame) -> DataFrame:
    """rows with box: their tile by half its size around its centre, in the full picture and cut at its borders.

    rows needs tile (struct x, y, w, h in the reduced picture), scale (reduced over full), full_width and full_height.
    """
    t, scale = F.col("tile"), F.col("scale")
    x, y = (t["x"] - t["w"] * 0.25) / scale, (t["y"] - t["h"] * 0.25) / scale
    wide = F.struct(x.alias("x"), y.alias("y"), (t["w"] * 1.5 / scale).alias("w"), (t["h"] * 1.5 / scale).alias("h"))
    return rows.withColumn("_wide", wide).withColumn("box", clip_box("_wide", "full_width", "full_height")).drop("_wide")


def tile_boxes(images: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """(path, box): where the most detail of every picture is, as a box of the full picture.

    Without faces a picture whose tiles are too small is its own box; with faces (path, x, y, w, h in the reduced picture)
    the box is the background's, and null where no tile is free of them.  images needs scale, full_width and full_height.
    """
    found = best_tile(tiles(images), faces).select("path", "tile")
    rows = images.select("path", "scale", "full_width", "full_height").join(found, "path", "left")
    boxes = widened(rows)
    whole = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("full_width").alias("w"), F.col("full_height").alias("h"))
    box = F.when(F.col("tile").isNotNull(), F.col("box"))
    return boxes.select("path", (F.coalesce(box, whole) if faces is None else box).alias("box"))


def best_tile(tile_rows: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """(path, tile, energy): the tile of most energy, the first in reading order of equals.

    With faces (path, x, y, w, h), tiles that overlap one are left out: what is left is the background.
    """
    rows = tile_rows
    if faces is not None:
        f = faces.select(F.col("path").alias("_p"), *(F.col(c).alias(f"_{c}") for c in "xywh"))
        meet = (
            (F.col("path") == F.col("_p"))
            & (F.col("x") < F.col("_x") + F.col("_w")) & (F.col("_x") < F.col("x") + F.col("w"))
            & (F.col("y") < F.col("_y") + F.col("_h")) & (F.col("_y") < F.col("y") + F.col("h"))
        )
        rows = rows.join(f, meet, "left_anti")
    order = F.struct(-F.col("energy"), "row", "col")
    return rows.groupBy("path").agg(F.min_by(F.struct("x", "y", "w", "h"), order).alias("tile"), F.max("energy").alias("energy"))


def choose_region(least: int = 24, use_af: bool = False):
    """(source, roi) of eye, face, af, tile (structs x, y, w, h or null) and the whole frame: the first large enough."""
    names = ["eye", "face", *(["af"] if use_af else []), "tile"]
    source = None
    for n in names:
        big = (F.col(n)["w"] >= least) & (F.col(n)["h"] >= least)
        source = F.when(big, n) if source is None else source.when(big, n)
    source = source.otherwise("frame")
    roi = None
    for n in names:
        roi = F.when(source == n, F.col(n)) if roi is None else roi.when(source == n, F.col(n))
    return F.struct(source.alias("source"), roi.alias("roi"))


MEANS = "path string, mean_b double, mean_g double, mean_r double, pixels long"


def _means_of(frames):
    names = [x.split()[0] for x in MEANS.split(", ")]
    for frame in frames:
        out = []
        for path, height, width, channels, data in frame.itertuples(index=False):
            if data is None or channels != 3 or len(data) != height * width * 3:
                continue
            p = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.float64)
            low, high = p.min(axis=1), p.max(axis=1)
            usable = (low > 16) & (high < 240)
            neutral = usable & (high - low <= 0.1 * high)
            chosen = neutral if neutral.sum() >= 100 else usable
            b, g, r = p[chosen].mean(axis=0) if chosen.any() else (0.0, 0.0, 0.0)
            out.append((path, b, g, r, int(chosen.sum())))
        yield pd.DataFrame(out, columns=names)


def channel_means(images: DataFrame) -> DataFrame:
    """Channel means of the neutral pixels of every colour picture, or of all usable ones where those are few."""
    return images.select("path", "height", "width", "channels", "data").mapInPandas(_means_of, MEANS)
