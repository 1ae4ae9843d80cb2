"""Export options: what a file format cannot take is put right by rules, applied in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesieve.operators.export import GRADES

#: Formats with their suffixes, those that carry 16 bits, those that carry a colour profile.
SUFFIXES = {"jpeg": ".jpg", "png": ".png", "webp": ".webp", "tiff": ".tif"}
DEEP = ["png", "tiff"]
PROFILED = ["jpeg", "png", "tiff"]
COLOUR_SPACES = ["srgb", "adobe_rgb"]
RESIZES = ["none", "long_edge", "percent"]
#: The shortest long edge that is made.
LEAST_EDGE = 64

#: (field, the fields it is judged with, values that may stand, what replaces others), in the order of their effect.
RULES = [
    ("image_format", None, list(SUFFIXES), "jpeg"),
    ("resize_mode", None, RESIZES, "none"),
    ("color_space", None, COLOUR_SPACES, "srgb"),
    ("bit_depth", None, [8, 16], 8),
    ("bit_depth", ("image_format", DEEP), [8], 8),
    ("color_space", ("image_format", PROFILED), ["srgb"], "srgb"),
]
FIELDS = ["image_format", "resize_mode", "color_space", "bit_depth"]


def _rule(state: Column, rule) -> Column:
    """The state after one rule: a value stands where it is listed, or where the other field allows all."""
    field, other, listed, replacement = rule
    stands = F.coalesce(state[field].isin(listed), F.lit(False))
    if other:
        stands = stands | F.coalesce(state[other[0]].isin(other[1]), F.lit(False))
    return state.withField(field, F.when(stands, state[field]).otherwise(F.lit(replacement)))


def coerced(options: DataFrame) -> DataFrame:
    """options (image_format, resize_mode, color_space, bit_depth, grades) that go together, and suffix and changed.

    grades (an array) keeps the known ones in the order given; none left means all.  changed lists what was put right, as
    field, what was given and what it became, in the order of the fields; null where nothing was given counts as given.
    """
    given = F.struct(*FIELDS)
    state = F.col("_state")
    df = options.withColumn("_given", given).withColumn("_state", given)
    for rule in RULES:
        df = df.withColumn("_state", _rule(state, rule))
    kept = F.filter(F.coalesce("grades", F.array().cast("array<string>")), lambda g: g.isin(GRADES))
    grades = F.when(F.size(kept) > 0, kept).otherwise(F.array(*map(F.lit, GRADES)))
    said = [
        F.when(
            ~F.col(f"_given.{f}").eqNullSafe(F.col(f"_state.{f}")),
            F.struct(F.lit(f).alias("field"), F.col(f"_given.{f}").cast("string").alias("given"), F.col(f"_state.{f}").cast("string").alias("became")),
        )
        for f in FIELDS
    ]
    df = df.withColumn("changed", F.filter(F.array(*said), lambda x: x.isNotNull())).withColumn("grades", grades)
    for f in FIELDS:
        df = df.withColumn(f, F.col(f"_state.{f}"))
    suffix = reduce(lambda c, kv: c.when(F.col("image_format") == kv[0], kv[1]), SUFFIXES.items(), F.when(F.lit(False), ""))
    return df.withColumn("suffix", suffix).drop("_given", "_state")


def changes(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, field, given, became): one row per option of coerced() that was put right."""
    return found.select(*keys, F.explode("changed").alias("c")).select(*keys, "c.*")


def long_edge(source: Column) -> Column:
    """The long edge of the result, null for the original size; by percent only where the source's edge is known."""
    scaled = F.floor(source * F.col("resize_percent") / 100)
    return (
        F.when(F.col("resize_mode") == "long_edge", F.greatest(F.lit(LEAST_EDGE), F.col("resize_long_edge")))
        .when((F.col("resize_mode") == "percent") & (source > 0), F.greatest(F.lit(LEAST_EDGE), scaled))
        .cast("long")
    )
