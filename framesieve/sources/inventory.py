"""The inventory of photo files: what a manifest lists, without hidden files, output folders and twins of raw files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The suffixes of each kind of file, and the folders that hold output.
RAW = [
    "arw", "srf", "sr2", "cr2", "cr3", "crw", "nef", "nrw", "raf", "orf", "rw2", "pef", "ptx", "dng", "srw", "3fr", "fff",
    "iiq", "mrw", "rwl", "x3f", "dcr", "kdc", "erf", "mef", "bay", "raw",
]
JPEG = ["jpg", "jpeg"]
HEIF = ["hif", "heic", "heif"]
SMALL_PREVIEW = ["rw2"]
COMPANIONS = ["jpg", "jpeg", "hif", "heif", "heic", "xmp"]
OUTPUT_FOLDERS = ["_keep", "_review", "_reject"]


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.+\.([^./]+)$", 1))


def kind(name: Column) -> Column:
    """raw, jpeg, heif, or null for what is no photo."""
    s = suffix(name)
    return F.when(s.isin(RAW), "raw").when(s.isin(JPEG), "jpeg").when(s.isin(HEIF), "heif")


def with_names(files: DataFrame) -> DataFrame:
    """files (path, ...) with parent, name, stem and kind."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns(
        {
            "name": name,
            "parent": F.regexp_replace("path", r"/[^/]*$", ""),
            "stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""),
            "kind": kind(name),
            "small_preview": suffix(name).isin(SMALL_PREVIEW),
        }
    )


def inventory(files: DataFrame, root: str, recursive: bool = True, output_folders: list[str] | None = None) -> DataFrame:
    """The photos below root in path order (by parts), numbered by input_order.

    Left out: hidden names, files in an output folder below root, and compressed pictures that have a raw twin (same
    folder and stem, whatever the case).
    """
    base = root.rstrip("/") + "/"
    df = with_names(files).where(F.col("kind").isNotNull() & F.startswith("path", F.lit(base)))
    df = df.where(~F.startswith("name", F.lit(".")))
    below = F.split(F.substring(F.col("parent"), F.lit(len(base) + 1), F.length("parent")), "/")
    skip = F.array(*(F.lit(x) for x in (output_folders or OUTPUT_FOLDERS)))
    df = df.where(~F.arrays_overlap(below, skip))
    if not recursive:
        df = df.where(F.col("parent") == base[:-1])
    df = without_twins(df)
    # The order of a listing is by path parts; row numbers within ranges avoid one task for all files.
    return with_order(df, _by_parts("path"))


def _by_parts(path: str) -> Column:
    """A text that sorts as the parts of path do: what ends a part comes before all that can stand in one."""
    text = F.col(path)
    for old, new in (("\x01", "\x01\x02"), ("\x00", "\x01\x01"), ("/", "\x00")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def without_twins(photos: DataFrame) -> DataFrame:
    """photos without the compressed ones that have a raw file of the same folder and stem."""
    keyed = photos.withColumn("_stem", F.lower("stem"))
    raws = keyed.where("kind = 'raw'")
    twins = raws.select("parent", "_stem").distinct()
    others = keyed.where("kind <> 'raw'").join(twins, ["parent", "_stem"], "left_anti")
    return raws.unionByName(others.select(raws.columns)).drop("_stem")


def with_order(df: DataFrame, key: Column) -> DataFrame:
    """df with input_order from 0 in the order of key.

    Rows are dealt by ranges of key, sorted and numbered inside them; a range's first number is the sum of what lies before
    it.  df is stored first, since ranges are found by a look at all rows before they are dealt.
    """
    from pyspark.sql import Window

    from framesieve.operators.ordered import RANGE_BITS, in_ranges

    from .shared import stored

    ranged = in_ranges(stored(df, "unordered"), [key], "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.col("_seq").bitwiseAND(F.lit((1 << RANGE_BITS) - 1).cast("long"))
    return ranged.join(F.broadcast(starts), "_part").withColumn("input_order", F.col("_start") + own).drop("_seq", "_part", "_start")


def companions(photos: DataFrame, files: DataFrame) -> DataFrame:
    """(path, companion): files that go with a photo: its sidecar name.xmp, or its stem with a companion's suffix."""
    side = with_names(files).withColumn("_suffix", suffix(F.col("name")))
    side = side.select("parent", F.col("path").alias("companion"), F.lower("name").alias("_name"), F.lower("stem").alias("_stem"), "_suffix")
    left = with_names(photos.select("path")).select("path", "parent", F.lower("stem").alias("_stem"), F.concat(F.lower("name"), F.lit(".xmp")).alias("_name"))
    by_name = left.join(side.select("parent", "_name", "companion"), ["parent", "_name"]).select("path", "companion")
    same_stem = side.where(F.col("_suffix").isin(COMPANIONS)).select("parent", "_stem", "companion")
    by_stem = left.join(same_stem, ["parent", "_stem"]).select("path", "companion")
    return by_name.union(by_stem).where("path <> companion").distinct()
