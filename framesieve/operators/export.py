"""Plans of exports, their logs and their undoing.  Nothing here moves a file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesieve.operators.ordered import in_ranges, sums_before
from framesieve.sources.shared import stored

GRADES = ["keep", "review", "reject"]
#: The folder of frames without a place, and the name of frames whose name has no usable character.
NO_PLACE, NO_NAME = "_위치없음", "이름없음"
_ILLEGAL = r'[<>:"/\\|?*]'


def wanted_grades(grades) -> list[str]:
    """The grades of a selection in their order; all of them where it is empty.  An unknown grade is an error."""
    unknown = set(grades or []) - set(GRADES)
    if unknown:
        raise ValueError(f"unknown grades: {', '.join(sorted(unknown))}")
    found = [g for g in GRADES if g in (grades or [])]
    return found or list(GRADES)


def filename(pattern: str, index: Column, run_time: str, suffix: Column) -> Column:
    """A name by pattern: {name} {index} {grade} {date} {time} {score}; what is unknown stays.

    Frames without a capture time take run_time (yyyyMMddHHmmss), one value per run.
    """
    when = F.coalesce(F.date_format("capture_time", "yyyyMMddHHmmss"), F.lit(run_time))
    values = {
        "name": F.col("stem"),
        "index": F.lpad(index.cast("string"), 4, "0"),
        "grade": F.col("final_grade"),
        "date": F.substring(when, 1, 8),
        "time": F.substring(when, 9, 6),
        "score": F.format_string("%.0f", F.bround("score", 0)),
    }
    parts, at = [], 0
    for m in re.finditer(r"\{(" + "|".join(values) + r")\}", pattern):
        parts += [F.lit(pattern[at : m.start()]), values[m[1]]]
        at = m.end()
    raw = F.concat(*parts, F.lit(pattern[at:]))
    clean = lambda c: F.btrim(F.regexp_replace(c, _ILLEGAL, "_"), F.lit(" ."))
    name = F.coalesce(F.nullif(clean(raw), F.lit("")), F.nullif(clean(F.col("stem")), F.lit("")), F.lit(NO_NAME))
    return F.concat(name, suffix)


def numbered(frames: DataFrame, grades=None) -> DataFrame:
    """frames of the wanted grades with index from 1 in input order."""
    w = Window.partitionBy("batch_id").orderBy("input_order")
    chosen = frames.where(F.col("final_grade").isin(wanted_grades(grades)))
    return chosen.withColumn("index", F.row_number().over(w))


def plan(frames: DataFrame, existing: DataFrame, root: str, pattern: str = "{name}", grades=None, places: DataFrame | None = None, by_grade: bool = True, run_time: str = "20000101000000", shared_root: bool = False) -> tuple[DataFrame, DataFrame]:
    """(operations, skipped) of an export.

    frames needs batch_id, path, input_order, final_grade, capture_time, score, stem and suffix (with its dot); existing
    lists the paths that exist; places (batch_id, place_id, label) makes place folders.  Missing sources are skipped but
    keep their number.  A name that stands among existing or that an earlier operation has, whatever the case of its
    letters, gets _1, _2, ... until it is free, in the order of the plan.  shared_root says that all batches go into root
    together, so that they are numbered as one plan in the order of batch_id; else each batch is a plan of its own.  A column
    develop of frames (the settings to develop with, or null) goes along with the operations.
    """
    rows, skipped = chosen(frames, existing, root, pattern, grades, places, by_grade, run_time)
    named = _free_names(rows.withColumnRenamed("grade", "final_grade"), existing, shared_root)
    develop = [c for c in ("develop",) if c in frames.columns]
    return named.select(
        "batch_id", "index", F.col("path").alias("source"), F.concat("folder", F.lit("/"), "name").alias("destination"), F.col("final_grade").alias("grade"), *develop
    ), skipped


def chosen(frames: DataFrame, existing: DataFrame, root: str, pattern: str = "{name}", grades=None, places: DataFrame | None = None, by_grade: bool = True, run_time: str = "20000101000000", shared_root: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of a plan (which see) before its names are made free: one row per operation.

    rows has batch_id, index, path, grade, folder, stem, suffix and a column develop of frames.
    """
    develop = [c for c in ("develop",) if c in frames.columns]
    df = numbered(frames, grades)
    folder = F.lit(root)
    if places is not None:
        df = df.join(places.select("batch_id", "place_id", "label"), ["batch_id", "place_id"], "left")
        folder = F.concat(folder, F.lit("/"), F.coalesce("label", F.lit(NO_PLACE)))
    if by_grade:
        folder = F.concat(folder, F.lit("/_"), F.col("final_grade"))
    df = df.withColumn("folder", folder).withColumn("file", filename(pattern, F.col("index"), run_time, F.col("suffix")))
    found = existing.select(F.col("path").alias("_there"), F.lit(True).alias("_is_there")).distinct()
    df = df.join(found, df["path"] == found["_there"], "left")
    skipped = df.where("_is_there is null").select("batch_id", "path", F.lit("missing source").alias("reason"))
    stem = F.expr("substring(file, 1, length(file) - length(suffix))")
    rows = df.where("_is_there").select("batch_id", "index", "path", F.col("final_grade").alias("grade"), "folder", stem.alias("stem"), "suffix", *develop)
    return rows, skipped


#: A number that names get behind their stem, as plans write it.
_NUMBERED = r"^(.*)_([1-9][0-9]{0,8})$"


def _count_before(points: DataFrame, marks: DataFrame, at: str, inclusive: bool) -> DataFrame:
    """points with _marks: how many marks (_key, _at) of their _key lie before them, or at their place too."""
    seen = marks.select("_key", F.col("_at").alias("_place"), F.lit(1).alias("_mark"))
    seen = seen.withColumn("_turn", F.lit(0 if inclusive else 2))
    asked = points.withColumn("_place", F.col(at).cast("long")).withColumn("_mark", F.lit(0)).withColumn("_turn", F.lit(1))
    both = asked.unionByName(seen.withColumn("_place", F.col("_place").cast("long")), allowMissingColumns=True)
    ranged = in_ranges(both, [F.col("_key"), F.col("_place"), F.col("_turn")], "export-names")
    found = sums_before(ranged, "_key", "_mark", "_marks")
    return found.where("_turn = 1").drop("_place", "_mark", "_turn", "_seq", "_part")


def _free_names(chosen: DataFrame, existing: DataFrame, shared_root: bool) -> DataFrame:
    """chosen (batch_id, index, folder, stem, suffix, ...) with name: the first of stem, stem_1, ... that is free.

    Rows with one stem take its free numbers in their order, 0 standing for the plain name: the row with r before it gets
    the r-th number that nothing stands at.  Stems meet others only where one is another with a number behind: then the
    plain name of the longer goes to whoever comes first, which is settled in rounds until nothing changes.  Every count is
    a scan over ranges, so a stem that all rows share spreads over all tasks.
    """
    scope = [] if shared_root else [F.col("batch_id").cast("string")]
    low = lambda c: F.lower(c)
    key = F.concat_ws("\n", *scope, "folder", low("stem"), low("suffix"))
    ranged = in_ranges(chosen.withColumn("_key", key), [F.col("_key"), F.col("batch_id"), F.col("index")], "export-rows")
    rows = sums_before(ranged.withColumn("_one", F.lit(1)), "_key", "_one", "_rank").drop("_one", "_seq", "_part")
    first = F.min(F.struct("batch_id", "index")).alias("_first")
    stems = rows.groupBy("_key").agg(
        first, F.first("folder").alias("folder"), F.first(low("stem")).alias("_stem"), F.first(low("suffix")).alias("_suffix"),
        *([] if shared_root else [F.first("batch_id").alias("batch_id")]),
    )
    stems = stored(stems, "export-stems")
    parent, number = F.regexp_extract("_stem", _NUMBERED, 1), F.nullif(F.regexp_extract("_stem", _NUMBERED, 2), F.lit("")).cast("long")

    # What stands: a name is the plain one of its stem, and a numbered one of the stem before its number.
    file = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    stands = existing.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), file.alias("_file"))
    stands = stands.withColumn("_suffix", F.regexp_extract("_file", r"\.[^.]*$", 0))
    stands = stands.withColumn("_stem", F.expr("substring(_file, 1, length(_file) - length(_suffix))"))
    plain = stands.select("folder", "_stem", "_suffix", F.lit(0).cast("long").alias("_at"))
    behind = stands.where(number.isNotNull()).select("folder", parent.alias("_stem"), "_suffix", number.alias("_at"))
    taken = plain.union(behind).join(stems, ["folder", "_stem", "_suffix"]).select("_key", "_at").distinct()
    taken = stored(taken, "export-stands")

    where = ["folder", "_suffix", *([] if shared_root else ["batch_id"])]
    longer = stems.where(number.isNotNull()).select(*where, parent.alias("_stem"), number.alias("_at"), F.col("_key").alias("_child"), "_first")
    longer = longer.join(stems.select(*where, "_stem", "_key"), [*where, "_stem"]).select("_key", "_at", "_child", "_first")
    longer = longer.join(taken, ["_key", "_at"], "left_anti").withColumn("_own", F.lit(False))
    longer = stored(longer, "export-longer")
    changed = not longer.isEmpty()
    while changed:
        held = taken.union(longer.where("_own").select("_key", "_at"))
        asked = _count_before(longer, held, "_at", inclusive=False)
        turn = rows.select("_key", F.col("_rank").alias("_turn_rank"), F.struct("batch_id", "index").alias("_turn_at"))
        met = asked.join(turn.withColumnRenamed("_key", "_turn_key"), (F.col("_key") == F.col("_turn_key")) & (F.col("_at") - F.col("_marks") == F.col("_turn_rank")), "left")
        own = F.col("_turn_at").isNull() | (F.col("_first") < F.col("_turn_at"))
        new = stored(met.select("_key", "_at", "_child", "_first", F.col("_own").alias("_was"), own.alias("_own")), "export-longer")
        changed = not new.where("_own <> _was").isEmpty()
        longer = new.drop("_was")

    lost = longer.where("not _own").select(F.col("_child").alias("_key"), F.lit(0).cast("long").alias("_at"))
    held = taken.union(longer.where("_own").select("_key", "_at")).union(lost).distinct()
    # The n-th taken number less n: so many free ones lie before it.
    places = _count_before(held, held, "_at", inclusive=False).select("_key", (F.col("_at") - F.col("_marks")).alias("_at"))
    found = _count_before(rows, places, "_rank", inclusive=True)
    number = F.col("_rank") + F.col("_marks")
    name = F.concat("stem", F.when(number > 0, F.concat(F.lit("_"), number.cast("string"))).otherwise(""), "suffix")
    return found.withColumn("name", name)


def plan_counts(operations: DataFrame) -> DataFrame:
    """Operations of each batch by grade, and how many of them are developed (none without a column develop)."""
    develop = F.count("develop") if "develop" in operations.columns else F.lit(0).cast("long")
    return operations.groupBy("batch_id").agg(*(F.count_if(F.col("grade") == g).alias(g) for g in GRADES), develop.alias("develop"))


def undo(log: DataFrame, existing: DataFrame) -> DataFrame:
    """(batch_id, pos, action, path, status) in reverse order of a log (batch_id, pos, mode, source, destination, rendered).

    An unknown mode refuses its whole log; a row without source or destination fails, as does one whose destination is
    gone; a move goes back unless something stands at its source; everything else deletes the destination.
    """
    there = existing.select("path").distinct()
    at = lambda name: there.select(F.col("path").alias(f"_{name}"), F.lit(True).alias(f"{name}_exists"))
    df = log.join(at("source"), log["source"] == F.col("_source"), "left").join(at("destination"), log["destination"] == F.col("_destination"), "left")
    back = (F.col("mode") == "move") & ~F.coalesce("rendered", F.lit(False))
    status = (
        F.when(~F.col("mode").isin("copy", "move"), "refused")
        .when(F.col("source").isNull() | F.col("destination").isNull(), "malformed")
        .when(F.col("destination_exists").isNull(), "missing")
        .when(back & F.col("source_exists"), "occupied")
        .otherwise("ok")
    )
    w = Window.partitionBy("batch_id").orderBy(F.desc("pos"))
    return df.select(
        "batch_id", F.row_number().over(w).alias("step"), F.when(back, "move_back").otherwise("delete").alias("action"), F.col("destination").alias("path"), status.alias("status")
    )


def undo_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("batch_id").agg(
        F.count_if((F.col("status") == "ok") & (F.col("action") == "move_back")).alias("restored"),
        F.count_if((F.col("status") == "ok") & (F.col("action") == "delete")).alias("deleted"),
        F.count_if(F.col("status") != "ok").alias("failed"),
    )


def newest_log(logs: DataFrame) -> DataFrame:
    """The log created last, per root."""
    return logs.groupBy("root").agg(F.max_by("file", F.struct("created", "file")).alias("file"), F.max("created").alias("created"))


# -- queue -------------------------------------------------------------------------------------------------------------


def queue(entries: DataFrame) -> DataFrame:
    """Entries (seq, source, value...) by source: the place of the first, the values of the last."""
    values = [c for c in entries.columns if c not in ("seq", "source")]
    return entries.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.min("seq").alias("seq"), *(F.max_by(c, "seq").alias(c) for c in values)
    )


def queue_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(added, updated) when new entries meet a queue."""
    known = old.select(F.col("source").alias("_s"), F.lit(True).alias("_known"))
    df = queue(new).join(known, F.col("source") == F.col("_s"), "left")
    return df.agg(F.count_if(F.col("_known").isNull()).alias("added"), F.count_if(F.col("_known")).alias("updated"))


def queue_counts(entries: DataFrame) -> DataFrame:
    """(entries, develop): how many sources a queue holds, and how many of them with settings to develop."""
    return queue(entries).agg(F.count("*").alias("entries"), F.count("develop").alias("develop"))


def without(entries: DataFrame, removed: DataFrame) -> DataFrame:
    return entries.join(removed.select("source").distinct(), "source", "left_anti")
