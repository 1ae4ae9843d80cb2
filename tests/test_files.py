import json

import pytest
from pyspark.sql import functions as F

from framesieve.operators import store
from framesieve.sources import files, inventory


def test_listing(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name in ("_DSC1.ARW", "_DSC1.JPG", "empty.CR3", "s/x.nef"):
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"ab")
    found = files.listing(spark, f"file://{tmp_path}")
    assert sorted((r.path.removeprefix(str(tmp_path)), r.size) for r in found.collect()) == [
        ("/_DSC1.ARW", 2), ("/_DSC1.JPG", 2), ("/empty.CR3", 0), ("/s/x.nef", 2)
    ]
    photos = inventory.inventory(found, str(tmp_path)).orderBy("input_order")
    assert [r.name for r in photos.collect()] == ["_DSC1.ARW", "empty.CR3", "x.nef"]


def test_logs_queues_calibrations(spark, tmp_path):
    ops = spark.createDataFrame([(2, "/b", "/o/b", "keep", False), (1, "/a", "/o/a", "keep", True)], "index int, source string, destination string, grade string, rendered boolean")
    for day in ("2024-01-01", "2024-01-02"):
        files.write_log(ops if day.endswith("2") else ops.limit(1), f"{tmp_path}/logs", day, "copy", "/o")
    (tmp_path / "logs" / "log=export_20240102" / "broken.json").write_text("not json\n")
    assert [(r.created, r.source) for r in files.newest_log(spark, f"{tmp_path}/logs").collect()] == [("2024-01-02", "/b"), ("2024-01-02", "/a")]
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_log(ops, f"{tmp_path}/logs", "2024-01-02", "copy", "/o")
    with pytest.raises(ValueError):
        files.write_log(ops, f"{tmp_path}/logs", "2024-01-02", "copy", "/o", name="a/b")
    # A newer log without operations leaves nothing to undo.
    files.write_log(ops.limit(0), f"{tmp_path}/logs", "2024-01-03", "copy", "/o")
    assert files.newest_log(spark, f"{tmp_path}/logs").count() == 0 and files.read_logs(spark, f"{tmp_path}/logs").count() == 3
    document = {"version": 1, "created": "2024-01-01", "mode": "move", "root": "/o", "operations": [{"source": "/a", "destination": "/o/a", "grade": "keep"}]}
    (tmp_path / "documents").mkdir()
    (tmp_path / "documents" / "export_1.json").write_text(json.dumps(document, indent=2))
    (tmp_path / "documents" / "export_2.json").write_text("[")
    read = files.read_log_documents(spark, f"{tmp_path}/documents").collect()
    assert [(r.file, r.pos, r.source, r.rendered) for r in read] == [("export_1.json", 0, "/a", None)]
    entries = spark.createDataFrame([(2, "/b", None, "keep", "p"), (1, "/a", "{}", None, None), (3, None, None, None, None)], files.QUEUE)
    files.write_queue(entries, f"{tmp_path}/queue")
    assert [r.source for r in files.read_queue(spark, f"{tmp_path}/queue").collect()] == ["/a", "/b"]
    old = spark.createDataFrame([("x", "X", [1.0, 1.0, 1.0], 4), ("y", "Y", [1.0, 1.0], 4), ("z", "Z", [9.0, 1.0, 1.0], 4)], files.CALIBRATION)
    new = spark.createDataFrame([("x", "X", [1.1, 1.0, 0.9], 5)], files.CALIBRATION)
    files.write_calibrations(old, new, f"{tmp_path}/cal")
    assert [(r.key, r.samples) for r in files.read_calibrations(spark, f"{tmp_path}/cal").select("key", "samples", F.lit(1)).collect()] == [("x", 5)]


def test_log_is_written_by_all_tasks(spark, tmp_path):
    ops = spark.range(0, 1000, 1, 6).select(
        F.col("id").alias("index"), F.col("id").cast("string").alias("source"), F.col("id").cast("string").alias("destination"), F.lit("keep").alias("grade"), F.lit(True).alias("rendered")
    )
    files.write_log(ops, f"{tmp_path}/logs", "2024-01-01", "move", "/o")
    assert len(list((tmp_path / "logs" / "log=export_20240101").glob("part-*"))) >= 6
    assert [r.pos for r in files.newest_log(spark, f"{tmp_path}/logs").collect()] == list(range(999, -1, -1))


def test_store_cleared(spark, tmp_path):
    home = tmp_path / "shoot"
    (home / "thumbs").mkdir(parents=True)
    for i in range(3):
        (home / "thumbs" / f"{i}.jpg").write_bytes(b"x" * i)
    (home / "thumbs" / "note.txt").write_text("mine")
    spark.range(5).coalesce(1).write.parquet(f"{home}/analysis")
    ops = spark.createDataFrame([(1, "/a", "/o/a", "keep", False)], "index int, source string, destination string, grade string, rendered boolean")
    for day in ("1", "2"):
        files.write_log(ops, f"{home}/logs", day, "copy", "/o")
    root = f"file://{home}"
    entries = spark.read.parquet(f"{home}/analysis").select(F.lit(str(home)).alias("folder"))
    r = store.statistics_by_kind(files.listing(spark, root), entries).where(F.col("folder") == str(home)).first()
    assert (r.analysis_entries, r.thumbnails, r.thumbnail_bytes, r.logs) == (5, 3, 3, 2)
    assert r.total_bytes == r.analysis_bytes + 3 > 3
    before = files.clear_store(spark, root)
    assert before.count() > files.listing(spark, root).count()
    assert sorted(p.name for p in (home / "thumbs").iterdir()) == ["note.txt"] and not [p for p in (home / "analysis").iterdir() if p.is_file()]
    assert files.read_logs(spark, f"{home}/logs").count() == 2
    files.clear_store(spark, root, keep_logs=False)
    assert [p.name for p in home.rglob("*") if p.is_file()] == ["note.txt"]
