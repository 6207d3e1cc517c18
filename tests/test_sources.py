"""The file listing and the versioned catalog on real folders."""
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shutterlake.sources import files, versions
from shutterlake.sources.listing import Folder, _Listing


def put(root, name, at, content=b"x"):
    p = Path(root) / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(content)
    os.utime(p, (at, at))


@pytest.fixture
def photos(tmp_path):
    root = tmp_path / "photos"
    for i, name in enumerate(["_DSF0001.RAF", "DSF0002.JPG", ".hid.jpg", "a/_DSF0003.JPG", "a/.thumbs/x.jpg", "a/b/c/d/deep.jpeg", "_x/y.raf", "a/notes.txt", "a/.jpg", "ü/ö.JPEG", "a/b/_.raf"]):
        put(root, name, 1_700_000_000 + i, b"x" * i)
    os.symlink(root / "a", root / "again")
    os.symlink(root, root / "a" / "up")
    put(tmp_path, "other/elsewhere.jpg", 1_700_000_050)
    os.symlink(tmp_path / "other", root / "ü" / "link")
    os.symlink(tmp_path / "other", root / "link2")
    return root


WANT = {"_DSF0001.RAF", "DSF0002.JPG", "a/_DSF0003.JPG", "a/b/c/d/deep.jpeg", "_x/y.raf", "ü/ö.JPEG", "a/b/_.raf"}


@pytest.mark.parametrize("depth", [None, 0, 1, 5])
def test_scan(spark, photos, depth):
    rows = files.scan(spark, str(photos), depth).collect()
    assert sorted(r["path"] for r in rows ) == sorted([*(f"{photos}/{n}" for n in WANT), f"{photos.parent}/other/elsewhere.jpg"])
    assert len(rows) == len({r["path"] for r in rows})
    assert all(r["path"] == f"{r['dir']}/{r['name']}" for r in rows)
    by_name = {r["name"]: r for r in rows}
    assert by_name["DSF0002.JPG"]["mtime"] == 1_700_000_001 and by_name["DSF0002.JPG"]["size"] == 1
    assert files.scan(spark, f"{photos}/_x").count() == 1


def test_partitions_are_folders(photos):
    parts = _Listing({"path": str(photos), "depth": "1"}).folders()
    assert {Path(p.path).name for p in parts} == {"photos", "a", "_x", "ü", "other"} and [p.whole for p in parts] == [False, True, True, True, True]
    assert [p.path for p in _Listing({"path": str(photos), "levels": "0"}).folders()] == [str(photos)]
    shallow = _Listing({"path": str(photos), "levels": "1"})
    assert {r[2] for p in shallow.folders() for r in shallow.files(p)} == {"_DSF0001.RAF", "DSF0002.JPG", "_DSF0003.JPG", "y.raf", "ö.JPEG", "elsewhere.jpg"}
    assert list(shallow.files(Folder(f"{photos}/gone", True, None))) == []


def test_second_scan_reads_what_is_new(spark, photos, tmp_path):
    def run():
        q = files.new_files(spark, str(photos)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r["name"] for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["name"] != "elsewhere.jpg")

    names = sorted(Path(n).name for n in WANT)
    assert run() == names
    assert run() == names
    put(photos, "a/b/_new.RAF", 1_800_000_000)
    put(photos, ".late.jpg", 1_800_000_001)
    assert run() == sorted([*names, "_new.RAF"])


PAIRS = "id string, folder_id long, primary_path string"


def seen(spark, path):
    return sorted(tuple(r) for r in versions.read_catalog(spark, path).select("id", "folder_id", "path", "missing").collect())


def disk(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_catalog_versions(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/catalog"
    assert seen(spark, path) == []
    pairs = lambda rows: spark.createDataFrame(rows, PAIRS)
    assert versions.upsert_scan(pairs([("a", 1, "p/a"), ("b", 1, "p/b"), ("c", 2, "p/c")]), path, 1)
    first = disk(path)
    # only folder 1 is written anew; what the scan did not find is missing, folder 2 keeps its files
    assert versions.upsert_scan(pairs([("a", 1, "q/a"), ("d", 1, "p/d")]), path, 2)
    want = [("a", 1, "q/a", False), ("b", 1, "p/b", True), ("c", 2, "p/c", False), ("d", 1, "p/d", False)]
    assert seen(spark, path) == want
    second = disk(path)
    assert first.items() <= second.items() and not [p for p in second if "version=2" in p and "folder_id=2" in p]
    # a repeated number changes nothing
    assert not versions.upsert_scan(pairs([("z", 2, "p/z")]), path, 2)
    assert disk(path) == second and seen(spark, path) == want
    # a write that fails before its commit leaves the old version, and is replaced when it is repeated
    with monkeypatch.context() as m:
        m.setattr(type(spark), "range", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            versions.upsert_scan(pairs([("e", 2, "p/e")]), path, 3)
    assert seen(spark, path) == want
    assert versions.upsert_scan(pairs([("f", 2, "p/f")]), path, 3)
    assert seen(spark, path) == sorted([("a", 1, "q/a", False), ("b", 1, "p/b", True), ("c", 2, "p/c", True), ("d", 1, "p/d", False), ("f", 2, "p/f", False)])
    # an emptied folder, by a row without an id
    assert versions.upsert_scan(pairs([(None, 1, None)]), path, 4)
    assert [r[3] for r in seen(spark, path) if r[1] == 1] == [True] * 3
    with pytest.raises(Exception, match="folder_id"):
        versions.upsert_scan(pairs([("g", None, "p/g")]), path, 5)


def test_large_folder_is_spread(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit(1).cast("long").alias("folder_id"), F.lit("p").alias("path"), F.lit(0).alias("rating"), F.lit(None).cast("string").alias("tags"), F.lit(False).alias("trashed"), F.lit(False).alias("missing"))
    versions.write_folders(rows, rows.select("folder_id"), f"{tmp_path}/c", 1, 1000)
    assert len(disk(f"{tmp_path}/c/data")) >= 5 and versions.read_catalog(spark, f"{tmp_path}/c").count() == 5000


def test_catalog_sink(spark, tmp_path):
    sink = versions.catalog_sink(f"{tmp_path}/c")
    batch = spark.createDataFrame([("a", 1, "p/a")], PAIRS)
    sink(batch, 0)
    sink(batch, 0)
    sink(spark.createDataFrame([("b", 2, "p/b")], PAIRS), 1)
    assert seen(spark, f"{tmp_path}/c") == [("a", 1, "p/a", False), ("b", 2, "p/b", False)]
