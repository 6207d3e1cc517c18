"""Image jobs over real files, folder opening, and the remaining identity changes."""
import math
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from shutterlake.operators import catalog as C, identity as D, imaging as I, vectors as V


def png(path, rgb):
    h, w = rgb.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_jobs(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (40, 60, 3), np.uint8), np.full((30, 30, 3), 255, np.uint8)
    png(tmp_path / "a.png", a)
    png(tmp_path / "b.png", b)
    rows = I.images(spark, str(tmp_path)).withColumn("origin", F.substring_index("origin", "/", -1))
    got = {r["origin"]: r for r in I.exposure_job(rows).collect()}
    assert got["a.png"]["red"] == np.bincount(a[:, :, 0].ravel(), minlength=256).tolist() and got["a.png"]["blue"] == np.bincount(a[:, :, 2].ravel(), minlength=256).tolist()
    assert got["b.png"]["highlights"] == 1.0 and got["b.png"]["luma"][255] == 900
    assert got["a.png"]["mask_width"] == 15 and len(got["a.png"]["mask"]) == 150 and set(got["b.png"]["mask"]) == {1}
    want = [0] * 150
    for y in range(40):
        for x in range(60):
            if a[y, x].max() >= 250 or a[y, x].max() <= 5:
                want[y // 4 * 15 + x // 4] = 1 if a[y, x].max() >= 250 else 2
    assert got["a.png"]["mask"] == want
    points = spark.createDataFrame([("a.png", "point", 0.5, 0.5, 8), ("b.png", "manual", None, None, None)], "origin string, status string, x double, y double, half int")
    focus = {r["origin"]: (r["status"], r["score"]) for r in I.focus_job(rows, points).collect()}
    assert focus["a.png"][0] == "ok" and abs(focus["a.png"][1] - I.laplacian_variance(a, 30, 20, 8)) < 1e-9 and focus["b.png"][0] == "manual"
    def make():
        def model(images):
            assert images.ndim == 4 and images.shape[1:] == (6, 5, 3) and len(images) <= 2
            return images.mean((1, 2))

        return model

    vectors = {r["origin"]: r["embedding"] for r in I.embed_job(rows, make, 3, (6, 5), 2).collect()}
    for r in rows.collect():
        want = I.scaled(I.raster(r.asDict()), 6, 5).astype(float).mean((0, 1))
        assert np.allclose(vectors[r["origin"]], want / np.linalg.norm(want), atol=1e-5)
    docs = spark.createDataFrame([(1, '{"ExifIFD:DateTimeOriginal":"2024:01:01 00:00:00","IFD0:Orientation":6,"x":1}'), (2, "{}")], "photo_id long, doc string")
    facts = I.photo_metadata_job(docs, spark.createDataFrame([(1, 60, 40, 5), (2, 30, 30, 7)], "photo_id long, width int, height int, mtime long"))
    assert sorted(map(tuple, facts.collect())) == [(1, 1704067200000, 40, 60), (2, 7000, 30, 30)]


def test_open_folders(spark):
    files = spark.createDataFrame([(1, "/r", "A1.JPG", 1, 10), (1, "/r", "a1.raf", 1, 10), (1, "/r", "A2.jpg", 2, 10)], "folder_id long, dir string, name string, mtime long, size long")
    pairs = {r["stem"]: r["id"] for r in C.pair_files(files).collect()}
    catalog = spark.createDataFrame([(1, "/r", "A1", pairs["A1"], 5, ["x"], False), (1, "/r", "A9", "gone", 3, None, False), (1, "/r", "A8", "bin", 1, None, True)], "folder_id long, dir string, stem string, id string, rating int, tags array<string>, trashed boolean")
    got = C.opened(files, catalog, "name").orderBy("pos").collect()
    assert [(r["stem"], r["state"], r["rating"]) for r in got] == [("A1", "seen", 5), ("A2", "new", 0)]
    assert {(got[0]["total"], got[0]["starred"], got[0]["trashed"])} == {(2, 1, 1)} and got[0][-1] == 1
    times = spark.createDataFrame([(pairs["A2"], "2020-01-01")], "id string, day string").select("id", F.col("day").cast("timestamp_ntz").alias("capture_ts"))
    assert [r["stem"] for r in C.opened(files, catalog, "capture", captures=times).orderBy("pos").collect()] == ["A2", "A1"]


def test_identity_changes(spark):
    faces = spark.createDataFrame([(1, 1, 5, 7, "user", False), (2, 2, 6, 7, "user", False), (3, 1, 5, 7, "auto", False), (4, 3, 1, 7, "auto", False)], "face_id long, photo_id long, revision long, person_id long, assigned_by string, ignored boolean")
    before = spark.createDataFrame([(1, 1, 5, None, None), (2, 2, 4, 3, "auto")], "face_id long, photo_id long, revision long, person_id long, assigned_by string")
    no = spark.createDataFrame([(1, 3, 50), (2, 3, 60), (1, 9, 10)], "face_id long, person_id long, created_at long")
    written, people = no.filter("created_at >= 50").drop("created_at"), spark.createDataFrame([(7, "Ada"), (3, "Bo")], "person_id long, name string")
    autos = spark.createDataFrame([(4, 3, 1)], "face_id long, photo_id long, revision long")
    persons, back, left = D.naming_undone(people, faces, no, before, written, autos, 7, True)
    # photo 2 was edited since: it keeps its name and its rejection; face 3 was labelled because of the naming, face 4 before it
    assert sorted((r["face_id"], r["person_id"], r["assigned_by"]) for r in back.collect()) == [(1, None, None), (2, 7, "user"), (3, None, None), (4, 7, "auto")]
    assert sorted((r["face_id"], r["person_id"]) for r in left.collect()) == [(1, 9), (2, 3)] and persons.count() == 2
    alone = faces.filter("face_id in (1, 3)")
    persons, back, _ = D.naming_undone(people, alone, no, before, written, autos, 7, True)
    assert [r["name"] for r in persons.collect()] == ["Bo"] and back.filter("person_id is not null").count() == 0
    files, *empty = D.all_erased(spark.createDataFrame([("0123456789abcdef-f0.jpg",), ("x.jpg",)], "name string"), r"^[0-9a-f]{16}-f\d+", people, faces, no)
    assert files.count() == 1 and [t.columns for t in empty] == [people.columns, faces.columns, no.columns] and not any(t.count() for t in empty)
    scans = spark.createDataFrame([(1, 10, 20), (2, 30, 40)], "photo_id long, mtime long, size long")
    assert sorted(map(tuple, D.stats_refreshed(scans, spark.createDataFrame([(1, 11, 21)], "photo_id long, mtime long, size long")).collect())) == [(1, 11, 21), (2, 30, 40)]
    listing = spark.createDataFrame([("0123456789abcdef-f0.jpg",), ("x.jpg",)], "name string")
    assert D.erased(r"^[0-9a-f]{16}-f\d+", listing).count() == 1
    assert D.stray_filtered(spark.createDataFrame([(1,), (9,)], "photo_id long"), faces, 7).collect()[0]["photo_id"] == 9


def test_detection_grid(spark):
    grid = [(1, 8, 2, [0.9, 0.1, 1.5, 0.5], [0.9, 1.0, 0.64, 0.5], [[0.5, 0.5, 0.0, 0.0]] * 4)]
    df = spark.createDataFrame(grid, "photo_id long, stride int, columns int, cls array<double>, obj array<double>, bbox array<array<double>>")
    boxes = sorted((round(r["score"], 6), r["x"], r["y"], r["w"]) for r in V.decoded_cells(df, 0.6).collect())
    assert boxes == [(0.8, 0.0, 8.0, 8.0), (0.9, 0.0, 0.0, 8.0)]
    assert V.suppressed(V.decoded_cells(df, 0.6), 0.3).count() == 2
