"""Literal inputs: pairing, orders, journal, outbox, rules, vectors, rasters, eviction, scalars."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions import scalars as S
from shutterlake.operators import catalog as C, identity as D, imaging as I, journal as J, rules as R, vectors as V
from shutterlake.operators.metrics import rounded_rank
from shutterlake.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


def test_pairing(spark):
    names = [("", "DSCF0001.JPG"), ("", "DSCF0001.RAF"), ("", "DSCF0002.jpg"), ("sub", "DSCF0003.raf"), ("sub", "DSCF0001.jpg"), ("", "notes.txt"), ("", "DSCF0002.jpg")]
    df = spark.createDataFrame([(1, d, n, 1, 1) for d, n in names], "folder_id long, dir string, name string, mtime long, size long")
    got = C.pair_files(df).collect()
    assert len(got) == 4 and len({r["id"] for r in got}) == 4
    both = next(r for r in got if r["dir"] == "" and r["stem"] == "DSCF0001")
    assert both["jpeg_path"] and both["raf_path"]
    assert next(r for r in got if r["stem"] == "DSCF0003")["jpeg_path"] is None


def ordered(spark, data, sort, reverse=False):
    df = spark.createDataFrame([(1, s, d, s + d, t, r) for s, d, t, r in data], "folder_id long, stem string, dir string, id string, capture_ts long, rating int")
    return [r["stem"] + r["dir"] for r in C.ranked(df, sort, reverse).orderBy("pos").collect()]


def test_orders(spark):
    assert ordered(spark, [("0002", "", 100, 0), ("0001", "", 100, 0), ("0003", "", 50, 0)], "capture") == ["0003", "0001", "0002"]
    assert ordered(spark, [("0001", "", 100, 0), ("0000", "", None, 0)], "capture")[0] == "0001"
    assert ordered(spark, [("0001", "", 100, 1), ("0002", "", 200, 5), ("0000", "", 50, 5)], "rating") == ["0000", "0002", "0001"]
    assert ordered(spark, [("0001", "", 100, 0), ("0002", "", 200, 0)], "capture", True)[0] == "0002"
    assert ordered(spark, [("s", "sub", 1, 0), ("s", "", 1, 0)], "name") == ["s", "ssub"]
    assert ordered(spark, [("b", "", 1, 0), ("C", "", 1, 0), ("é", "", 1, 0), ("f", "", 1, 0), ("a", "", 1, 0)], "name") == ["a", "b", "C", "é", "f"]


def test_star_and_focus_filters(spark):
    df = spark.createDataFrame([(r,) for r in range(6)], "rating int")
    for n in range(1, 6):
        assert rows(df.filter(C.star_filter(f"star{n}plus"))) == [(r,) for r in range(n, 6)]
    photos, scores = spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("a", 89.4), ("b", 270.5)], "id string, score double")
    assert rows(C.focus_filter(photos, scores, 150)) == [("a",)] and C.focus_filter(photos, scores, None).count() == 3 and C.focus_filter(photos, scores, 0).count() == 0


def test_undo_redo():
    lane = J.Lane()
    for seq, cmd in enumerate(["rate", "rate", "undo", "redo", "undo", "rate"]):
        lane.step(cmd, (seq,))
    assert [a[0] for a in lane.live] == [0, 5] and not lane.undone


def test_outbox(spark):
    fields = "photo_id long, seq long, kind string, rating long, tags string, token long"
    events = [(1, 1, "rate", 3, None, None)] + [(1, 1 + i, "error", None, None, None) for i in range(1, 6)] + [(2, 1, "rate", 2, None, None), (2, 2, "tags", None, "x", None), (2, 3, "done", None, None, 1), (3, 1, "rate", 1, None, None), (3, 2, "trash", None, None, None), (4, 1, "rate", 1, None, None), (4, 2, "done", None, None, 1)]
    jobs = J.outbox(spark.createDataFrame(events, fields))
    assert rows(jobs, "photo_id", "rating", "tags", "job_seq", "attempts", "status") == [(1, 3, None, 1, 5, "error"), (2, 2, "x", 2, 0, "pending")]
    again = J.outbox(spark.createDataFrame([*events, (1, 9, "rearm", None, None, None)], fields)).filter("photo_id = 1")
    assert rows(again, "attempts", "status") == [(0, "pending")]
    assert J.queue_status(jobs).first()[:2] == (1, 1)


DOCUMENT = '{"FujiFilm:FilmMode":"Classic Negative","FujiFilm:WhiteBalanceFineTune":"Red +20, Blue -80","FujiFilm:Saturation":"+3 (very high)","FujiFilm:HighlightTone":"-2 (soft)","FujiFilm:GrainEffectRoughness":"Strong"}'


def test_recipes(spark):
    wide, exact = ("wide", {"film": "classic negative ", "color": {"min": 2, "max": 4}, "grain": ["Weak", "Strong"]}), ("exact", {"film": "Classic Negative", "wb_shift": "Red +20, Blue -80"})
    recipes = [wide, exact, ("tight", {"highlight": {"min": -1, "max": 0}}), ("loose", {"highlight": {"min": -2, "max": 0}, "color": 3}), ("absent", {"clarity": 0})]
    docs = spark.createDataFrame([(1, DOCUMENT), (2, "not json"), (3, None)], "photo_id long, doc string")
    assert rows(R.matched(docs, R.rules_frame(spark, recipes))) == [(1, "wide", "wide,exact,loose"), (2, None, ""), (3, None, "")]
    assert rows(R.matched(docs, R.rules_frame(spark, [("any", {})])), "first") == [("any",)] * 3
    toml = '[[recipe]]\nname = "r"\nfilm = "x"\ncolor = {min = 1, max = 2.5}\ngrain = ["a", 3]\n'
    assert R.recipes_of_toml(toml) == [("r", {"film": "x", "color": {"min": 1, "max": 2.5}, "grain": ["a", 3]})]


def test_focus_points(spark):
    doc = lambda pixel, o, more="": f'{{"FujiFilm:FocusPixel":"{pixel}","File:ImageWidth":7728,"File:ImageHeight":5152,"IFD0:Orientation":{o}{more}}}'
    data = [(1, doc("3864 2576", 1)), (2, doc("3864 515", 6)), (3, doc("1 1", 1, ',"FujiFilm:FocusMode":"Manual"')), (4, doc("1 1", 1, ',"FujiFilm:AFAreaMode":"Wide/Tracking"')), (5, "{}")]
    got = {r["photo_id"]: r for r in R.focus_points(spark.createDataFrame(data, "photo_id long, doc string")).collect()}
    assert (got[1]["x"], got[1]["y"], got[1]["status"]) == (0.5, 0.5, "point") and got[2]["x"] > 0.85 and got[2]["y"] == 0.5
    assert [got[i]["status"] for i in (3, 4, 5)] == ["manual", "tracking", "no_af"]


def e(x, y):
    n = math.hypot(x, y) or 1
    return [x / n, y / n]


def vectors(spark, items, key=0):
    return spark.createDataFrame([(key, i, i, e(*v), 1.0 - i / 100) for i, v in enumerate(items)], "key long, id long, photo_id long, vector array<double>, score double")


def test_clusters(spark):
    got = dict(rows(V.leader_clusters(vectors(spark, [(1, 0), (0, 1), (0.98, 0.05), (0.05, 0.98), (-1, -1)]), 0.9), "id", "cluster"))
    assert got == {0: 0, 2: 0, 1: 1, 3: 1, 4: 4}
    shown = D.clusters(vectors(spark, [(1, 0.05), (0, 1), (1, 0), (-1, 0.3)]), 0.9)
    assert sorted((r["size"], list(r["members"])) for r in shown.collect()) == [(1, [1]), (1, [3]), (2, [0, 2])]


@pytest.mark.parametrize("block", [2048, 7])
def test_leader_rounds(spark, block):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(80, 4))
    df = spark.createDataFrame([(int(i % 2), int(i), [float(x) for x in v], float(rng.integers(0, 20))) for i, v in enumerate(m)], "key long, id long, vector array<double>, score double")
    want = {}
    data = df.collect()
    for k in (0, 1):
        anchors = []
        for r in sorted((r for r in data if r["key"] == k), key=lambda r: (-r["score"], r["id"])):
            v = np.array(r["vector"])
            near = [i for i, w in anchors if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.7]
            if not near:
                anchors.append((r["id"], v))
            want[r["id"]] = near[0] if near else r["id"]
    assert dict(rows(V.leader_clusters(df, 0.7, block), "id", "cluster")) == want


def test_exemplars_and_outliers(spark):
    picks = V.exemplars(vectors(spark, [(1, 0), (0.99, 0.01), (0.98, 0.02), (0, 1), (-1, 0.5)]), 3)
    assert {r["id"] for r in picks.collect()} == {0, 3, 4}
    kept = lambda items: {r["id"] for r in V.without_outliers(vectors(spark, items)).collect()}
    assert kept([(1, 0), (0.95, 0.2), (0.9, 0.3), (0.97, 0.1), (0, 1)]) == {0, 1, 2, 3}
    assert kept([(1, 0), (0, 1), (-1, 0)]) == {0, 1, 2} and kept([(1, 0), (0, 1), (-1, 0), (0, -1)]) == {0, 1, 2, 3}


def test_matching(spark):
    protos = spark.createDataFrame([(1, e(1, 0)), (2, e(0, 1))], "key long, vector array<double>")
    ask = lambda v, barred=(): V.accepted(V.best_keys(spark.createDataFrame([(7, e(*v), list(barred))], "id long, vector array<double>, barred array<long>"), protos), 0.40, 0.05)
    assert rows(ask((0.95, 0.1)), "id", "first") == [(7, 1)]
    assert rows(ask((1, 1))) == [] and rows(ask((1, 1), [2]), "first") == [(1,)]
    claims = spark.createDataFrame([(1, 0, 0, 1, 0.6), (1, 1, 1, 2, 0.9), (1, 2, 2, 1, 0.8)], "photo_id long, id long, face_index long, person long, score double")
    assert rows(V.one_per_photo(claims), "id", "person") == [(1, 2), (2, 1)]


def boxes(spark, items):
    return spark.createDataFrame([(1, i, float(x), 0.1, 0.2, 0.2, e(*v)) for i, (x, v) in enumerate(items)], "photo_id long, id long, x double, y double, w double, h double, embedding array<double>")


def test_carry_over(spark):
    pairs = lambda old, new: rows(V.carried(boxes(spark, old), boxes(spark, new)), "old_id", "new_id")
    v = (1, 0)
    assert pairs([(0.10, v)], [(0.11, v)]) == [(0, 0)] and pairs([(0.10, v)], [(0.11, (0, 1))]) == []
    assert pairs([(0.10, v), (0.13, v)], [(0.11, v)]) == [(0, 0)]
    assert pairs([(0.10, v)], [(0.11, v), (0.115, v)]) == [] and pairs([(0.10, v)], [(0.11, v), (0.15, v)]) == [(0, 0)]


FACES = "face_id long, photo_id long, face_index long, embedding array<double>, det_score double, person_id long, assigned_by string, ignored boolean"


def test_sweep_and_corrections(spark):
    data = [(1, 1, 0, e(1, 0), 0.9, 1, "user", False), (2, 4, 0, e(0, 1), 0.9, 2, "user", False), (3, 2, 0, e(0.98, 0.05), 0.9, None, None, False), (4, 3, 0, e(1, 1), 0.9, None, None, False)]
    faces, no = spark.createDataFrame(data, FACES), spark.createDataFrame([], "face_id long, person_id long, created_at long")
    assert rows(D.swept(faces, no, 0.40, 0.05), "face_id", "person_id", "assigned_by") == [(1, 1, "user"), (2, 2, "user"), (3, 1, "auto"), (4, None, None)]
    _, said = D.rejected(faces, no, spark.createDataFrame([(3, 1)], "face_id long, person_id long"), 5)
    assert rows(D.swept(faces, said, 0.40, 0.05).filter("face_id = 3"), "person_id") == [(None,)]
    named, more = D.named(faces, no, spark.createDataFrame([(1, 2), (3, 2)], "face_id long, to_person long"), 7)
    assert rows(named, "face_id", "person_id") == [(1, 2), (2, 2), (3, 2), (4, None)] and rows(more) == [(1, 1, 7)]
    persons = spark.createDataFrame([(1, "Alex"), (2, "Dani")], "person_id long, name string")
    left, moved, kept = D.merged(persons, faces, spark.createDataFrame([(1, 2, 1), (3, 1, 1), (3, 2, 2)], "face_id long, person_id long, created_at long"), 1, 2)
    assert rows(left) == [(2, "Dani")] and rows(moved, "person_id") == [(2,), (2,), (None,), (None,)] and rows(kept) == [(3, 2, 1)]
    renames, clash = D.renamed(persons, spark.createDataFrame([(1, " dani "), (2, "Eve")], "person_id long, new_name string"))
    assert rows(clash) == [(1, 2, " dani ")] and rows(renames) == [(1, "Alex"), (2, "Eve")]
    assert rows(D.found_or_created(persons, spark.createDataFrame([(" ALEX",), ("Zoe",), (" ",)], "name string"))) == [(1, "Alex"), (2, "Dani"), (3, "Zoe")]


def test_images(spark):
    grid = {(x, y): (128, 128, 128) for x in range(16) for y in range(16)}
    grid |= {(x, y): (255, 200, 100) for x in range(4) for y in range(4)} | {(x, y): (2, 2, 2) for x in range(12, 16) for y in range(12, 16)}
    df = spark.createDataFrame([(1, x, y, *c) for (x, y), c in grid.items()], "photo_id long, x int, y int, r int, g int, b int")
    red = {r["bin"]: r["n"] for r in I.histograms(df).filter("channel = 'r'").collect()}
    assert sum(red.values()) == 256 and red[128] == 224
    assert rows(I.clipping(df), "bx", "by", "kind") == [(0, 0, 1), (3, 3, 2)]
    board = np.where((np.indices((128, 128)).sum(0) // 4) % 2, 220, 30).astype(np.uint8)
    blur = np.mean([np.roll(board.astype(float), (i, j), (0, 1)) for i in range(-2, 3) for j in range(-2, 3)], 0)
    rgb = lambda a: np.repeat(a[:, :, None], 3, 2)
    assert I.laplacian_variance(rgb(board), 64, 64, 32) > 4 * I.laplacian_variance(rgb(blur), 64, 64, 32)
    assert I.laplacian_variance(rgb(board[:3, :3]), 1, 1, 1) == 0
    half = lambda w, h, s: value(spark, S.patch_half(F.lit(w), F.lit(h), F.lit(s)))
    assert (half(2600, 1733, 3), half(2600, 1733, None), half(2600, 1733, 9), half(200, 100, 1)) == (67, 67, 67, 24)


def test_similarity_fit(spark):
    t, points = 0.3, [(0, 0), (4, 1), (2, 5), (-1, 3), (6, 6)]
    moved = [(2 * (math.cos(t) * x - math.sin(t) * y) + 3, 2 * (math.sin(t) * x + math.cos(t) * y) - 1) for x, y in points]
    df = spark.createDataFrame([(1, float(x), float(y), u, v) for (x, y), (u, v) in zip(points, moved)] + [(2, 1.0, 1.0, 4.0, 6.0)] * 5, "face_id long, x double, y double, u double, v double")
    got = {r["face_id"]: r for r in I.similarity_fit(df, "face_id").collect()}
    assert np.allclose(list(got[1])[1:], [2 * math.cos(t), -2 * math.sin(t), 3, 2 * math.sin(t), 2 * math.cos(t), -1]) and np.allclose(list(got[2])[1:], [1, 0, 3, 0, 1, 5])


def test_eviction(spark):
    data = [("orphan", 100, 0, False), ("a", 100, 100, False), ("b", 100, 200, True), ("c", 100, 200, True)]
    groups = spark.createDataFrame(data, "id string, bytes long, recency long, spared boolean")
    assert rows(C.evictions(groups, 250).filter("evict"), "id") == [("a",), ("orphan",)]


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert [v(S.xmp_rating(F.lit(t))) for t in ('xmp:Rating="4"', "<xmp:Rating>2</xmp:Rating>", 'xmp:Rating="9"', "x")] == [4, 2, None, None]
    assert [v(S.leading_number(F.lit(t))) for t in ("+3 (very high)", " -2", "x", "1.5.2")] == [3.0, -2.0, None, None]
    assert v(S.xml_escaped(F.lit("a<b>&c"))) == "a&lt;b&gt;&amp;c" and v(S.hex_colour(F.lit("#ff0A10"))) == [255, 10, 16] and v(S.hex_colour(F.lit("red"))) is None
    assert [v(S.shutter(F.lit(t))) for t in ("0.004", "2", "1/1100")] == ["1/250s", "2s", "1/1100s"]
    assert [v(S.dynamic_range(F.lit(t))) for t in ("200", "100%", "Auto")] == ["DR200", "Auto (DR100)", "Auto"] and v(S.megabytes(F.lit("3145728"))) == "3.00 MB"
    assert v(S.capture_ms(F.lit("2024:02:29 12:30:45"), F.lit("5"), F.lit(1))) == 1709209845500 and v(S.capture_ms(F.lit("junk"), F.lit(None), F.lit(7))) == 7000
    assert v(S.days_from_civil(F.lit(1970), F.lit(1), F.lit(2))) == 1 and v(S.luma(F.lit(255), F.lit(255), F.lit(255))) == 255
    assert v(S.is_artifact(F.lit("0123456789abcdef-f3r2.jpg"))) and not v(S.is_artifact(F.lit("0123456789abcdef.jpg")))
    assert tuple(v(S.square_crop(F.lit(0.4), F.lit(0.4), F.lit(0.2), F.lit(0.2), F.lit(100), F.lit(100)))) == (35, 35, 30) and tuple(v(S.letterbox(F.lit(1280), F.lit(640)))) == (0.5, 640, 320)
    assert v(S.toggled(F.array(F.lit("a")), F.lit("a"))) == [] and v(S.toggled(F.array(F.lit("a")), F.lit("b"))) == ["a", "b"]
    assert tuple(v(S.glass_time(F.lit(5.0), F.lit(9.0), F.lit(False)))) == (9.0, False) and tuple(v(S.glass_time(F.lit(5.0), F.lit(9.0), F.lit(True)))) == (5.0, True)
    assert v(S.clipping_fingerprint(F.lit(250), F.lit(5), F.array(F.lit(255), F.lit(0), F.lit(0)), F.array(F.lit(0), F.lit(0), F.lit(255)))) == "250-5-[FF, 00, 00]-[00, 00, FF]"
    assert v(rounded_rank(F.array(*[F.lit(float(i)) for i in range(5)]), 0.5)) == 2.0 and v(rounded_rank(F.array().cast("array<double>"), 0.5)) is None
    assert v(C.relative_dir(F.lit("/r/a/b"), F.lit("/r"))) == "a/b" and v(C.relative_dir(F.lit("/x"), F.lit("/r"))) == "/x"
    S.register(spark)
    assert spark.sql("SELECT catalog_kind('a.JPEG'), catalog_stem('x.y.raf'), catalog_name('  Ab '), leading_number('+4 x'), xml_escape('<'), luma(1, 1, 1)").first()[:] == ("jpeg", "x.y", "ab", 4.0, "&lt;", 1)


def test_embedding_codec(spark):
    good, bad = np.arange(128, dtype="<f4").tobytes(), b"123"
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(bad)), (3, None)], "id int, b binary").withColumn("v", S.floats_of("b"))
    got = {r["id"]: r["v"] for r in df.collect()}
    assert got[1][5] == 5.0 and got[2] is None and got[3] is None
    assert bytes(df.filter("id = 1").select(S.blob_of("v").alias("b")).first()["b"]) == good


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.JPG", "b.txt", ".hidden.jpg", "sub/c.raf"):
        (tmp_path / name).write_bytes(b"xx")
    assert rows(files.scan(spark, str(tmp_path)), "name", "size") == [("a.JPG", 2), ("c.raf", 2)]
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/a.json").write_text(DOCUMENT)
    (tmp_path / "meta/b.json").write_text("broken")
    assert sorted(len(r["doc"]) for r in files.metadata(spark, str(tmp_path / "meta")).collect()) == [2, len(DOCUMENT)]
    assert dict(rows(files.settings(spark, "cluster_threshold = 0.7\nhighlight = 999\n")))["cluster_threshold"] == 0.7 and dict(rows(files.settings(spark, "highlight = 999")))["highlight"] == 250.0
    catalog = spark.createDataFrame([("p1", 1, "/old", 3, ["x"], False, True), ("p2", 1, "/gone", 2, None, False, False), ("p3", 1, "/t", 0, None, True, False)], "id string, folder_id long, path string, rating int, tags array<string>, trashed boolean, missing boolean")
    pairs = spark.createDataFrame([("p1", 1, "/new"), ("p9", 1, "/nine")], "id string, folder_id long, primary_path string")
    new = files.upserted(catalog, pairs)
    assert rows(new, "id", "path", "rating", "missing") == [("p1", "/new", 3, False), ("p2", "/gone", 2, True), ("p3", "/t", 0, False), ("p9", "/nine", 0, False)]
    files.write_catalog(new, str(tmp_path / "catalog"))
    files.append_journal(new.select("id"), str(tmp_path / "journal"))
    files.write_report(new.select("id"), str(tmp_path / "report"))
    files.write_sidecars(new, str(tmp_path / "sidecars"))
    assert spark.read.parquet(str(tmp_path / "catalog")).count() == 4 and spark.read.text(str(tmp_path / "sidecars")).filter("value like '%Rating=\"3\"%'").count() == 1


def test_white_space_and_case(spark):
    """Any white space is trimmed; parameters fold ASCII only, names all letters."""
    assert value(spark, S.normalized_name(F.lit("\tÄnna\u2003"))) == "änna" and value(spark, S.normalized_name(F.lit("\n\t"))) is None
    assert value(spark, S.same_text(F.lit("\tVelvia "), F.lit("VELVIA"))) and not value(spark, S.same_text(F.lit("É"), F.lit("é")))
    assert value(spark, S.leading_number(F.lit("\t+2 (high)"))) == 2.0


def test_numbered(spark):
    from shutterlake.sources.shared import numbered

    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k long, v long")
    got = sorted(map(tuple, numbered(df, [F.col("k")], "n", "v", "before").select("n", "k", "v", "before").collect()))
    assert [r[0] for r in got] == list(range(1, 102)) and [r[1] for r in got] == sorted(r[1] for r in got)
    assert all(r[3] == sum(x[2] for x in got[:i]) for i, r in enumerate(got))


def test_recipes_without_parameters(spark):
    docs = spark.createDataFrame([(1, '{"FujiFilm:FilmMode":"Velvia"}'), (2, "{}")], "photo_id long, doc string")
    labels = R.matched(docs, R.rules_frame(spark, [("any", {}), ("velvia", {"film": "velvia"})]))
    assert rows(labels) == [(1, "any", "any,velvia"), (2, "any", "any")]
