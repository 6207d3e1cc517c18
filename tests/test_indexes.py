"""Halo tiles, ranks of many groups, the rule index, usable faces and the last error, against plain Python."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.operators import identity, imaging, journal, metrics, rules


@pytest.mark.parametrize("tile", [1, 2, 5, 64])
def test_sharpness_by_tiles(spark, tile):
    rng = np.random.default_rng(1)
    images = {1: rng.integers(0, 256, (23, 17)), 2: rng.integers(0, 256, (2, 9)), 3: rng.integers(0, 256, (64, 65)), 4: np.full((5, 5), 7)}
    rows = [(i, x, y, int(v)) for i, m in images.items() for (y, x), v in np.ndenumerate(m) if (i, x, y) != (1, 8, 8)]
    df = spark.createDataFrame(rows, "photo_id long, x int, y int, val int").repartition(3)
    got = {r["photo_id"]: (r["score"], r["n"]) for r in imaging.sharpness(df, tile=tile).collect()}
    for i, m in images.items():
        lap = m[1:-1, :-2] + m[1:-1, 2:] + m[:-2, 1:-1] + m[2:, 1:-1] - 4.0 * m[1:-1, 1:-1]
        if i == 1:  # a pixel is missing: neither it nor its neighbours are interior
            hole = np.zeros(m.shape, bool)
            hole[8, 7:10] = hole[7:10, 8] = True
            lap = lap[~hole[1:-1, 1:-1]]
        assert got[i][1] == lap.size and math.isclose(got[i][0], lap.var() if lap.size else 0.0, abs_tol=1e-6)
    assert imaging.sharpness(df.limit(0)).count() == 0


def test_rows_a_pixel(spark):
    """A large raster: at most 1.1 rows a pixel go to tiles."""
    side = 300
    df = spark.range(side * side).select(F.lit("a").alias("photo_id"), (F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y"), F.pmod(F.xxhash64("id"), F.lit(256)).alias("val"))
    assert imaging.tiled(df, "val").count() <= 1.1 * side * side
    m = np.array([r["val"] for r in df.orderBy("y", "x").collect()], float).reshape(side, side)
    lap = m[1:-1, :-2] + m[1:-1, 2:] + m[:-2, 1:-1] + m[2:, 1:-1] - 4.0 * m[1:-1, 1:-1]
    score, n = imaging.sharpness(df).select("score", "n").first()
    assert n == lap.size and math.isclose(score, lap.var(), rel_tol=1e-9)


@pytest.mark.parametrize("bins", [3, 1024])
def test_rounded_ranks(spark, bins):
    rng = random.Random(3)
    groups = {"a": [rng.gauss(0, 1) for _ in range(501)], "b": [rng.choice([1.0, 2.0, 1e300, -1e308]) for _ in range(200)], "c": [5.0], "d": [1.0] * 90 + [2.0], None: [float(i) for i in range(40)], "e": [math.exp(rng.uniform(-300, 300)) for _ in range(300)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("c", None), ("c", float("nan")), ("f", None)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(3)
    ps = [0.0, 0.05, 0.5, 0.99, 1.0]
    got = {(r["key"], r["p"]): (r["n"], r["value"]) for r in metrics.rounded_ranks(df, ps, bins, 10).collect()}
    assert got == {(k, p): (len(vs), sorted(vs)[math.floor(p * (len(vs) - 1) + 0.5)]) for k, vs in groups.items() for p in ps}
    assert metrics.rounded_ranks(df.limit(0), ps).count() == 0


def test_rounded_ranks_of_a_large_group(spark):
    n = 3_000_000
    df = spark.range(n).select(F.when(F.col("id") < n - 10, "all").otherwise("few").alias("key"), (F.pmod(F.col("id") * 7919, F.lit(n)) / 8).alias("value"))
    got = {(r["key"], r["p"]): r["value"] for r in metrics.rounded_ranks(df, [0.5, 0.9]).collect()}
    few = {(i * 7919) % n for i in range(n - 10, n)}
    rest = sorted(set(range(n)) - few)
    assert [got["all", p] for p in (0.5, 0.9)] == [rest[math.floor(p * (len(rest) - 1) + 0.5)] / 8 for p in (0.5, 0.9)]
    assert got["few", 0.5] == sorted(few)[5] / 8


def document(**values):
    import json

    keys = {"film": "FujiFilm:FilmMode", "color": "FujiFilm:Saturation", "shadow": "FujiFilm:ShadowTone"}
    return json.dumps({keys[k]: v for k, v in values.items()})


def test_rule_index(spark):
    """Texts, numbers, ranges of all sizes and recipes of several parameters, against each rule on each document."""
    rng = random.Random(2)
    recipes = [("none", {})]
    for i in range(150):
        pins = {}
        for p in rng.sample(["film", "color", "shadow"], rng.randrange(1, 4)):
            low = rng.choice([rng.randrange(-5, 5), rng.uniform(-5, 5)])
            text = rng.choice(["Provia", " VELVIA ", "x"])
            pins[p] = rng.choice([text, low, {"min": low, "max": low + rng.choice([0, 1e-12, 0.3, 4, 1e6, 1e305, float("inf")])}, [text, low, {"min": -1e300, "max": low}], {"min": 3, "max": 1}])
        recipes.append((f"r{i}", pins))
    docs = [(i, document(**{p: rng.choice(["Provia", "velvia", "+3 (x)", str(rng.randrange(-5, 9)), f"{rng.uniform(-6, 9):.3f} (soft)", "1e", "", "-2"]) for p in rng.sample(["film", "color", "shadow"], rng.randrange(4))})) for i in range(80)]
    docs += [(100, "{}"), (101, None), (102, document(color=str(recipes[1][1].get("color", 1))))]

    def number(v):
        import re

        try:
            return float(re.match(r"[+-]?[0-9.]*", v.strip())[0])
        except ValueError:
            return None

    def meets(v, c):
        if isinstance(c, str):
            return v.strip().lower() == c.strip().lower()
        if isinstance(c, list):
            return any(meets(v, x) for x in c)
        n = number(v)
        return n is not None and (c["min"] <= n <= c["max"] if isinstance(c, dict) else abs(n - c) < 1e-9)

    import json

    back = {"FujiFilm:FilmMode": "film", "FujiFilm:Saturation": "color", "FujiFilm:ShadowTone": "shadow"}
    want = {}
    for i, d in docs:
        values = {back[k]: v for k, v in json.loads(d or "{}").items() if v.strip()}
        want[i] = ",".join(name for name, pins in recipes if all(p in values and meets(values[p], c) for p, c in pins.items()))
    found = rules.matched(spark.createDataFrame(docs, "photo_id long, doc string"), rules.rules_frame(spark, recipes))
    got = {r["photo_id"]: r["every"] for r in found.collect()}
    assert got == want and len(set(want.values())) > 10
    index = rules.indexed(rules.rules_frame(spark, recipes))
    assert index.groupBy("ord", "param", "alt").count().agg(F.max("count")).first()[0] <= 2
    assert rules.matched(found.limit(0).select("photo_id", F.lit("").alias("doc")), rules.rules_frame(spark, [])).count() == 0


def test_prototypes_of_usable_scans(spark):
    faces = spark.createDataFrame([(i, i, 7, "user", False, [1.0, i / 10], 0.9) for i in range(4)], "face_id long, photo_id long, person_id long, assigned_by string, ignored boolean, embedding array<double>, det_score double")
    scans = spark.createDataFrame([(0, "ok", "g2"), (1, "stale", "g2"), (2, "ok", "g1")], "photo_id long, status string, model_gen string")
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(identity.prototypes(faces)) == {0, 1, 2, 3} and ids(identity.prototypes(faces, scans=scans)) == {0, 2} and ids(identity.prototypes(faces, scans=scans, generation="g2")) == {0}


def test_last_error(spark):
    events = [(1, 1, "rate", 3, None)] + [(1, 1 + i, "error", None, f"disk {i}" if i != 5 else None) for i in range(1, 6)] + [(2, 20, "rate", 1, None), (2, 21, "error", None, "once")] + [(3, 30, "tags", None, None)] + [(3, 30 + i, "error", None, None) for i in range(1, 6)]
    df = spark.createDataFrame([(p, s, k, r, "t", None, e) for p, s, k, r, e in events], "photo_id long, seq long, kind string, rating long, tags string, token long, error string")
    jobs = journal.outbox(df)
    assert {r["photo_id"]: r["last_error"] for r in jobs.collect()} == {1: "disk 4", 2: "once", 3: None}
    assert tuple(journal.queue_status(jobs).first()) == (1, 2, 30, "disk 4")
    assert "last_error" not in journal.queue_status(journal.outbox(df.drop("error"))).columns
