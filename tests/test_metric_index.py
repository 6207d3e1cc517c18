"""Cosine pairs by the metric index against all products."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.operators import vectors

SCHEMA = "key long, id long, vector array<double>"


def clustered(spark, n=1200, key=1, dims=12, groups=20, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [(key, 10_000 * key + i, (centres[i % groups] / np.linalg.norm(centres[i % groups]) + spread * rng.normal(size=dims)).tolist()) for i in range(n)]


def all_pairs(rows, least):
    m = vectors.unit([r[2] for r in rows])
    return {(rows[i][0], min(rows[i][1], rows[j][1]), max(rows[i][1], rows[j][1])) for i, j in zip(*np.nonzero(m @ m.T >= least)) if i < j and rows[i][0] == rows[j][0]}


@pytest.mark.parametrize("least", [0.9, 0.5, -0.2])
def test_same_pairs(spark, least):
    rows = clustered(spark, 600) + clustered(spark, 90, key=2) + clustered(spark, 200, key=3, spread=2.0) + [(1, 1, None), (1, 2, [0.0] * 12), (3, 3, None), (2, 4, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r)[:3] for r in vectors.pairs_above(df, least, 60).collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(rows, least)
    assert vectors.pairs_above(df.limit(0), least, 60).count() == 0


def test_block_pairs_are_skipped(spark):
    """On a clustered set most pairs of blocks are ruled out before any product."""
    rows = clustered(spark, 2000)
    df = spark.createDataFrame(rows, SCHEMA)
    cells = vectors.celled(df, df.groupBy("key").agg(F.count("*").alias("n")), 50)
    assert cells.count() == 2000 and cells.groupBy("own").count().agg(F.max("count")).first()[0] <= 100
    kept = {r["kept"]: r["count"] for r in vectors.block_pairs(cells, 0.8).groupBy("kept").count().collect()}
    assert kept[False] > 3 * kept[True]
    got = {tuple(r)[:3] for r in vectors.pairs_above(df, 0.8, 50).collect()}
    assert got == all_pairs(rows, 0.8)


def test_equal_vectors_and_few_pivots(spark):
    rows = [(1, i, [1.0, 0.0]) for i in range(100)] + [(1, 200 + i, [0.0, 1.0]) for i in range(3)]
    got = [tuple(r)[:3] for r in vectors.pairs_above(spark.createDataFrame(rows, SCHEMA), 0.99, 30).collect()]
    assert len(got) == len(set(got)) == 100 * 99 // 2 + 3


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


def test_vectors_are_not_copied_for_pairs_of_blocks(spark):
    """No pair of blocks is ruled out here; four times the rows are four times the bytes of shuffles, not sixteen."""
    rng = np.random.default_rng(5)
    rows = [(1, i, v) for i, v in enumerate(rng.normal(size=(4000, 64)).tolist())]
    took = []
    for n in (1000, 4000):
        before = shuffled(spark)
        found = vectors.pairs_above(spark.createDataFrame(rows[:n], SCHEMA), 0.5, 50)
        got = {tuple(r)[:3] for r in found.collect()}
        took.append(shuffled(spark) - before)
        assert got == all_pairs(rows[:n], 0.5) and len(got) > 0
    assert took[1] < 5 * took[0], took


def test_key_without_pivots(spark):
    """Where the hash of the ids picks no pivot at all, every block meets every other."""
    ids = [r["id"] for r in spark.range(5000).filter(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 30)) >= (1 << 30) / 8).limit(60).collect()]
    rows = [(1, i, r[2]) for i, r in zip(ids, clustered(spark, 60, groups=3))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert vectors.celled(df, df.groupBy("key").agg(F.count("*").alias("n")), 50).filter("far is not null").count() == 0
    assert {tuple(r)[:3] for r in vectors.pairs_above(df, 0.8, 50).collect()} == all_pairs(rows, 0.8) != set()


def test_ids_that_repeat_or_are_missing(spark):
    rows = [(k, i % 40, v) for k, i, v in clustered(spark, 120, groups=3)]
    df = spark.createDataFrame(rows + [(1, None, rows[0][2])], SCHEMA)
    m = vectors.unit([r[2] for r in rows])
    want = sorted((1, rows[i][1], rows[j][1]) for i, j in zip(*np.nonzero(m @ m.T >= 0.8)) if rows[i][1] < rows[j][1])
    assert sorted(tuple(r)[:3] for r in vectors.pairs_above(df, 0.8, 50).collect()) == want != []
