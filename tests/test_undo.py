"""The parallel undo fold against two stacks."""
import random

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import journal, undo


def stacks(commands):
    """What is left of commands (folder_id, seq, photo_id, cmd, to_rating), by two stacks a folder."""
    lanes = {}
    for c in sorted(commands):
        lanes.setdefault(c[0], journal.Lane()).step(c[3], c)
    return sorted([(*a, False) for lane in lanes.values() for a in lane.live] + [(*a, True) for lane in lanes.values() for a in lane.undone])


def drawn(rng, n, acts, undos):
    return ["rate" if rng.random() < acts else "undo" if rng.random() < undos else "redo" for _ in range(n)]


@pytest.mark.parametrize("seed", range(300))
def test_summaries(seed):
    """Ranges cut anywhere, applied one after the other, leave cursor and length as the stacks have them."""
    rng = random.Random(seed)
    commands = drawn(rng, rng.randrange(1, 120), rng.choice([0, 0.05, 0.2, 0.5]), rng.choice([0.3, 0.5, 0.7, 0.9]))
    cuts = sorted({0, len(commands), *[rng.randrange(len(commands) + 1) for _ in range(rng.randrange(6))]})
    lane, cursor, length = journal.Lane(), 0, 0
    for a, b in zip(cuts, cuts[1:]):
        summary = undo.Summary()
        for k in range(a, b):
            summary.step(commands[k])
            lane.step(commands[k], (k,))
        cursor, length = undo.applied(summary.frozen(), cursor, length)
        assert (cursor, length) == (len(lane.live), len(lane.live) + len(lane.undone))


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_many_folders(spark, ranges):
    rng = random.Random(4)
    commands = [(f, s, rng.randrange(9), c, rng.randrange(6)) for f, n in [(1, 400), (2, 3), (3, 1), (-4, 60)] for s, c in enumerate(drawn(rng, n, 0.3, 0.6))]
    df = spark.createDataFrame([*commands, (None, 1, 1, "rate", 1), (1, None, 1, "rate", 1)], "folder_id long, seq long, photo_id long, cmd string, to_rating long").repartition(3)
    assert sorted(map(tuple, journal.folded(df, ranges).collect())) == stacks(commands)
    assert journal.folded(df.limit(0)).count() == 0


def test_one_long_log(spark):
    """10^6 commands of one folder: runs of actions, of undos that reach the bottom, and of redos, over many tasks."""
    n = 1_000_000
    place = F.col("seq")
    # long waves that undo all there is now and then, over short ones that are drawn by hash
    wave = F.pmod(F.xxhash64(place), F.lit(100))
    kind = F.when(F.pmod(place, F.lit(150_000)).between(90_000, 120_000), F.when(wave < 85, "undo").when(wave < 99, "redo").otherwise("rate")).otherwise(F.when(wave < 50, "rate").when(wave < 80, "undo").otherwise("redo"))
    df = spark.range(n).select(F.lit(7).cast("long").alias("folder_id"), F.col("id").alias("seq")).withColumn("photo_id", place % 100).withColumn("cmd", kind).withColumn("to_rating", place % 6)
    got = journal.folded(df, 16)
    rows = sorted(map(tuple, got.collect()))
    want = stacks([tuple(r) for r in df.collect()])
    assert rows == want
    assert len(want) > 1000 and {r[5] for r in want} == {True, False}
