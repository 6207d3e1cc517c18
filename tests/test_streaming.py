"""Streams against their batch twins on the same rows."""
import os
import time
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from shutterlake.operators.journal import folded, outbox
from shutterlake.sources.adapters import view
from shutterlake.sources.shared import written
from shutterlake.streaming import streams as L


def stream_of(spark, df, path, files=3):
    df.repartitionByRange(files, "seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(path)
    # one file a batch, in order of seq: the source reads by modification time
    for i, f in enumerate(sorted(Path(path).glob("part-*.parquet"))):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(query_of, checkpoint):
    q = query_of.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def drain_timed(query_of, checkpoint, rows):
    """For queries with timers, which run on without data: stops as soon as all rows are in."""
    q = query_of.option("checkpointLocation", checkpoint).start()
    until = time.monotonic() + 100
    while time.monotonic() < until and sum(p["numInputRows"] for p in q.recentProgress) < rows:
        time.sleep(0.5)
    q.stop()
    assert q.exception() is None


def sorted_rows(df):
    return sorted(map(tuple, df.collect()))


def test_journal_fold(spark, sf, tmp_path):
    commands = view(spark, sf, "commands_v").filter("seq < 400 and folder_id < 3")
    flips = L.journal_flips(stream_of(spark, commands, f"{tmp_path}/in"))
    drain(flips.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append"), f"{tmp_path}/cp")
    out = spark.read.schema(L.FLIPS).parquet(f"{tmp_path}/out")
    state = L.state_of_flips(out)
    assert sorted_rows(state) == sorted_rows(folded(commands).select(state.columns))


class FakeState:
    """A state of transformWithState in memory, which counts reads and writes."""

    def __init__(self):
        self.value, self.map, self.work = None, {}, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.work, self.value = self.work + 1, value

    def getValue(self, key):
        self.work += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.work += 1
        self.map[key] = value

    def removeKey(self, key):
        self.work += 1
        self.map.pop(key, None)


def test_fold_touches_what_a_command_changes():
    """With 10^5 actions in a folder's line, a batch of few commands reads and writes few places."""
    fold = L.Fold()
    fold.line, fold.at = FakeState(), FakeState()

    def batch(commands):
        fold.line.work = 0
        rows = pd.DataFrame([(1, seq, 5, cmd, 2) for seq, cmd in commands], columns=["folder_id", "seq", "photo_id", "cmd", "to_rating"])
        flips = next(fold.handleInputRows((1,), iter([rows]), None))
        return [f[-1] for f in flips.itertuples(index=False)], fold.line.work

    n = 100_000
    states, work = batch([(i, "rate") for i in range(n)])
    assert states == ["live"] * n and work == n
    assert batch([(n, "undo"), (n + 1, "undo"), (n + 2, "redo")]) == (["undone", "undone", "live"], 2)
    assert batch([(n + 3, "rate"), (n + 4, "redo"), (n + 2, "undo")]) == (["late", "cut", "live"], 2)
    assert fold.at.get() == (n, n, n + 4) and len(fold.line.map) == n


def outbox_events(spark, sf):
    kind = F.when(F.col("cmd") == "undo", "error").when(F.col("cmd") == "redo", "rearm").when((F.col("cmd") == "rate") & (F.col("seq") % 4 == 0), "done").otherwise(F.col("cmd"))
    token = F.when(kind == "done", F.col("seq") - F.pmod(F.col("seq"), F.lit(7)))
    photo = F.pmod("photo_id", F.lit(40)).alias("photo_id")
    return view(spark, sf, "commands_v").filter("seq < 600").select(photo, "seq", kind.alias("kind"), F.col("to_rating").alias("rating"), F.concat(F.lit("t"), "seq").alias("tags"), token.alias("token")).dropDuplicates(["photo_id", "seq"])


def test_outbox_state(spark, sf, tmp_path):
    """After every batch the sink's table is the batch outbox of all events so far, and each batch writes its own changes only."""
    events = written(outbox_events(spark, sf), "outbox-events")
    stream = stream_of(spark, events, f"{tmp_path}/in", 4)
    drain(L.outbox_changes(stream).writeStream.outputMode("update").foreachBatch(L.outbox_sink(f"{tmp_path}/jobs")), f"{tmp_path}/cp")
    changes = spark.read.parquet(f"{tmp_path}/jobs")
    files = sorted(Path(f"{tmp_path}/in").glob("part-*.parquet"))
    assert changes.filter("not open").count() and len(files) == 4
    for i in range(len(files)):
        want = outbox(spark.read.parquet(*map(str, files[: i + 1])))
        assert sorted_rows(L.open_jobs(changes.filter(F.col("batch") <= i)).select(want.columns)) == sorted_rows(want)
        assert changes.filter(F.col("batch") == i).count() <= spark.read.parquet(str(files[i])).select("photo_id").distinct().count()


def test_changes_before_membership(spark, tmp_path):
    """A photo that enters a filter has its earlier changes given out then, once; one that leaves has later ones held."""
    changes = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c"), (1, 5, "d"), (1, 7, "e"), (3, 8, "f"), (1, 10, None)], "photo_id long, seq long, change string")
    members = spark.createDataFrame([(1, 4, True), (1, 6, False), (3, 0, True), (1, 9, True), (1, 2, False)], "photo_id long, seq long, inside boolean")
    for files in (1, 3):
        q = L.live_changes(stream_of(spark, changes, f"{tmp_path}/c{files}", files), stream_of(spark, members, f"{tmp_path}/m{files}", files))
        drain(q.writeStream.format("memory").queryName(f"live_changes_{files}").outputMode("append"), f"{tmp_path}/cp{files}")
        assert sorted_rows(spark.table(f"live_changes_{files}")) == [(1, 1, "a"), (1, 3, "b"), (1, 5, "d"), (1, 7, "e"), (1, 10, ""), (3, 8, "f")]


def test_latency_and_filters(spark, sf, tmp_path):
    samples = view(spark, sf, "perf_v").select("seq", F.col("ts").cast("timestamp").alias("ts"), "latency_ms", "served_from", (F.col("seq") % 3).alias("folder_id"), F.col("seq").alias("photo_id"))
    stream = stream_of(spark, samples, f"{tmp_path}/in")
    q = L.latency_by_minute(stream, "1000 days").writeStream.format("memory").queryName("latency").outputMode("complete")
    drain(q, f"{tmp_path}/cp1")
    got = {r["window"]["start"]: (r["flips"], r["misses"]) for r in spark.table("latency").collect()}
    want = {r["window"]["start"]: (r["flips"], r["misses"]) for r in samples.groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("flips"), F.count_if(F.col("served_from") != "bitmap-cache").alias("misses")).collect()}
    assert got == want
    members = samples.filter("photo_id % 5 = 0").select("photo_id")
    live = L.live_members(L.for_folder(stream, 1), members)
    drain(live.writeStream.format("memory").queryName("live").outputMode("append"), f"{tmp_path}/cp2")
    assert spark.table("live").count() == samples.filter("photo_id % 5 = 0 and folder_id = 1").count()
    drain(L.progress(stream, "1000 days").writeStream.format("memory").queryName("progress").outputMode("complete"), f"{tmp_path}/cp3")
    assert spark.table("progress").select(F.explode("ids")).count() == samples.count()


def test_latency_percentiles(spark, tmp_path):
    samples = spark.createDataFrame([(i, float(i), "bitmap-cache") for i in range(1, 101)], "seq long, latency_ms double, served_from string").withColumn("ts", F.timestamp_seconds(F.lit(60)))
    drain(L.latency_by_minute(stream_of(spark, samples, f"{tmp_path}/in"), "1000 days").writeStream.format("memory").queryName("ranks").outputMode("complete"), f"{tmp_path}/cp")
    row = spark.table("ranks").first()
    assert (row["p50"], row["p95"], row["p99"], row["max_ms"], row["misses"], row["gate"]) == (50, 95, 99, 100, 0, False)


def test_progress_in_fours(spark, tmp_path):
    events = spark.createDataFrame([(1, i, i // 2) for i in range(20)] + [(2, 30 + i, i) for i in range(4)], "folder_id long, seq long, photo_id long")
    drain_timed(L.coalesced(stream_of(spark, events, f"{tmp_path}/in", 1)).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append"), f"{tmp_path}/cp", 24)
    got = spark.read.schema("folder_id long, ids array<long>").parquet(f"{tmp_path}/out").filter("size(ids) = 4")
    assert sorted_rows(got) == [(1, [0, 1, 2, 3]), (1, [3, 4, 5, 6]), (1, [6, 7, 8, 9]), (2, [0, 1, 2, 3])]


def test_guarded_commit(spark, tmp_path):
    columns = "seq long, photo_id long, epoch long, generation string, revision long, mtime long, size long"
    results = spark.createDataFrame([(1, 1, 1, "g", 0, 5, 5), (2, 2, 0, "g", 0, 5, 5), (3, 3, 1, "g", 1, 5, 5), (4, 4, 1, "g", 0, 5, 6), (5, 9, 1, "g", 0, 5, 5)], columns)
    state = spark.createDataFrame([(i, True, 1, "g", 0, 5, 5) for i in (1, 2, 3, 4)], "photo_id long, enabled boolean, epoch long, generation string, revision long, mtime long, size long")
    drain(stream_of(spark, results, f"{tmp_path}/in").writeStream.foreachBatch(L.committing(f"{tmp_path}/out", lambda: state)), f"{tmp_path}/cp")
    assert [(r["photo_id"], r["revision"]) for r in spark.read.parquet(f"{tmp_path}/out/accepted").collect()] == [(1, 1)]
    assert spark.read.parquet(f"{tmp_path}/out/discarded").count() == 4


def test_retries(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, "error"), (1, 2, "error"), (1, 3, "error"), (1, 4, "error"), (2, 5, "error"), (2, 6, "ok"), (2, 7, "error"), (3, 8, "claim")], "photo_id long, seq long, kind string")
    drain_timed(L.retries(stream_of(spark, events, f"{tmp_path}/in", 2)).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append"), f"{tmp_path}/cp", 8)
    out = spark.read.schema(L.RETRIES).parquet(f"{tmp_path}/out").filter("event <> 'due'")
    assert sorted_rows(out.select("photo_id", "event", "attempts")) == [(1, "retry", 1), (1, "retry", 2), (1, "retry", 3), (1, "terminal", 4), (2, "retry", 1), (2, "retry", 1)]
    assert sorted_rows(L.retries_batch(events)) == [(1, 4, True), (2, 1, False), (3, 0, False)]
