"""Streams: the journal fold, retries, the outbox, progress, live filters, guarded commits, latency.

Order is by seq and versions, not by event time; watermarks only bound the state of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shutterlake.operators.journal import MAX_ATTEMPTS
from shutterlake.operators.metrics import gated

ACTION = "folder_id long, seq long, photo_id long, kind string, to_rating long"
FLIPS = "folder_id long, at long, seq long, photo_id long, kind string, to_rating long, state string"
RETRY_SECONDS = (5, 30, 180)
RETRIES = "photo_id long, event string, attempts int, due_s int"


class Fold(StatefulProcessor):
    """A folder's line of actions by place, its length and the cursor as state. Each command gives the flips that it causes: live, undone, or cut; a command at or below the folder's mark is late and has no effect.

    A command reads and writes the places that it touches only: one for undo and redo, and for an action its own and
    those that it cuts, each of which was added once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.line = handle.getMapState("line", "place long", ACTION)
        self.at = handle.getValueState("at", "cursor long, length long, mark long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        cursor, length, mark = self.at.get() if self.at.exists() else (0, 0, -1)
        held, new, out, stored = {}, set(), [], length

        def action_at(place: int) -> tuple:
            if place not in held:
                held[place] = tuple(self.line.getValue((place,)))
            return held[place]

        for c in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            own = (int(c.folder_id), int(c.seq), int(c.photo_id), c.cmd, int(c.to_rating))
            flip = lambda a, state, at=int(c.seq): out.append((a[0], at, *a[1:], state))
            if c.seq <= mark:
                flip(own, "late")
                continue
            mark = int(c.seq)
            if c.cmd == "undo":
                if cursor:
                    flip(action_at(cursor), "undone")
                    cursor -= 1
            elif c.cmd == "redo":
                if cursor < length:
                    cursor += 1
                    flip(action_at(cursor), "live")
            else:
                for place in range(cursor + 1, length + 1):
                    flip(action_at(place), "cut")
                    new.discard(place)
                cursor += 1
                length = cursor
                held[cursor] = own
                new.add(cursor)
                flip(own, "live")
        for place in sorted(new):
            self.line.updateValue((place,), held[place])
        for place in range(length + 1, stored + 1):
            self.line.removeKey((place,))
        self.at.update((cursor, length, mark))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FLIPS.split(", ")])

    def close(self) -> None:
        pass


def journal_flips(commands: DataFrame) -> DataFrame:
    """The journal fold over a stream of commands, one lane a folder. Needs the RocksDB state store."""
    return commands.select("folder_id", "seq", "photo_id", "cmd", "to_rating").groupBy("folder_id").transformWithStateInPandas(Fold(), FLIPS, "Append", "None")


def state_of_flips(flips: DataFrame) -> DataFrame:
    """The actions that are left after all flips, as the batch fold has them."""
    last = W.partitionBy("folder_id", "seq").orderBy(F.desc("at"))
    rows = flips.filter("state <> 'late'").withColumn("_n", F.row_number().over(last)).filter("_n = 1 and state <> 'cut'")
    return rows.select("folder_id", "seq", "photo_id", "kind", "to_rating", (F.col("state") == "undone").alias("undone"))


class Retry(StatefulProcessor):
    """Failures of a photo since its last success; each has a delay until the next try, the last is final. A claim starts anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tries = handle.getValueState("tries", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        tries, out = (self.tries.get()[0] if self.tries.exists() else 0), []
        for e in events.itertuples(index=False):
            if e.kind in ("ok", "claim"):
                tries = 0
            else:
                tries += 1
                final = tries > len(RETRY_SECONDS)
                if not final:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * RETRY_SECONDS[tries - 1])
                out.append((key[0], "terminal" if final else "retry", tries, None if final else RETRY_SECONDS[tries - 1]))
        self.tries.update((tries,))
        yield pd.DataFrame(out, columns=["photo_id", "event", "attempts", "due_s"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        tries = self.tries.get()[0] if self.tries.exists() else 0
        yield pd.DataFrame([(key[0], "due", tries, 0)] if tries else [], columns=["photo_id", "event", "attempts", "due_s"])

    def close(self) -> None:
        pass


def retries(events: DataFrame) -> DataFrame:
    """(photo_id, event, attempts, due_s) of a stream (photo_id, seq, kind: ok, claim or error): retry, due when its time has come, terminal."""
    return events.groupBy("photo_id").transformWithStateInPandas(Retry(), RETRIES, "Append", "ProcessingTime")


def retries_batch(events: DataFrame) -> DataFrame:
    """(photo_id, attempts, terminal): failures since the last success or claim."""
    own = W.partitionBy("photo_id")
    reset = F.max(F.when(F.col("kind").isin("ok", "claim"), F.col("seq"))).over(own)
    rows = events.withColumn("_r", F.coalesce(reset, F.lit(-1)))
    n = F.count_if((F.col("kind") == "error") & (F.col("seq") > F.col("_r")))
    return rows.groupBy("photo_id").agg(n.cast("int").alias("attempts")).withColumn("terminal", F.col("attempts") > len(RETRY_SECONDS))


def progress(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(window, folder_id, ids): photos with progress, gathered by second."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 second"), "folder_id").agg(F.collect_set("photo_id").alias("ids"))


class Coalesced(StatefulProcessor):
    """A folder's photos with progress, handed on as soon as MOST are gathered, and what is left when a second has passed."""

    MOST, WAIT_MS = 4, 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getListState("ids", "photo_id long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, out = [r[0] for r in self.ids.get()] if self.ids.exists() else [], []
        for photo in pd.concat(list(rows)).sort_values("seq")["photo_id"]:
            if int(photo) not in held:
                held.append(int(photo))
            if len(held) == self.MOST:
                out.append((key[0], held))
                held = []
        self.ids.clear()
        if held:
            self.ids.put([(i,) for i in held])
            if not self.due.exists():
                at = timerValues.getCurrentProcessingTimeInMs() + self.WAIT_MS
                self.handle.registerTimer(at)
                self.due.update((at,))
        yield pd.DataFrame(out, columns=["folder_id", "ids"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.ids.get()] if self.ids.exists() else []
        self.ids.clear()
        self.due.clear()
        yield pd.DataFrame([(key[0], held)] if held else [], columns=["folder_id", "ids"])

    def close(self) -> None:
        pass


def coalesced(events: DataFrame) -> DataFrame:
    """(folder_id, ids) of a stream (folder_id, seq, photo_id): progress in fours, the rest within a second. Needs the RocksDB state store."""
    return events.select("folder_id", "seq", "photo_id").groupBy("folder_id").transformWithStateInPandas(Coalesced(), "folder_id long, ids array<long>", "Append", "ProcessingTime")


def live_members(changes: DataFrame, members: DataFrame) -> DataFrame:
    """Changes of a stream whose photo a filter holds: a join of the stream with a table."""
    return changes.join(members, "photo_id", "left_semi")


def for_folder(events: DataFrame, folder_id: int) -> DataFrame:
    """Events of a folder, and those of none."""
    return events.filter(F.col("folder_id").isNull() | (F.col("folder_id") == folder_id))


def latency_by_minute(samples: DataFrame, late: str = "1 minute") -> DataFrame:
    """(window, flips, p50, p95, p99, max_ms, misses, gate): latency by minute; percentiles approximate here (to 1 in 10,000 ranks), exact in the batch twin."""
    rows = samples.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"))
    rank = lambda p: F.percentile_approx("latency_ms", p, 10000)
    return gated(rows.agg(F.count("*").alias("flips"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.max("latency_ms").alias("max_ms"), F.count_if(F.col("served_from") != "bitmap-cache").alias("misses")))


def committing(path: str, state: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that checks each batch of scan results against the state of that moment, and writes accepted and discarded ones under the batch's number, so that a repeated batch replaces itself."""
    from shutterlake.operators.identity import committed

    def write(batch: DataFrame, number: int) -> None:
        for name, rows in zip(("accepted", "discarded"), committed(batch, state())):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return write


class Outbox(StatefulProcessor):
    """A photo's open job as state. Each batch gives one row for a photo whose job it changed; an event at or below the photo's mark is late and has no effect."""

    def __init__(self, max_attempts: int):
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "open boolean, rating long, tags string, last long, attempts int, mark long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        is_open, rating, tags, last, attempts, mark = self.job.get() if self.job.exists() else (False, None, None, None, 0, None)
        before = (is_open, rating, tags, last, attempts)
        given = lambda v: None if v is None or v != v else v  # noqa: E731  pandas has NaN for null
        for e in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            seq = int(e.seq)
            if mark is not None and seq <= mark:
                continue
            mark = seq
            if e.kind in ("rate", "tags"):
                if not is_open:
                    rating = tags = None
                if e.kind == "rate":
                    rating = None if given(e.rating) is None else int(e.rating)
                else:
                    tags = given(e.tags)
                is_open, last, attempts = True, seq, 0
            elif e.kind == "trash" or e.kind == "done" and (None if given(e.token) is None else int(e.token)) == last:
                is_open, rating, tags, attempts = False, None, None, 0
            elif e.kind == "error" and is_open:
                attempts += 1
            elif e.kind == "rearm":
                attempts = 0
        self.job.update((is_open, rating, tags, last, attempts, mark))
        changed = before != (is_open, rating, tags, last, attempts) and (is_open or before[0])
        status = "error" if attempts >= self.max_attempts else "pending"
        row = (key[0], is_open, rating, tags, last, attempts, status)
        yield pd.DataFrame([row] if changed else [], columns=[c.split()[0] for c in CHANGES.split(", ")]).astype({"rating": "Int64", "job_seq": "Int64"})

    def close(self) -> None:
        pass


CHANGES = "photo_id long, open boolean, rating long, tags string, job_seq long, attempts long, status string"


def outbox_changes(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Changes of open jobs over a stream of outbox events (photo_id, seq, kind, rating, tags, token), as journal.outbox defines them: the job of a photo after a batch that changed it, open false once it is gone. State is one row a photo. Needs the RocksDB state store."""
    return events.select("photo_id", "seq", "kind", "rating", "tags", "token").groupBy("photo_id").transformWithStateInPandas(Outbox(max_attempts), CHANGES, "Update", "None")


def outbox_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of outbox_changes: each batch adds its own changes under its number, so that a repeated batch replaces itself. Nothing that was written before is read."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def open_jobs(changes: DataFrame) -> DataFrame:
    """The open jobs after all changes (batch, ...) of an outbox sink's table: the last one of each photo decides."""
    columns = [c for c in changes.columns if c not in ("photo_id", "batch", "open")]
    last = changes.groupBy("photo_id").agg(F.max_by(F.struct("open", *columns), "batch").alias("c")).filter("c.open")
    return last.select("photo_id", *[F.col(f"c.{c}").alias(c) for c in columns])


class Entering(StatefulProcessor):
    """A photo's membership in a live filter, and the changes that it has not been given out while it is outside, as state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inside = handle.getValueState("inside", "inside boolean, mark long")
        self.held = handle.getListState("held", "seq long, change string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        inside, mark = self.inside.get() if self.inside.exists() else (False, -1)
        held, out, drained = [], [], False
        for e in pd.concat(list(rows)).sort_values(["seq", "inside"], na_position="first").itertuples(index=False):
            seq = int(e.seq)
            if e.change is not None:
                (out if inside else held).append((seq, e.change))
            elif seq > mark:
                mark, inside = seq, bool(e.inside)
                if inside:
                    if not drained and self.held.exists():
                        out += [(int(s), c) for s, c in self.held.get()]
                    drained = True
                    out += held
                    held = []
        if drained:
            self.held.clear()
        if held:
            self.held.appendList(held)
        self.inside.update((inside, mark))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["photo_id", "seq", "change"])

    def close(self) -> None:
        pass


def live_changes(changes: DataFrame, members: DataFrame) -> DataFrame:
    """(photo_id, seq, change): changes of a stream (photo_id, seq, change) of photos that a filter holds, over a stream of its members (photo_id, seq, inside) that come and go.

    Changes of a photo outside are held, and given out when it comes in: what a filter shows is then up to date. A membership
    at or below the photo's last one is late and has no effect. State is a photo's held changes. Needs the RocksDB state store.
    """
    one = changes.select("photo_id", "seq", F.coalesce("change", F.lit("")).alias("change"), F.lit(None).cast("boolean").alias("inside"))
    both = one.unionByName(members.select("photo_id", "seq", F.lit(None).cast("string").alias("change"), "inside"))
    return both.groupBy("photo_id").transformWithStateInPandas(Entering(), "photo_id long, seq long, change string", "Append", "None")
