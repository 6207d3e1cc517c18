"""Undo and redo of logs of any length: a folder's log is cut in ranges that are folded in parallel.

A folder's history is a line of actions with a cursor: what is before it is live, what is after
it is undone. undo and redo move the cursor, within the line; an action cuts the line at the cursor,
and goes there. So an action at place p stays if no later action goes to p or before it, and it is live if
p is not beyond the last cursor.

1. Each range is summed up as a function of the cursor and the line's length before it (Summary).
2. The summaries of a folder are applied in order, one number pair after the other.
3. Each range is played from its own cursor and gives its actions' places.
4. Later ranges' least places and the folder's last cursor decide what stays and what is live.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from shutterlake.sources.shared import written


class Runs:
    """For each length n = 1, 2, ... a bit, held as runs of ones, the lowest run last.

    The cursor after some undos and redos, started at the end of a line of length n, is n minus the number of ones
    up to n. An undo sets the lowest zero: the cursor moves but for lines that it has left already. A
    redo clears the lowest one. Both touch the lowest run only.
    """

    def __init__(self, all_ones: bool = False):
        self.runs: list[list[float]] = [[1, float("inf")]] if all_ones else []  # first and last one of each run

    def undo(self) -> None:
        runs = self.runs
        if not runs or runs[-1][0] > 1:
            runs.append([1, 1])
        else:
            runs[-1][1] += 1
        if len(runs) > 1 and runs[-1][1] + 1 == runs[-2][0]:
            first = runs.pop()[0]
            runs[-1][0] = first

    def redo(self) -> None:
        if self.runs:
            low = self.runs[-1]
            low[0] += 1
            if low[0] > low[1]:
                self.runs.pop()

    def frozen(self) -> tuple[list[float], list[float], list[float]]:
        """First and last one of each run, the lowest first, and the ones before each."""
        first, last = [a for a, _ in reversed(self.runs)], [b for _, b in reversed(self.runs)]
        before, total = [], 0.0
        for a, b in zip(first, last):
            before.append(total)
            total += b - a + 1
        return first, last, before


def zeros(frozen: tuple, n: int) -> int:
    """How many bits up to n are zero."""
    first, last, before = frozen
    k = bisect_right(first, n) - 1
    return n if k < 0 else int(n - before[k] - (min(n, last[k]) - first[k] + 1))


class Summary:
    """A range of commands as a function of (cursor, length) before it.

    Up to the first action the length is fixed, and undos and redos together are a shift between two bounds: where the
    lowest and the highest cursor end. An action makes the length the cursor plus one, so from there on all hangs on the
    cursor d at the first action alone. The length after the last action is a rising function of d: it grows by one with d
    but for some d, the flats. Flats are where an undo found nothing live.
    """

    def __init__(self) -> None:
        self.shift, self.low, self.high = 0, Runs(all_ones=True), Runs()
        self.acted = False
        self.base, self.flats = 0, []  # the length after the last action for d = 0; where it does not grow
        self.tail = Runs()

    def step(self, command: str) -> None:
        if command in ("undo", "redo"):
            if self.acted:
                getattr(self.tail, command)()
            else:
                self.shift += -1 if command == "undo" else 1
                getattr(self.low, command)()
                getattr(self.high, command)()
        elif not self.acted:
            self.acted, self.base = True, 1
        else:
            self._close()

    def _close(self) -> None:
        """An action after the tail: the new length is the cursor there plus one."""
        first, last, _ = frozen = self.tail.frozen()
        flats, base = self.flats, self.base
        taken = []
        for a, b in zip(first, last):
            # the j-th growth leads to the length base + j: it is lost if that length has a one
            for j in range(max(1, int(a) - base), int(b) - base + 1):
                # the j-th d that is no flat
                lo, hi = 0, len(flats)
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if flats[mid] - mid <= j else (lo, mid)
                taken.append(j + lo)
        self.base = zeros(frozen, base) + 1
        if taken:
            self.flats = sorted([*flats, *taken])
        self.tail = Runs()

    def frozen(self) -> bytes:
        return pickle.dumps((self.shift, self.low.frozen(), self.high.frozen(), self.acted, self.base, self.flats, self.tail.frozen()))


def applied(summary: bytes, cursor: int, length: int) -> tuple[int, int]:
    """(cursor, length) after a range."""
    shift, low, high, acted, base, flats, tail = pickle.loads(summary)
    cursor = min(zeros(high, length), max(zeros(low, length), cursor + shift)) if length else 0
    if acted:
        length = base + cursor - bisect_right(flats, cursor)
        cursor = zeros(tail, length)
    return cursor, length


class Played:
    """A range played from a cursor: the actions that its own later ones leave, with their places."""

    def __init__(self, cursor: int, length: int):
        self.cursor, self.length, self.line = cursor, length, []

    def step(self, command: str, action: tuple) -> None:
        if command == "undo":
            self.cursor = max(0, self.cursor - 1)
        elif command == "redo":
            self.cursor = min(self.length, self.cursor + 1)
        else:
            self.cursor = self.length = self.cursor + 1
            while self.line and self.line[-1][0] >= self.cursor:
                self.line.pop()
            self.line.append((self.cursor, action))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The rows of each (folder_id, part) in a stream sorted by these."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    row = next(rows, None)
    while row is not None:
        key = row[:2]

        def own() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[:2] == key:
                yield row
                row = next(rows, None)

        part = own()
        yield key, part
        for _ in part:
            pass


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)


def parallel_fold(commands: DataFrame, ranges: int | None = None) -> DataFrame:
    """(folder_id, seq, photo_id, kind, to_rating, undone): the actions that are left of commands (folder_id, seq, photo_id, cmd, to_rating).

    undo and redo move the cursor of their folder, any other command is an action. Commands of one folder and
    seq go by photo_id, cmd, to_rating; those without a folder_id or a seq have no place in a log and are left out. A task holds the summary or the surviving actions of one range; a folder's summaries
    pass one task one after the other. ranges: of all commands, as many as Spark chooses by default.
    """
    order = ["folder_id", "seq", "photo_id", "cmd", "to_rating"]
    rows = commands.select(*order).filter("folder_id is not null and seq is not null")
    rows = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    log = written(rows.withColumn("part", F.spark_partition_id()), "commands")
    ordered = lambda df: df.repartition("folder_id", "part").sortWithinPartitions("folder_id", "part", *order[1:]).select("folder_id", "part", *order[1:])
    parts = log.groupBy("folder_id", "part").agg(F.count("*").alias("n"))
    # a folder within one range starts at zero; only the others' ranges are summed up
    long = parts.groupBy("folder_id").agg(F.count("*").alias("n")).filter("n > 1").select("folder_id")
    sums_schema = pa.schema([("folder_id", pa.int64()), ("part", pa.int32()), ("summary", pa.binary())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for key, own in _ranges(batches):
                s = Summary()
                for row in own:
                    s.step(row[4])
                yield *key, s.frozen()

        yield from _batches(rows(), sums_schema, 16)

    starts_schema = pa.schema([("folder_id", pa.int64()), ("part", pa.int32()), ("cursor", pa.int64()), ("length", pa.int64()), ("last", pa.int64())])

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            folder, cursor, length = object(), 0, 0
            for batch in batches:
                for f, part, summary in zip(*[c.to_pylist() for c in batch.columns]):
                    if f != folder:
                        folder, cursor, length = f, 0, 0
                    before = cursor, length
                    cursor, length = applied(summary, cursor, length)
                    yield f, part, *before, cursor

        yield from _batches(rows(), starts_schema)

    sums = ordered(log.join(long, "folder_id", "left_semi")).mapInArrow(summed, "folder_id long, part int, summary binary")
    starts = written(sums.repartition("folder_id").sortWithinPartitions("folder_id", "part").mapInArrow(started, "folder_id long, part int, cursor long, length long, last long"), "starts")
    played_schema = pa.schema([("folder_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("photo_id", pa.int64()), ("kind", pa.string()), ("to_rating", pa.int64()), ("place", pa.int64()), ("cursor", pa.int64())])

    def played(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for key, own in _ranges(batches):
                p = None
                for row in own:
                    p = p or Played(row[6] or 0, row[7] or 0)
                    p.step(row[4], row[2:6])
                for place, action in p.line:
                    yield *key, *action, place, p.cursor

        yield from _batches(rows(), played_schema)

    from_start = log.join(starts.select("folder_id", "part", "cursor", "length"), ["folder_id", "part"], "left")
    again = from_start.repartition("folder_id", "part").sortWithinPartitions("folder_id", "part", *order[1:]).select("folder_id", "part", *order[1:], "cursor", "length")
    placed = written(again.mapInArrow(played, "folder_id long, part int, seq long, photo_id long, kind string, to_rating long, place long, cursor long"), "placed")
    # one row a range: the least place of later ranges, and where the folder's cursor ends
    later = W.partitionBy("folder_id").orderBy("part").rowsBetween(1, W.unboundedFollowing)
    least = placed.groupBy("folder_id", "part").agg(F.min("place").alias("least"))
    bounds = starts.join(least, ["folder_id", "part"], "left").select("folder_id", "part", F.min("least").over(later).alias("cut"), F.last("last").over(W.partitionBy("folder_id").orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("end"))
    left = placed.join(bounds, ["folder_id", "part"], "left").filter(F.col("cut").isNull() | (F.col("place") < F.col("cut")))
    return left.select("folder_id", "seq", "photo_id", "kind", "to_rating", (F.col("place") > F.coalesce("end", "cursor")).alias("undone"))
