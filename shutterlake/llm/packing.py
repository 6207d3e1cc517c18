"""Operator 2: best-fit packing by a linear grouping scheme.

The number of pieces of each length, at most CAPACITY numbers whatever the input, is
all that the plan needs. Large lengths are rounded up within groups of equal
cardinality; over these few sizes the best configurations of a sequence follow from
linear programming by column generation; actual pieces then take the places of the rounded
sizes, and the rest, small ones above all, goes best-fit into the room that is left.
The plan is a table of runs: so many pieces of one length, by their rank, go to so many
consecutive sequences at one offset. Spark ranks the pieces and looks their runs up.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import table, written

CAPACITY = 2048
#: Lengths above this share of the capacity are large.
LARGE = 0.4
GROUPS = 256
TOKENIZER = "byte_bpe_50k.json"
SEPARATOR = 0
#: Characters of a text that the fast way gets at once, and the most without a safe cut before the tokenizers library takes them.
PART, MOST = 50_000, 100_000
#: A place between two tokens whatever stands around it: a space between two characters that surely are no white space.
SAFE_CUT = re.compile("(?<=[!-~\u00c0-\u06ff])(?= [!-~\u00c0-\u06ff])")
# fixed value: how byte-level BPE parts a text before merging
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts_of(text: str) -> Iterator[str]:
    """The text in parts of about PART characters, cut where tokens part; a part is longer where there is no safe cut."""
    at = 0
    while len(text) - at > MOST:
        found = SAFE_CUT.search(text, at + PART)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def as_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizers file as merge ranks, if it is a plain byte-level BPE whose merges have the order of their ids; None for any other."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"] for t in spec["added_tokens"]}
    words = sorted((i, token) for token, i in model["vocab"].items() if token not in special)
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if [token for _, token in words[256:]] != merged or any(len(token) > 1 for _, token in words[:256]):
        return None
    return {bytes(byte_of[c] for c in token): i for i, token in words}


@lru_cache(maxsize=1)
def encoder(path: str) -> Callable[[str], list[int]]:
    """A function from text to the ids that the tokenizers library gives without added special tokens.

    Where as_ranks() has found that the file fits, tiktoken runs the same merges four times as fast.
    It gets short parts only: its regular expressions recurse, and fail on a long run of white
    space. Parts that cannot be cut, and parts with the string of a special token, go through tokenizers.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    whole = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))  # loaded if a text needs it
    slow = lambda text: whole().encode(text, add_special_tokens=False).ids
    ranks, special = as_ranks(spec), [t["content"] for t in spec["added_tokens"]]
    if ranks is None:
        return slow
    import tiktoken

    fast = tiktoken.Encoding("byte-bpe", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def encode(text: str) -> list[int]:
        if len(text) > MOST:
            return [i for part in parts_of(text) for i in (encode(part) if len(part) <= MOST else slow(part))]
        return slow(text) if any(s in text for s in special) else fast(text)

    return encode


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each row of docs (doc_id, text), whose ids end with SEPARATOR.

    Only longer documents than capacity are cut; their first piece is the shorter one. A
    null text is empty and so one piece of one id. A null doc_id stays null. Repeated rows are
    cut each for itself; other columns are left out, whatever their names; an empty table gives none.
    """
    path = path or tokenizer_path()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            rows = []
            for doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                ids = np.array([*encode(text or ""), SEPARATOR], "<u4")
                ends = [*range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [len(ids)]
                for piece, (a, b) in enumerate(zip([0, *ends], ends)):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(told, "doc_id long, piece int, start long, length long, ids_crc32 long")


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths in groups of equal cardinality, largest first: (the largest of a group, which all its members are rounded up to, its (length, count) pairs)."""
    size = -(-sum(counts.values()) // groups)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = size
            n = min(left, room)
            out[-1][1].append((length, n))
            left, room = left - n, room - n
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each size a sequence holds) and how often to use each: the linear program's optimum, by column generation with a bounded knapsack for pricing."""
    k = len(sizes)
    base = np.diag([float(min(capacity // s, d)) for s, d in zip(sizes, demand)])
    use = np.array(demand, float) / base.diagonal()
    for _ in range(rounds):
        price = np.linalg.solve(base.T, np.ones(k))
        best, taken = np.zeros(capacity + 1), []
        for i, s in enumerate(sizes):
            copies = np.zeros(capacity + 1, np.int16)
            if price[i] > 1e-12:
                now = best.copy()
                for n in range(1, min(capacity // s, demand[i]) + 1):
                    better = best[: capacity + 1 - n * s] + n * price[i]
                    gain = better > now[n * s :] + 1e-12
                    now[n * s :][gain] = better[gain]
                    copies[n * s :][gain] = n
                best = now
            taken.append(copies)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for i in range(k - 1, -1, -1):
            column[i] = taken[i][room]
            room -= int(column[i]) * sizes[i]
        step = np.linalg.solve(base, column)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
        base[:, out] = column
    return [(base[:, i].astype(int), float(use[i])) for i in range(k)]


def planned(counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, end rank, first sequence, offset) that place counts[length] pieces of each length, and the number of sequences."""
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    rooms: list[tuple[int, int, int]] = []  # (room left, first sequence, how many), sorted
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, first, offset))
        used[length] += n

    large_counts = {length: n for length, n in counts.items() if length > large * capacity}
    grouped = linear_groups(large_counts, groups) if large_counts else []
    by_size: dict[int, list[list[int]]] = {}
    for size, members in grouped:
        by_size.setdefault(size, []).extend([list(m) for m in members])
    sizes = sorted(by_size, reverse=True)
    if sizes:
        demand = [sum(n for _, n in by_size[s]) for s in sizes]
        for column, use in configurations(sizes, demand, capacity):
            often, slots = int(use + 1e-6), [s for s, n in zip(sizes, column) for _ in range(n)]
            often = min([often, *[sum(n for _, n in by_size[s]) // slots.count(s) for s in set(slots)]])
            while often > 0:
                # as many sequences as have the same actual lengths in all slots
                want: dict[tuple[int, int], int] = {}
                picks = []
                for s in slots:
                    at = next(i for i, m in enumerate(by_size[s]) if m[1] > want.get((s, i), 0))
                    want[s, at] = want.get((s, at), 0) + 1
                    picks.append((s, at))
                n = min([often, *[by_size[s][i][1] // w for (s, i), w in want.items()]])
                offset = 0
                for s, i in picks:
                    put(by_size[s][i][0], n, sequences, offset)
                    offset += by_size[s][i][0]
                for (s, i), w in want.items():
                    by_size[s][i][1] -= n * w
                insort(rooms, (capacity - offset, sequences, n))
                sequences, often = sequences + n, often - n
    # best fit, longest first: what the whole configurations left over, then the small ones
    for length in sorted(counts, reverse=True):
        left = counts[length] - used[length]
        while left:
            at = bisect_left(rooms, (length, -1, -1))
            if at == len(rooms):
                fits = capacity // length
                n = max(1, left // fits)
                rooms.append((capacity, sequences, n))
                sequences += n
                continue
            room, first, n = rooms.pop(at)
            fits = min(room // length, left)
            some = min(n, left // fits)
            for i in range(fits):
                put(length, some, first, capacity - room + i * length)
            left -= some * fits
            if room - fits * length:
                insort(rooms, (room - fits * length, first, some))
            if some < n:
                insort(rooms, (room, first + some, n - some))
    return runs, sequences


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs (doc_id, text).

    Pieces of a sequence follow each other from 0 without gaps. Repeated rows are packed as often as they
    occur, rows without a doc_id too; null, empty and very long texts and other columns as in cut(). An empty table gives none.
    """
    spark = docs.sparkSession
    # each row has a number of its own, so that rows which share a doc_id spread over the parts
    pieces = written(cut(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs, _ = planned(counts, capacity)
    # n pieces of one length are ranked in sqrt(n) parts, whose sizes are then added up: at most capacity rows to broadcast
    parts = spark.createDataFrame([(length, math.isqrt(n) + 1) for length, n in counts.items()], "length long, parts long")
    rows = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("length", "part").orderBy("row")) - 1
    rows = rows.withColumn("rank", rank).join(starts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    places = spark.createDataFrame(runs, "of_length long, from_rank long, to_rank long, first long, offset long")
    # its size hangs on the capacity alone: some thousand runs
    rows = rows.join(F.broadcast(places), (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
