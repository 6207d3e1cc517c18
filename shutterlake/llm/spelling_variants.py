"""Operator 13: spelling variants by a variable-length gram index.

Two words are near if they differ by exactly one inserted, deleted or replaced code
point. Steps:

1. Words of whole texts are counted, with map-side sums of bounded size.
2. A gram dictionary is built from the distinct words: every gram of two code points, and a
   longer one where its own beginning is frequent. PARENTS bounds how many grams of a
   length may be frequent, so the dictionary is bounded whatever the input.
3. A word is decomposed: at each place the longest gram of the dictionary, unless an
   earlier one covers it. One edit leaves all grams alike but some whose ends lie within
   `longest` code points after it, so a word has a bound of its own on its affected grams, and
   two near words have at least `needed` grams in common.
4. A gram before the edit stands behind the same text in both words, one after it before the same text. An edit
   is in a word's first half or in its second. So a word is listed under the last of its grams that ends in the
   first half and under the first gram that the first half cannot cover, each with all
   text on its outer side; for its own length, and for that of a partner that is shorter by one.
5. Within a list, the words' other grams are inverted lists. They nest, outside in, so those that
   surely hold all partners with enough common grams are few and short; pairs from these are
   verified. A list longer than a block is searched block by block.

Words have at least 2 * longest + 1 code points, so that every word keeps a gram and none needs another way.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import dropped, table, written

#: A run of letters; runs shorter than a word has to be are never seen, since a run is matched as a whole.
LETTERS = "A-Za-zÀ-ÿ"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIN_LENGTH, MIN_COUNT, RATIO, NOISE = 7, 2, 10, 31
SHORTEST, LONGEST = 2, 3
#: Frequent grams of one length, at most.
PARENTS = 4096
#: Entries of a task's own sums before they go on.
HELD = 200_000
#: Words of one list that are searched at once; lists of at most FEW words are verified outright.
BLOCK, FEW = 4096, 12


def noisy(doc_id: int | None, run: str, noise: int = NOISE) -> str:
    """The run, without one code point if its hash with the document's id is a multiple of noise. A null id is the empty text."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode("utf-8", "replace"))
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def sums(total: Counter, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], [name, "n"])


def counted_words(docs: DataFrame, min_length: int = MIN_LENGTH, noise: int = NOISE) -> DataFrame:
    """(word, n): how often each word of docs (doc_id, text) occurs in all; null texts have none, repeated rows count each for itself."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]{{{min_length},}}")
        total: Counter[str] = Counter()

        for batch in batches:
            for doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                own: Counter[str] = Counter()
                for run, n in Counter(runs.findall(text or "")).items():
                    own[run.lower() if run.isascii() else run.translate(UPPER)] += n
                for run, n in own.items():
                    word = noisy(doc_id, run, noise)
                    if len(word) >= min_length:
                        total[word] += n
                if len(total) >= HELD:
                    yield sums(total, "word")
                    total.clear()
        if total:
            yield sums(total, "word")

    return docs.select("doc_id", "text").mapInArrow(told, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Grams:
    """A prefix-closed gram dictionary: grams of SHORTEST code points, and one more for as long as the gram so far is frequent."""

    def __init__(self, frequent: set[str], longest: int = LONGEST):
        self.longest, self.frequent = longest, frequent

    def of(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the word's grams: at each place the longest one, unless an earlier one covers it. Ends rise."""
        out, covered, size, longest, frequent = [], 0, len(word), self.longest, self.frequent
        for start in range(size - SHORTEST + 1):
            end = start + SHORTEST
            while end < size and end - start < longest and word[start:end] in frequent:
                end += 1
            if end > covered:
                out.append((start, end))
                covered = end
        return out

    def affected(self, ends: list[int]) -> int:
        """The most grams that one edit can change.

        An edit before or at code point i changes grams that reach over it, which end after i, and may make a
        new gram from i on that covers the next ones, up to i + longest: never more than the ends in (i, i + longest].
        """
        most = first = 0
        for at, end in enumerate(ends):
            while ends[first] <= end - self.longest:
                first += 1
            most = max(most, at - first + 1)
        return most

    def outer(self, grams: list[tuple[int, int]], size: int, length: int) -> tuple[int, int]:
        """(code points of the head, of the tail) under which a word of size code points meets words of length and length + 1, the shorter one's first half being length // 2 long.

        An edit in the second half leaves all grams that end in the first half. One in the first half leaves those that
        begin in the second half and end so far in it that no gram from the first half covers them.
        """
        half = size - length + length // 2
        head = max(end for _, end in grams if end <= length // 2)
        tail = size - min(start for start, end in grams if start >= half and end >= half + self.longest)
        return head, tail


def dictionary(words: DataFrame, longest: int = LONGEST, parents: int = PARENTS) -> Grams:
    """The gram dictionary of words (word). Only frequent grams reach the driver, parents of each length at most: others are dropped before."""
    frequent: set[str] = set()
    threshold, last = 0, None
    for size in range(SHORTEST, longest):
        def told(batches: Iterator[pa.RecordBatch], size: int = size, last: set[str] | None = last) -> Iterator[pa.RecordBatch]:
            total: Counter[str] = Counter()
            for batch in batches:
                for word in batch.column(0).to_pylist():
                    every = [word[i : i + size] for i in range(len(word) - size + 1)]
                    total.update(every if last is None else [g for g in every if g[:-1] in last])
                    if len(total) >= HELD:
                        yield sums(total, "gram")
                        total.clear()
            if total:
                yield sums(total, "gram")

        counts = words.select("word").mapInArrow(told, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        if size == SHORTEST:
            counts = written(counts, "grams")
            threshold = -(-(counts.agg(F.sum("n")).first()[0] or 0) // parents)
        last = {r["gram"] for r in counts.filter(F.col("n") > threshold).collect()}
        frequent |= last
    return Grams(frequent, longest)


def packed(numbers: list[int]) -> bytes:
    """Numbers as bytes, or as four bytes each if one is larger; a leading byte says which."""
    return b"\1" + bytes(numbers) if not numbers or max(numbers) < 256 else b"\4" + b"".join(n.to_bytes(4, "little") for n in numbers)


def unpacked(data: bytes) -> list[int]:
    return list(data[1:]) if data[0] == 1 else [int.from_bytes(data[i : i + 4], "little") for i in range(1, len(data), 4)]


def listed(words: DataFrame, grams: Grams, min_length: int = MIN_LENGTH) -> DataFrame:
    """(key, place, word, n, longer, needed, ends, starts, head, tail): each word of words (word, n) once for each list that it is in.

    place: the list's head length, or minus its tail length; longer: whether the list is for words shorter by one; needed: grams in
    common with a near word, at least; ends, starts: of all its grams; head, tail: the lengths of both lists for these lengths of words.
    """
    shared = words.sparkSession.sparkContext.broadcast(grams)
    names = ["key", "place", "word", "n", "longer", "needed", "ends", "starts", "head", "tail"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            rows = []
            for word, n in zip(*[c.to_pylist() for c in batch.columns]):
                own, size = g.of(word), len(word)
                ends = [b for _, b in own]
                needed, parts = len(own) - g.affected(ends), (packed(ends), packed([a for a, _ in own]))
                for length in (size, size - 1) if size > min_length else (size,):
                    head, tail = g.outer(own, size, length)
                    more = (word, n, length < size, needed, *parts, head, tail)
                    rows += [(f"{length}:{word[:head]}-", head, *more), (f"{length}:-{word[size - tail:]}", -tail, *more)]
                if len(rows) >= 50_000:
                    yield given(rows)
                    rows = []
            if rows:
                yield given(rows)

    return words.select("word", "n").mapInArrow(told, "key string, place int, word string, n long, longer boolean, needed int, ends binary, starts binary, head int, tail int").withColumn("key", F.xxhash64("key"))


def near(a: str, b: str, alike: int = 0) -> bool:
    """Whether b is a with one code point replaced or inserted. alike: how many are known to be alike from the start."""
    n, i = len(a), alike
    while i < n and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(b) > n else i < n and a[i + 1 :] == b[i + 1 :]


class Listed:
    """A word in a list, as its grams are needed for the search."""

    __slots__ = ("word", "n", "longer", "needed", "ends", "starts", "head", "tail", "own", "place")

    def __init__(self, row: tuple):
        _, _, self.word, self.n, self.longer, self.needed, ends, starts, self.head, self.tail, self.own, self.place = row
        self.ends, self.starts = unpacked(ends), unpacked(starts)


def candidates(rows: list[Listed]) -> Iterator[tuple[Listed, Listed]]:
    """Pairs of a list's words that have enough grams in common, two of the shorter ones or a shorter and a longer one; of two blocks of a long list, pairs of a word of each.

    Grams left of the edit are the word's first ones and have the same text before them; those right of it are the last ones. So
    the inverted lists of a word's heads nest, and those of its tails do: needed grams in common means
    that a partner is in the list of the x-th head and in that of the last tail but (needed - x - 1), for some x. The shorter one of both is taken.
    """
    two = len({r.own for r in rows}) > 1
    apart = lambda a, b: two and a.own == b.own  # noqa: E731  such pairs belong to another task
    if len(rows) <= FEW:
        for i, a in enumerate(rows):
            if not a.longer:
                yield from ((a, b) for j, b in enumerate(rows) if (b.longer or j > i) and not apart(a, b))
        return
    heads, tails = defaultdict(list), defaultdict(list)
    for i, r in enumerate(rows):
        word = r.word
        for x in r.ends:
            heads[word[:x]].append(i)
        for x in r.starts:
            tails[word[x:]].append(i)
    place = rows[0].place
    for i, r in enumerate(rows):
        if r.longer:
            continue
        word, size = r.word, len(r.word)
        # lists from outside in: on this list's side after what all words here share, and on the other side
        if place > 0:
            own, other = [heads[word[:x]] for x in r.ends if x > place], [tails[word[x:]] for x in reversed(r.starts)]
        else:
            own, other = [tails[word[x:]] for x in reversed(r.starts) if size - x > -place], [heads[word[:x]] for x in r.ends]
        left = r.needed - (len(r.ends) - len(own))
        found: set[int] = set()
        if left <= 0:
            found.update(range(len(rows)))
        else:
            found.update(other[left - 1])
            for x, this_side in enumerate(own[:left], 1):
                far_side = other[left - x - 1] if left > x else this_side
                found.update(this_side if len(this_side) < len(far_side) else far_side)
        for j in found:
            b = rows[j]
            if (b.longer or j > i) and not apart(r, b):
                yield r, b


def searched(rows: list[tuple]) -> Iterator[tuple[str, int, int, str]]:
    """(word, n_near, near_n, near) of a list's words. A pair that is in the list of a common head is not given by that of a common tail."""
    best: dict[str, list] = {}
    place = rows[0][-1]
    for a, b in candidates([Listed(r) for r in rows]):
        if near(a.word, b.word, max(0, place)) and (place > 0 or a.head != b.head or a.word[: a.head] != b.word[: a.head]):
            for x, y in ((a, b), (b, a)):
                now = best.setdefault(x.word, [0, y.n, y.word])
                now[0] += 1
                now[1], now[2] = min((now[1], now[2]), (y.n, y.word), key=lambda v: (-v[0], v[1]))
    for word, (count, n, other) in best.items():
        yield word, count, n, other


def linked(lists: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near_n, near): of each word of a list its near words there: how many, and the largest n and which word has it. A pair is given by one list only."""
    sizes = lists.groupBy("key", "place").agg(F.count("*").alias("size"))
    long = sizes.filter(F.col("size") > block).select(F.col("key").alias("long_key"), F.col("place").alias("long_place"), F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    cut = lists.join(long, (F.col("key") == F.col("long_key")) & (F.col("place") == F.col("long_place")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least(k, F.col("own")) * F.col("blocks") + F.greatest(k, F.col("own")))
    dealt = cut.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).withColumn("task", F.explode(pairs))
    dealt = dealt.select("key", "task", "word", "n", "longer", "needed", "ends", "starts", "head", "tail", "own", "place")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def given(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["word", "n_near", "near_n", "near"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if (row[0], row[1], row[-1]) != at:
                    if len(rows) > 1:
                        out += searched(rows)
                    at, rows = (row[0], row[1], row[-1]), []
                    if len(out) > 20_000:
                        yield given(out)
                        out = []
                rows.append(row)
        if len(rows) > 1:
            out += searched(rows)
        if out:
            yield given(out)

    return dealt.repartition("key", "task").sortWithinPartitions("key", "task", "place").mapInArrow(told, "word string, n_near long, near_n long, near string")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last word that is reached by forms. Steps double each round, and a form is RATIO times as frequent as its word, so rounds are few."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(now)
        now = then.select("word", "root")
        if then.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO, longest: int = LONGEST, parents: int = PARENTS, block: int = BLOCK, min_length: int = MIN_LENGTH, noise: int = NOISE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text).

    A word has at least min_length code points and occurs min_count times in all. form: its near word of
    largest n, the first in code-point order of equal ones, if that n is at least ratio times the word's; else
    null, as is form_n. root: where forms lead, the word itself without one. Null and empty texts have no words; a
    null doc_id is hashed as the empty text; repeated rows count each for itself; other columns are left out,
    whatever their names; an empty table gives none. Very long words are words like others.
    """
    if min_length < 2 * longest + 1:
        raise ValueError(f"words of {min_length} code points may lose all grams of {longest} by one edit")
    words = written(counted_words(docs, min_length, noise).filter(F.col("n") >= min_count), "words")
    lists = written(listed(words, dictionary(words, longest, parents), min_length), "gram-lists")
    best = linked(lists, block).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("top"))
    told = words.join(best, "word", "left").withColumn("_n", -F.col("top.less"))
    is_form = F.col("_n") >= ratio * F.col("n")
    told = written(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("top.near")).alias("form"), F.when(is_form, F.col("_n")).alias("form_n")), "near-words")
    dropped(lists, words)
    roots = rooted(told.filter("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
