"""Operator 1: n-gram Jaccard join by T-occurrence search (DivideSkip).

Two documents link when their shingle sets have a Jaccard similarity of at least
PERCENT / 100; the result is each document's component under these links. Steps:

1. Documents with equal sets become one class. A fixed-size sketch counts all shingles;
   it orders them, rare ones first. Any order is right, the counts only make lists short.
2. A document is listed under the rarest shingles of its set, so many that two linked
   documents have one of these in common (the lists of the inverted index that are short).
3. Each list has a head, the document that has the fewest rarer elements than the list's: an
   edited copy has its edits before what it shares, so the head is near the middle of a group of
   near copies. The list's other documents are candidates of the head if they have enough short lists in common with it. A T-occurrence search over
   the candidates' whole sets finds the head's links.
4. Lists whose documents are all in one component by then have nothing more to give. The
   others are searched in blocks of bounded size, by T-occurrence over the short lists
   and then over whole sets, leaving out pairs of one component and pairs whose sizes
   alone rule a link out. A bitmap of each whole set travels with its short list: the bits in
   which two differ are elements that they do not share, so most pairs without a link end
   in the block and are never written.

So large groups of near copies cost one comparison a document rather than one a pair,
and no link between different components is missed.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from math import log, log2
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import components, dropped, table, written
from .text_arrays import Words, mixed, shingle_sets, slices

WORDS, PERCENT = 4, 85
#: Buckets of the sketch (2^SKETCH_BITS counters of 4 bytes): a bound, whatever the input.
SKETCH_BITS = 18
#: Documents of one list, and elements of one head's candidates, that one task searches at once.
BLOCK, BLOCK_ELEMENTS = 512, 200_000
#: Bits of a set's bitmap.
BITMAP = 256
#: Weight of a binary probe against a step of the heap merge, in DivideSkip's choice of long lists.
PROBE_COST = 0.03

SetOf = Callable[[pa.Array], Iterator[np.ndarray]]


class ShingleSets:
    """Sets of n-word shingles of whole texts, A-Z in lower case, as sorted 64-bit hashes."""

    def __init__(self, n: int = WORDS):
        self.n = n

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in slices(texts):
            yield from shingle_sets(Words(data, offsets), self.n)


def needed(n: int, percent: int) -> int:
    """The overlap that any partner of a set of size n, smaller or larger, has with it at least."""
    return -(-percent * n // 100)


def needed_equal(n: int, percent: int) -> int:
    """The overlap with any partner that is at least as large."""
    return -(-2 * percent * n // (100 + percent))


def needed_pair(n, m, percent: int):
    """The overlap of two sets of these sizes that makes a link."""
    return -(-percent * (n + m) // (100 + percent))


def divide_skip(query: list[int], lists: dict[int, list[int]], least: int, enough: Callable[[int], int], skip: Callable[[int], bool]) -> Iterator[int]:
    """The documents of an inverted index that have at least enough(document) elements of query; least: the smallest of these numbers.

    lists: element to sorted document numbers. Documents for which skip() holds may be left
    out. The longest lists are set aside; a heap merges the others and gives documents that
    occur in them least - (long lists) times; these are looked up in the long lists by binary probes.
    """
    found = [own for own in map(lists.get, query) if own]
    if len(found) < least:
        return
    found.sort(key=len, reverse=True)
    aside = max(0, min(least - 1, int(least / (PROBE_COST * log2(len(found[0]) + 1) + 1))))
    long, short = found[:aside], found[aside:]
    document, count = -1, 0
    for now in [*(heapq.merge(*short) if len(short) > 1 else short[0]), -2]:
        if now == document:
            count += 1
            continue
        if count >= least - aside and document >= 0 and not skip(document):
            total, left, most = count, len(long), enough(document)
            for own in reversed(long):
                if total + left < most:
                    break
                at = bisect_left(own, document)
                total += at < len(own) and own[at] == document
                left -= 1
            if total >= most:
                yield document
        document, count = now, 1


def inverted(sets: list[np.ndarray], wanted: np.ndarray) -> dict[int, list[int]]:
    """Element to the sorted numbers of the sets that hold it, for the sorted elements wanted."""
    lists: dict[int, list[int]] = {}
    for i, own in enumerate(sets):
        at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
        for x in own[wanted[at] == own].tolist():
            lists.setdefault(x, []).append(i)
    return lists


def marks(own: np.ndarray) -> tuple[int, int, int]:
    """(size, two 64-bit fingerprints) of a set; equal for equal sets only."""
    return len(own), int(own.sum(dtype=np.uint64).view(np.int64)), int(mixed(own ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64))


def bitmap(own: np.ndarray) -> bytes:
    """For each of BITMAP classes of elements whether the set holds an odd number of them. Two sets differ in as many elements at least as their bitmaps in bits."""
    return np.packbits(np.bincount((own >> np.uint64(20)).astype(np.int64) % BITMAP, minlength=BITMAP) & 1 == 1).tobytes()


def profiled(texts: DataFrame, set_of: SetOf, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n, p, q) with the marks of each set, and one row with each task's part of the sketch."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = ["doc_id", "n", "p", "q", "sketch"], np.zeros(1 << bits, np.int64)
        for batch in batches:
            rows = []
            for own in set_of(batch.column("text")):
                np.add.at(counts, (own >> np.uint64(64 - bits)).astype(np.int64), 1)
                rows.append(marks(own))
            n, p, q = (pa.array([r[i] for r in rows], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, p, q, pa.nulls(len(rows), pa.binary())], names)
        if counts.any():
            part = compress(np.minimum(counts, 2**31 - 1).astype("<i4").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([part], pa.binary())], names)

    return texts.mapInArrow(told, "doc_id long, n long, p long, q long, sketch binary")


def sketch_of(profiles: DataFrame, parts: int = 16) -> np.ndarray:
    """The counters of all tasks, added up in a few streams; what reaches the driver has a fixed size."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                own = np.frombuffer(decompress(x), "<i4").astype(np.int64)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([compress(np.minimum(total, 2**31 - 1).astype("<i4").tobytes(), 1)], pa.binary())], ["sketch"])

    rows = profiles.filter("sketch is not null").select("sketch").repartition(parts).mapInArrow(added, "sketch binary").collect()
    return sum((np.frombuffer(decompress(r["sketch"]), "<i4").astype(np.int64) for r in rows), np.zeros(1, np.int64))


def listed(texts: DataFrame, set_of: SetOf, sketch: np.ndarray, percent: int) -> DataFrame:
    """(doc_id, n, p, q, tokens, heads, bits) of texts with a set: its rarest elements, enough of them that no link is missed; the first `heads` of them serve a partner that is at least as large; bits: its bitmap."""
    shared, bits = texts.sparkSession.sparkContext.broadcast(sketch), max(0, len(sketch).bit_length() - 1)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rank: the counter on a logarithmic scale, then the hash; an element's rank is its token
        scale = (np.log2(shared.value + 1.0) * 128).astype(np.uint64) << np.uint64(51)
        for batch in batches:
            seen, tokens, heads, bitmaps = [], [], [], []
            for own in set_of(batch.column("text")):
                size = len(own)
                seen.append(marks(own))
                bitmaps.append(bitmap(own))
                heads.append(size - needed_equal(size, percent) + 1)
                rank = (scale[(own >> np.uint64(64 - bits)).astype(np.int64)] if bits else np.uint64(0)) | (own & np.uint64((1 << 51) - 1))
                tokens.append(np.sort(rank)[: size - needed(size, percent) + 1 if size else 0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([m[i] for m in seen], pa.int64()) for i in range(3)], pa.array(tokens, pa.list_(pa.int64())), pa.array(heads, pa.int64()), pa.array(bitmaps, pa.binary())], ["doc_id", "n", "p", "q", "tokens", "heads", "bits"])

    return texts.mapInArrow(told, "doc_id long, n long, p long, q long, tokens array<long>, heads long, bits binary").filter("n > 0")


def sets_of(texts: DataFrame, names: DataFrame, classes: DataFrame, set_of: SetOf) -> DataFrame:
    """(number, elements): the whole sets of the classes whose numbers are in names."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(set_of(batch.column("text")))
            seen = [marks(own) for own in sets]
            yield pa.RecordBatch.from_arrays([*[pa.array([m[i] for m in seen], pa.int64()) for i in range(3)], pa.array([own.astype("<u8").tobytes() for own in sets], pa.binary())], ["n", "p", "q", "elements"])

    wanted = classes.join(names, "number", "left_semi")
    found = texts.join(wanted.select(F.col("class").alias("doc_id")), "doc_id", "left_semi").mapInArrow(told, "n long, p long, q long, elements binary")
    return found.join(wanted, ["n", "p", "q"]).select("number", "elements").dropDuplicates(["number"])


def row_arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a column of long lists or of binary sets, each as a view of the batch's memory."""
    if pa.types.is_list(column.type):
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
        values = np.frombuffer(column.buffers()[2], "<u8", offsets[-1]) if len(column) and offsets[-1] else np.zeros(0, "<u8")
    for i in range(len(column)):
        yield values[offsets[i] : offsets[i + 1]]


def by_block(rows: DataFrame, search: Callable[[int, list[tuple]], Iterator[tuple[int, int]]]) -> DataFrame:
    """(a, b): what search(task, rows) makes of the rows of each (task, block), one block in memory at a time. The last column holds arrays."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, out = None, [], []

        def some() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            *plain, last = batch.columns
            for task, number, *row in zip(*[c.to_pylist() for c in plain], row_arrays(last)):
                if (task, number) != key:
                    out += search(key[0], block) if block else []
                    key, block = (task, number), []
                    if len(out) > 10_000:
                        yield some()
                        out = []
                block.append(tuple(row))
        out += search(key[0], block) if block else []
        if out:
            yield some()

    return rows.repartition("task", "block").sortWithinPartitions("task", "block").mapInArrow(told, "a long, b long")


def verified(candidates: DataFrame, sets: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among candidates (head, number): each head asks an inverted index of its candidates' whole sets, which is split where it would be large."""
    total = candidates.join(ranked.select("number", "n"), "number").groupBy("head").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).alias("blocks"))
    block = F.pmod(F.xxhash64("number"), F.col("blocks")).cast("long")
    members = candidates.join(total, "head").select(F.col("head").alias("task"), block.alias("block"), "number", F.lit(False).alias("asks"))
    # a head asks each of its blocks, empty ones too
    heads = total.select(F.col("head").alias("task"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("head").alias("number"), F.lit(True))
    rows = members.union(heads).join(sets, "number").select("task", "block", "number", "asks", "elements")

    def search(_: int, block: list[tuple]) -> Iterator[tuple[int, int]]:
        asking = [r for r in block if r[1]]
        members = [r for r in block if not r[1]]
        for head, _, elements in asking:
            lists = inverted([r[2] for r in members], elements)
            for at in divide_skip(elements.tolist(), lists, needed(len(elements), percent), lambda i: needed_pair(len(elements), len(members[i][2]), percent), lambda i: False):
                yield head, members[at][0]

    return by_block(rows, search)


def required(n: Column, kept: Column, m: Column, also: Column, percent: int) -> Column:
    """How many of their rarest elements two linked sets have in common at least: of sizes n and m, with so many elements kept of each."""
    return F.ceil((n + m) * percent / (100 + percent)) - F.greatest(n - kept, m - also)


def against_heads(pairs: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (head, number), those that sizes and short lists in common leave as candidates."""
    own = ranked.select(F.col("number").alias("head"), F.col("n").alias("m"), F.col("tokens").alias("also"))
    both = pairs.join(own, "head").join(ranked.select("number", "n", "tokens"), "number")
    both = both.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    common = F.size(F.array_intersect("tokens", "also"))
    return both.filter(common >= required(F.col("n"), F.size("tokens"), F.col("m"), F.size("also"), percent)).select("head", "number")


def several_parts(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """(token, many, number, head, component) of the lists that hold several components; of lists with the same documents, one."""
    placed = lists.filter("length > 2").join(parts, "number", "left").withColumn("component", F.coalesce("component", "number"))
    mark = F.xxhash64("number", "head")
    several = placed.groupBy("token").agg(F.count("*").alias("many"), F.bit_xor(mark).alias("x"), F.sum(mark % (1 << 40)).alias("s"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    several = several.groupBy("many", "x", "s").agg(F.min("token").alias("token"))
    return placed.join(several.select("token", "many"), "token").select("token", "many", "number", "head", "component")


def in_blocks(rest: DataFrame, ranked: DataFrame, percent: int, block: int) -> DataFrame:
    """Distinct candidates (head, number) among all pairs of different components of the lists in rest.

    A list longer than a block is cut by set size, so that a link never spans more than two neighbouring cuts, and
    each cut into blocks of about `block` documents. A task holds one block of an index and one block of queries. Each
    pair comes from the list of its first common token alone.
    """
    width = log(100 / percent) * 1.0001
    sized = rest.join(ranked.select("number", "n"), "number").withColumn("cut", F.when(F.col("many") > block, F.floor(F.log("n") / width)).otherwise(0).cast("int"))
    counts = sized.groupBy("token", "cut").agg(F.count(F.when(F.col("head"), 1)).alias("indexed"), F.count("*").alias("asking"))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    counts = counts.select("token", "cut", blocks("indexed").alias("index_blocks"), blocks("asking").alias("ask_blocks"))
    # what each cut's blocks meet: an index its own cut's and the next one's queries, a query its own cut's and the last one's index
    near = counts.select("token", F.explode(F.array(F.struct("cut", F.lit(0).alias("kind")), F.struct((F.col("cut") - 1).alias("cut"), F.lit(1).alias("kind")), F.struct((F.col("cut") + 1).alias("cut"), F.lit(2).alias("kind")))).alias("to"), "index_blocks", "ask_blocks")
    pick = lambda kind, c: F.coalesce(F.max(F.when(F.col("to.kind") == kind, F.col(c))), F.lit(0))
    near = near.groupBy("token", F.col("to.cut").alias("cut")).agg(pick(0, "index_blocks").alias("i0"), pick(0, "ask_blocks").alias("a0"), pick(1, "ask_blocks").alias("a1"), pick(2, "index_blocks").alias("i2"))
    # written, so that the join that follows is one that Spark can split where a list is long
    placed = sized.join(written(near, "cuts"), ["token", "cut"])
    own = lambda n: F.pmod(F.xxhash64("number"), F.greatest(F.col(n), F.lit(1))).cast("int")
    upto = lambda n, made: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), made)).otherwise(F.array().cast("array<bigint>"))
    task = lambda cut, i, step, j: F.xxhash64(cut, i, F.lit(step), j)
    index = placed.filter("head").withColumn("block", F.explode(F.concat(upto("a0", lambda j: task(F.col("cut"), own("i0"), 0, j)), upto("a1", lambda j: task(F.col("cut"), own("i0"), 1, j)))))
    asking = placed.withColumn("block", F.explode(F.concat(upto("i0", lambda i: task(F.col("cut"), i, 0, own("a0"))), upto("i2", lambda i: task(F.col("cut") - 1, i, 1, own("a0"))))))
    names = ["token", "block", "number", "component"]
    both = index.select(*names, F.lit(True).alias("indexed"), F.lit(False).alias("asks")).union(asking.select(*names, F.lit(False), F.lit(True)))
    both = both.groupBy(F.col("token").alias("task"), "block", "number", "component").agg(F.max("indexed").alias("indexed"), F.max("asks").alias("asks"))
    both = both.join(ranked.select("number", "n", "bits", "tokens"), "number").select("task", "block", "number", "component", "indexed", "asks", "n", "bits", "tokens")

    def search(token: int, block: list[tuple]) -> Iterator[tuple[int, int]]:
        index = [r for r in block if r[2]]
        # smaller tokens than the list's own do not matter: a pair that has one is found there
        kept = [r[6][np.searchsorted(r[6], token) :].tolist() for r in index]
        bitmaps = [int.from_bytes(r[5]) for r in index]
        sizes = Counter(r[1] for r in index)
        main = max(sizes, key=sizes.get) if sizes else None

        def inverted_without(component: int | None) -> dict[int, list[int]]:
            lists: dict[int, list[int]] = {}
            for i, r in enumerate(index):
                if r[1] != component:
                    for x in kept[i]:
                        lists.setdefault(x, []).append(i)
            return lists

        # most documents of a list are of one component; these only have to ask the others
        every, others = inverted_without(None) if len(sizes) > 1 or any(r[1] != main for r in block) else {}, inverted_without(main)
        for number, component, _, asks, n, bits, tokens in block:
            def enough(i: int) -> int:
                m, also = index[i][4], len(index[i][6])
                return max(1, needed_pair(n, m, percent) - max(n - len(tokens), m - also))

            if asks:
                start = int(np.searchsorted(tokens, token))
                smaller, bits = set(tokens[:start].tolist()), int.from_bytes(bits)
                skip = lambda i: index[i][1] == component or index[i][0] >= number or 100 * index[i][4] < percent * n
                for at in divide_skip(tokens[start:].tolist(), others if component == main else every, 1, enough, skip):
                    m, also = index[at][4], index[at][6]
                    if n + m - (bits ^ bitmaps[at]).bit_count() >= 2 * needed_pair(n, m, percent) and smaller.isdisjoint(also[: len(also) - len(kept[at])].tolist()):
                        yield index[at][0], number

    return by_block(both, search).select(F.col("a").alias("head"), F.col("b").alias("number")).distinct()


def joined(docs: DataFrame, set_of: SetOf | None = None, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links, the row's own included. Null
    and empty texts and texts without words have an empty set and link with nothing, not
    even with each other. Rows that repeat a doc_id are that document more than once. Rows
    with a null doc_id link with nothing and come back with a null component. Other columns
    are left out, whatever their names; an empty table gives none.
    """
    set_of = set_of or ShingleSets()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = written(profiled(texts, set_of), "profiles")
    rows = profiles.filter("sketch is null").select("doc_id", "n", "p", "q")
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("n", "p", "q").agg(F.min("doc_id").alias("class"))
    # numbers ascend with size: of two classes, the one with the smaller number is no larger
    classes = written(classes.repartitionByRange("n", "class").sortWithinPartitions("n", "class").withColumn("number", F.monotonically_increasing_id()), "classes")
    # on the document that stands for a class, so that copies of one text do not meet in one task
    ranked = listed(texts, set_of, sketch_of(profiles), percent).join(classes.withColumnRenamed("class", "doc_id"), ["doc_id", "n", "p", "q"])
    ranked = written(ranked.select("number", "n", "tokens", "heads", "bits").dropDuplicates(["number"]), "ranked")

    # counted first, with partial sums: a token that many documents share is one row a task, and the join back is one that Spark can split
    postings = ranked.select("number", "heads", F.posexplode("tokens").alias("at", "token")).select("token", "number", "at", (F.col("at") < F.col("heads")).alias("head"))
    lengths = postings.groupBy("token").agg(F.count("*").alias("length"), F.max("head").alias("any"), F.min(F.struct("at", "number"))["number"].alias("central")).filter("length > 1 and any").drop("any")
    lists = written(postings.drop("at").join(lengths, "token"), "lists")

    def searched(candidates: DataFrame) -> DataFrame:
        sets = sets_of(texts, candidates.select("number").union(candidates.select("head")).distinct(), classes, set_of)
        return written(verified(candidates, sets, ranked, percent), "links")

    first = written(against_heads(lists.filter("number <> central").select(F.col("central").alias("head"), "number").distinct(), ranked, percent), "candidates")
    links = searched(first)
    parts = written(components(links).withColumnRenamed("id", "number"), "components")
    rest = written(several_parts(lists, parts), "rest")
    tried = first.select(F.least("head", "number").alias("head"), F.greatest("head", "number").alias("number"))
    second = written(in_blocks(rest, ranked, percent, block).join(tried, ["head", "number"], "left_anti"), "candidates")
    more = searched(second)
    dropped(lists, ranked, first, second, rest, links)
    # the first links as the stars that they have become
    found = components(parts.select("number", "component").union(more.select("a", "b")), "number", "component").withColumnRenamed("id", "number")

    found = classes.join(found, "number", "left").withColumn("component", F.coalesce("component", "number"))
    least = found.groupBy("component").agg(F.min("class").alias("component_id"))
    names = found.join(least, "component").select(F.col("n").alias("_n"), F.col("p").alias("_p"), F.col("q").alias("_q"), "component_id")
    out = rows.join(names, (F.col("n") == F.col("_n")) & (F.col("p") == F.col("_p")) & (F.col("q") == F.col("_q")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"))
