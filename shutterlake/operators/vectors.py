"""Vector operators: cosine joins by blocks, leader clustering, exemplars, matching, carry-over.

Vectors meet in blocks of bounded size: a task multiplies two blocks with numpy and gives
only what is above a threshold, or the best of each query. Where a key has several blocks, they are cells
around pivots, packed in a row each, and angles rule out pairs of blocks before any product. Independent sets and exemplars are rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shutterlake.functions.scalars import dot
from shutterlake.sources.shared import written

BLOCK = 2048
#: Pivots of a key, at most; reference pivots to which each block knows its range of angles; parts in which a key's rows meet its pivots.
PIVOTS, REFERENCES, PARTS = 1024, 8, 32
#: Full blocks of a file of packed blocks, about.
FILE = 16
#: Rows of a result that a task holds before it gives them on.
FOUND = 1 << 16
#: Radians by which a bound on angles may be off by rounding.
SLACK = 1e-6
#: Bins of one counting pass over cosines.
BINS = 4096
EXEMPLARS, OUTLIER_FLOOR, OUTLIER_GROUP = 5, 0.35, 4
CARRY_IOU, CARRY_COSINE, CARRY_MARGIN = 0.5, 0.5, 0.10


def normed(m: np.ndarray) -> np.ndarray:
    """The rows of m as rows of length 1; a row that has no length stays all zeros."""
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def unit(vectors: list) -> np.ndarray:
    """Vectors as rows of length 1; a vector that is missing, or has no length, is all zeros."""
    size = max((len(v) for v in vectors if v is not None), default=1)
    m = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size:
            m[i] = v
    return normed(m)


def lengths(vectors: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)


def stacked(vectors: pa.Array, size: int | None = None) -> np.ndarray:
    """Vectors as rows of doubles; one that is missing, or of another length than size or else the longest one, is all zeros."""
    n = lengths(vectors)
    size = size or max(1, int(n.max(initial=0)))
    m, fit = np.zeros((len(n), size)), n == size
    m[fit] = pc.list_flatten(vectors.filter(pa.array(fit))).to_numpy(zero_copy_only=False).reshape(-1, size)
    return m


def directed(m: np.ndarray) -> np.ndarray:
    """Which rows have a direction."""
    size = np.linalg.norm(m, axis=1)
    return (size > 1e-12) & np.isfinite(size)


def runs(batches: Iterator[pa.RecordBatch], *names: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose rows agree in the columns names, of most rows at most; a run that goes on in the next batch is several slices."""
    for batch in batches:
        columns = [batch[c].to_numpy(zero_copy_only=False) for c in names]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        ends = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for i, j in zip([0, *ends], ends):
            for k in range(i, j, most or max(1, j - i)):
                yield batch.slice(k, min(j, k + (most or j)) - k)


def _tasks(rows: DataFrame, schema: str, run: Callable[[list[tuple]], Iterator[tuple]]) -> DataFrame:
    """run() over the rows of each (key, task), one task in memory at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, []
        kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]

        def result() -> Iterator[pa.RecordBatch]:
            out = list(run(block)) if block else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:2] != at:
                    yield from result()
                    at, block = row[:2], []
                block.append(row)
        yield from result()

    return rows.repartition("key", "task").sortWithinPartitions("key", "task").mapInArrow(told, schema)


def pairs_above(rows: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(key, a, b, cos): pairs a < b of rows (key, id long, vector) of one key whose cosine is at least least. A row without an id is in none.

    A key of one block is a task. Blocks of a larger key are cells of a metric index, each packed in one row of a table that is written once.
    A nested loop reads that table's parts pair by pair, so no vector is copied to disk for the pairs of its block, and multiplies
    the blocks that may_meet() does not rule out. Exact for all vectors: pivots only decide what is skipped.
    """
    own = rows.filter("id is not null").select("key", "id", "vector")
    sizes = own.groupBy("key").agg(F.count("*").alias("n"))
    few, many, cut = sizes.agg(F.min("n"), F.max("n"), F.sum(F.when(F.col("n") > block, F.col("n")))).first()

    def run(block: list[tuple]) -> Iterator[tuple]:
        ids, m = np.array([r[2] for r in block]), unit([r[3] for r in block])
        for a, b in zip(*np.nonzero(m @ m.T >= least)):
            if ids[a] < ids[b]:
                yield block[0][0], int(ids[a]), int(ids[b]), float(m[a] @ m[b])

    found = []
    if few is None or few <= block:
        small = own if many is None or many <= block else own.join(sizes.filter(F.col("n") <= block), "key", "left_semi")
        found.append(_tasks(small.select("key", F.lit(0).cast("long").alias("task"), "id", "vector"), "key long, a long, b long, cos double", run))
    if many is not None and many > block:
        parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-cut // (FILE * block)))
        packed = written(packed_blocks(celled(own, sizes.filter(F.col("n") > block), block), parts), "blocks")
        pairs = beside(packed, may_meet(least)).select("a_key", "a_own", "a_ids", "a_vectors", "a_single", "b_own", "b_ids", "b_vectors", "b_single")
        found.append(pairs.mapInArrow(products(least), "key long, a long, b long, cos double"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def products(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, a, b, cos) of the rows of pairs of packed blocks (a_, b_), two blocks in memory at a time."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["key", "a", "b", "cos"])

        def side(columns: dict, p: str, i: int) -> tuple[np.ndarray, np.ndarray]:
            ids = np.frombuffer(columns[f"{p}ids"][i].as_buffer(), np.int64)
            flat = columns[f"{p}vectors"][i].as_buffer()
            m = np.frombuffer(flat, np.float32 if columns[f"{p}single"][i].as_py() else np.float64).reshape(len(ids), -1)
            return ids, normed(m.astype(np.float64))

        at = None
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            keys, owns, others = (columns[c].to_pylist() for c in ("a_key", "a_own", "b_own"))
            for i, (key, own, other) in enumerate(zip(keys, owns, others)):
                if (key, own) != at:
                    at, (ids, left) = (key, own), side(columns, "a_", i)
                theirs, right = (ids, left) if own == other else side(columns, "b_", i)
                # vectors of different lengths have cosine 0
                cos = left @ right.T if left.shape[1] == right.shape[1] else np.zeros((len(left), len(right)))
                x, y = np.divmod(np.flatnonzero(cos >= least), len(right))
                a, b, cos = ids[x], theirs[y], cos[x, y]
                if own == other:
                    once = a < b
                    a, b, cos = a[once], b[once], cos[once]
                else:
                    unlike = a != b
                    a, b, cos = np.minimum(a, b)[unlike], np.maximum(a, b)[unlike], cos[unlike]
                if len(a):
                    out.append((np.full(len(a), key), a, b, cos))
                    held += len(a)
                if held >= FOUND:
                    yield result()
                    out, held = [], 0
        if out:
            yield result()

    return told


def celled(rows: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, id, vector, own, far, loose, angles) of the rows (key, id, vector) of the keys in sizes (key, n): own is the block.

    A hash of the id picks about two pivots for each block that a key needs. A row goes to the cell of the pivot
    that it is most like: far is the angle to it, angles those to REFERENCES pivots. A cell of more than a block's rows is cut by hash.
    Rows without a direction, or of another length than the pivots, have no cell's bounds: their far is null. Those that have a
    direction, if only because a key has no pivots, are loose. Keys and cells are fewer than rows by the size of a block, so they are broadcast.
    """
    share = F.least(F.lit(1.0), F.least(F.ceil(F.col("n") / block) * 2, F.lit(PIVOTS)) / F.col("n"))
    own = rows.join(F.broadcast(sizes), "key")
    chosen = own.filter((F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 30)) < share * (1 << 30)) & F.col("vector").isNotNull())
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    first = chosen.select("key", parts.alias("part"), F.lit(False).alias("row"), "id", "vector")
    both = first.union(own.select("key", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(PARTS)).cast("int").alias("part"), F.lit(True).alias("row"), "id", "vector"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots, ids, m = None, [], np.zeros(0, np.int64), np.zeros((0, 1))
        for batch in runs(batches, "key", "part", "row", most=1024):
            if (here := (batch["key"][0].as_py(), batch["part"][0].as_py())) != at:
                at, pivots, ids, m = here, [], np.zeros(0, np.int64), np.zeros((0, 1))
            if not batch["row"][0].as_py():
                pivots.append(batch)
                continue
            if pivots:  # all are there, in one order for all parts
                given = pa.concat_arrays([p["vector"] for p in pivots])
                m = stacked(given)
                fit = directed(m)
                ids, m, pivots = np.concatenate([p["id"].to_numpy() for p in pivots])[fit], normed(m[fit]), []
            vectors, n = batch["vector"], batch.num_rows
            v = stacked(vectors, m.shape[1])
            good = directed(v) & (len(m) > 0)
            cos = np.clip(normed(np.where(good[:, None], v, 0.0)) @ m.T, -1, 1) if len(m) else np.zeros((n, 1))
            best, angles = np.argmax(cos, 1), np.arccos(cos)
            near = np.ascontiguousarray(angles[:, :REFERENCES])
            loose = ~good & (lengths(vectors) > 0) & ((lengths(vectors) != m.shape[1]) | (len(m) == 0))
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["id"], vectors, pa.array(ids[best] if len(m) else np.zeros(n, np.int64), mask=~good), pa.array(angles[np.arange(n), best], mask=~good), pa.array(loose)]
                + [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()), mask=pa.array(~good))],
                ["key", "id", "vector", "cell", "far", "loose", "angles"],
            )

    kind = rows.schema["vector"].dataType.simpleString()
    cells = both.repartition("key", "part").sortWithinPartitions("key", "part", "row", "id").mapInArrow(told, f"key long, id long, vector {kind}, cell long, far double, loose boolean, angles array<double>")
    cells = written(cells, "celled")
    cut = cells.groupBy("key", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts")).select(F.col("key").alias("_key"), F.col("cell").alias("_cell"), "cuts")
    rows = cells.join(F.broadcast(cut), (F.col("key") == F.col("_key")) & F.col("cell").eqNullSafe(F.col("_cell")))
    return rows.select("key", "id", "vector", F.xxhash64("cell", F.pmod(F.xxhash64("id"), F.col("cuts"))).alias("own"), "far", "loose", "angles")


def packed_blocks(cells: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each block of celled(), in parts partitions: (key, own, ids and vectors as bytes, single, centre, far, loose, low, high).

    single tells floats from doubles. centre is the direction of the block's mean, far its widest angle to a row, null where rows have no bounds;
    low and high are the ranges of angles to the reference pivots; loose tells of a row that bounds say nothing about.
    """
    single = cells.schema["vector"].dataType.elementType.simpleString() == "float"

    def one(block: pa.RecordBatch) -> pa.RecordBatch:
        m = stacked(block["vector"])
        bounded = block["far"].null_count == 0
        centre, far, low, high = None, None, None, None
        if bounded:
            u = normed(m)
            mean = u.sum(0)
            centre = normed((mean if np.linalg.norm(mean) > 1e-6 else u[0])[None])[0]
            far = float(np.arccos(np.clip(u @ centre, -1, 1)).max())
            angles = stacked(block["angles"])
            low, high = angles.min(0).tolist(), angles.max(0).tolist()
        kind = np.float32 if single else np.float64
        row = (block["key"][0].as_py(), block["own"][0].as_py(), block["id"].to_numpy().tobytes(), m.astype(kind).tobytes(), single, None if centre is None else centre.tolist(), far, bool(np.any(block["loose"].to_numpy(zero_copy_only=False))), low, high)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, schema.types)], schema=schema)

    doubles = pa.list_(pa.float64())
    schema = pa.schema([("key", pa.int64()), ("own", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("single", pa.bool_()), ("centre", doubles), ("far", pa.float64()), ("loose", pa.bool_()), ("low", doubles), ("high", doubles)])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in runs(batches, "key", "own"):
            if (here := (batch["key"][0].as_py(), batch["own"][0].as_py())) != at:
                if held:
                    yield one(pa.concat_batches(held))
                at, held = here, []
            held.append(batch)
        if held:
            yield one(pa.concat_batches(held))

    kinds = "key long, own long, ids binary, vectors binary, single boolean, centre array<double>, far double, loose boolean, low array<double>, high array<double>"
    dealt = cells.repartition(parts, "key", "own") if parts else cells.repartition("key", "own")
    return dealt.sortWithinPartitions("key", "own").mapInArrow(told, kinds)


def may_meet(least: float) -> Column:
    """Whether rows of two packed blocks of a key, a_ and b_, may have a cosine of least.

    Angles obey the triangle inequality: rows of two blocks are no closer than their centres are, less both
    radii, and no closer than their ranges of angles to any one reference pivot are apart.
    """
    within = float(np.arccos(np.clip(least, -1.0, 1.0))) + SLACK
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("a_centre"), F.col("b_centre"))))) - F.col("a_far") - F.col("b_far") > within
    for i in range(REFERENCES):
        gap = lambda p, q, i=i: F.get(f"{p}low", F.lit(i)) - F.get(f"{q}high", F.lit(i)) > within
        apart = apart | F.coalesce(gap("a_", "b_") | gap("b_", "a_"), F.lit(False))
    # rows without a direction have cosine 0 with all
    unbounded = F.col("a_far").isNull() | F.col("b_far").isNull()
    return (F.col("a_own") == F.col("b_own")) | F.col("a_loose") | F.col("b_loose") | F.when(unbounded, F.lit(least <= 0)).otherwise(~F.coalesce(apart, F.lit(False)))


def beside(packed: DataFrame, also: Column | None = None) -> DataFrame:
    """All pairs of a key's packed blocks, a_own <= b_own, for which also holds.

    A nested loop over pairs of partitions: a join by key would give all pairs of a key to one task, or copy its blocks to many.
    """
    side = lambda p: packed.select(*[F.col(c).alias(f"{p}{c}") for c in packed.columns])
    pairs = (F.col("a_key") == F.col("b_key")) & (F.col("a_own") <= F.col("b_own"))
    return side("a_").hint("shuffle_replicate_nl").join(side("b_"), pairs if also is None else pairs & also)


def block_pairs(cells: DataFrame, least: float) -> DataFrame:
    """(key, a, b, kept): all pairs a <= b of a key's blocks of celled(), and whether two of their rows may have a cosine of least. Blocks are pairs here, not rows."""
    return beside(packed_blocks(cells)).select(F.col("a_key").alias("key"), F.col("a_own").alias("a"), F.col("b_own").alias("b"), may_meet(least).alias("kept"))


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rank, anchor): the lexicographically first maximal independent set of a graph, that is, what a greedy pass in order of rank would keep.

    nodes: (id, rank unique); edges: (a, b). In each round a node whose earlier neighbours are all out
    becomes an anchor, and a node with an earlier anchor beside it is out. Rounds grow with the
    logarithm of the input for random orders; only the number of undecided nodes reaches the driver.
    """
    r = nodes.select("id", "rank")
    both = edges.select("a", "b").union(edges.select("b", "a"))
    earlier = written(both.join(r.withColumnsRenamed({"id": "a", "rank": "ra"}), "a").join(r.withColumnsRenamed({"id": "b", "rank": "rb"}), "b").filter("rb < ra").select("a", "b").distinct(), "earlier")
    state = written(r.withColumn("anchor", F.lit(None).cast("boolean")), "state")
    while True:
        seen = earlier.join(state.select(F.col("id").alias("b"), F.col("anchor").alias("s")), "b").groupBy(F.col("a").alias("id")).agg(F.bool_or(F.coalesce("s", F.lit(False))).alias("beside"), F.bool_or(F.col("s").isNull()).alias("waits"))
        now = F.when(F.col("anchor").isNotNull(), F.col("anchor")).when(F.coalesce("beside", F.lit(False)), F.lit(False)).when(~F.coalesce("waits", F.lit(False)), F.lit(True))
        state = written(state.join(seen, "id", "left").select("id", "rank", now.alias("anchor")), "state")
        if not state.filter("anchor is null").count():
            return state


def in_order() -> Column:
    """A rank as a value that compares, without a sort: high scores first, then id."""
    return F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))


def leader_clusters(faces: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(key, id, cluster): each row of faces (key, id, vector, score) joins the first cluster whose founder is within least, else founds one; rows in order of score, high first, then id.

    cluster is the founder's id. A row without a vector is its own cluster.
    """
    nodes = faces.select("key", "id", in_order().alias("rank"))
    edges = written(pairs_above(faces, least, block), "edges")
    anchors = first_independent(nodes.select("id", "rank"), edges).filter("anchor").select(F.col("id").alias("founder"), F.col("rank").alias("founded"))
    beside = edges.select(F.col("a").alias("id"), F.col("b").alias("founder")).union(edges.select("b", "a"))
    own = anchors.select(F.col("founder").alias("id"), F.col("founder").alias("self"))
    best = beside.join(anchors, "founder").groupBy("id").agg(F.min_by("founder", "founded").alias("joined"))
    # a founder stands by itself: no earlier founder is within reach of it
    return nodes.join(own, "id", "left").join(best, "id", "left").select("key", "id", F.coalesce("self", "joined").alias("cluster"))


def suppressed(boxes: DataFrame, least: float) -> DataFrame:
    """boxes (photo_id, id, score, x, y, w, h) that greedy non-maximum suppression keeps: the best scored, minus those that overlap a kept one by least."""
    from shutterlake.functions.scalars import iou

    side = lambda p: boxes.select("photo_id", *[F.col(c).alias(f"{p}{c}") for c in ("id", "x", "y", "w", "h")])
    edges = side("p_").join(side("q_"), "photo_id").filter(F.col("p_id") < F.col("q_id")).filter(iou("p_", "q_") >= least).select(F.col("p_id").alias("a"), F.col("q_id").alias("b"))
    # photos share no edges, so one order serves them all
    nodes = boxes.select("id", in_order().alias("rank"))
    return boxes.join(first_independent(nodes, edges).filter("anchor").select("id"), "id", "left_semi")


def without_outliers(faces: DataFrame, floor: float = OUTLIER_FLOOR, least: int = OUTLIER_GROUP) -> DataFrame:
    """faces (key, id, vector, ...) without those that no sibling of the key resembles; keys with fewer than least faces, or where fewer than two would stay, keep all."""
    near = pairs_above(faces, floor)
    like = near.select("key", F.col("a").alias("id")).union(near.select("key", "b")).distinct().withColumn("like", F.lit(True))
    n = faces.groupBy("key").agg(F.count("*").alias("_n"))
    liked = like.groupBy("key").agg(F.count("*").alias("_liked"))
    rows = faces.join(like, ["key", "id"], "left").join(n, "key").join(liked, "key", "left")
    keep = (F.col("_n") < least) | (F.coalesce("_liked", F.lit(0)) < 2) | F.col("like").isNotNull()
    return rows.filter(keep).select(*faces.columns)


def exemplars(faces: DataFrame, k: int = EXEMPLARS) -> DataFrame:
    """(key, id, vector, place): k faces a key that differ most: the best scored first, then each time the one least like those picked; of equals the last in order.

    k - 1 rounds: each updates every face's largest cosine to the picks and takes a key's minimum with map-side combining.
    """
    rows = faces.select("key", "id", "vector", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "id")).alias("nth"))
    rows = written(rows.withColumn("near", F.lit(-2.0)), "faces")
    pick = rows.filter("nth = 1")
    out = pick.select("key", "id", "vector", F.lit(0).alias("place"))
    for place in range(1, k):
        near = rows.join(pick.select("key", F.col("id").alias("p"), F.col("vector").alias("pv")), "key", "left").filter("p is not null and id <> p")
        size = F.sqrt(dot(F.col("vector"), F.col("vector"))) * F.sqrt(dot(F.col("pv"), F.col("pv")))
        cos = F.when(size > 1e-12, dot(F.col("vector"), F.col("pv")) / size).otherwise(0.0)
        rows = written(near.withColumn("near", F.greatest("near", cos)).select("key", "id", "vector", "nth", "near"), "faces")
        pick = rows.groupBy("key").agg(F.min_by(F.struct("id", "vector"), F.struct(F.col("near"), -F.col("nth"))).alias("p")).select("key", "p.*")
        out = out.union(pick.select("key", "id", "vector", F.lit(place)))
    return out


def best_keys(queries: DataFrame, prototypes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, first, best, second): for each row of queries (id, vector, barred array<long>) the key of prototypes (key, vector) that is most like it, its cosine, and the next key's.

    barred keys are left out; of equal keys the smaller is first. A key's prototypes share a block, so that two numbers
    of each block are enough to find the best two keys of all.
    """
    size = max(1, block // EXEMPLARS)
    n = prototypes.agg(F.ceil(F.approx_count_distinct("key") / size).cast("int").alias("blocks")).select(F.greatest("blocks", F.lit(1)).alias("blocks"))
    protos = prototypes.join(F.broadcast(n)).select(F.lit(0).cast("long").alias("key"), F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("pblock"), F.col("key").alias("id"), "vector", F.lit(None).cast("array<long>").alias("barred"), F.lit(True).alias("proto"))
    m = queries.agg(F.greatest(F.ceil(F.count("*") / block).cast("int"), F.lit(1)).alias("qblocks"))
    asked = queries.join(F.broadcast(m)).join(F.broadcast(n)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("qblocks")).cast("int"))
    asked = asked.select(F.lit(0).cast("long").alias("key"), F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda p: p * F.col("qblocks") + F.col("own"))).alias("task"), "id", "vector", "barred", F.lit(False).alias("proto"))
    served = protos.join(F.broadcast(m)).select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("qblocks") - 1), lambda q: F.col("pblock") * F.col("qblocks") + q)).alias("task"), "id", "vector", "barred", "proto")

    def run(block: list[tuple]) -> Iterator[tuple]:
        ours, theirs = [r for r in block if not r[5]], [r for r in block if r[5]]
        if not ours or not theirs:
            return
        theirs.sort(key=lambda r: r[2])
        keys, first = np.unique([r[2] for r in theirs], return_index=True)
        place = {k: i for i, k in enumerate(keys.tolist())}
        m = unit([r[3] for r in ours + theirs])
        score = np.maximum.reduceat(m[: len(ours)] @ m[len(ours) :].T, first, axis=1)
        bars = [(i, place[bar]) for i, r in enumerate(ours) for bar in r[4] or [] if bar in place]
        if bars:
            score[tuple(zip(*bars))] = -np.inf
        for _ in range(min(2, len(keys))):
            best = np.argmax(score, axis=1)
            for r, k, cos in zip(ours, best.tolist(), score[np.arange(len(ours)), best].tolist()):
                if cos > -np.inf:
                    yield r[2], int(keys[k]), cos
            score[np.arange(len(ours)), best] = -np.inf

    found = _tasks(asked.unionByName(served), "id long, person long, cos double", run)
    order = W.partitionBy("id").orderBy(F.desc("cos"), "person")
    ranked = found.withColumn("n", F.row_number().over(order)).withColumn("second", F.lead("cos").over(order)).filter("n = 1")
    return ranked.select("id", F.col("person").alias("first"), F.col("cos").alias("best"), "second")


def others_counted(queries: DataFrame, prototypes: DataFrame, between: tuple[float, float] | None = None, block: int = BLOCK) -> DataFrame:
    """(bin, n, low, high): how many best cosines of queries (id, key, vector) with each other key's prototypes (key, vector) there are, the least and the largest; by the query's key, or, of those in between, by BINS bins.

    One block of queries meets one block of keys at a time, and a block gives counts only. Rows without a vector are left out.
    """
    size = max(1, block // EXEMPLARS)
    protos, asked = prototypes.filter("vector is not null"), queries.filter("vector is not null")
    n = protos.agg(F.greatest(F.ceil(F.count_distinct("key") / size), F.lit(1)).cast("int").alias("blocks"))
    m = asked.agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int").alias("qblocks"))
    both = F.broadcast(n.join(m))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    ours = asked.join(both).withColumn("own", F.pmod(F.xxhash64("id"), F.col("qblocks")).cast("int"))
    ours = ours.select(F.lit(0).cast("long").alias("key"), F.explode(F.transform(every("blocks"), lambda p: p * F.col("qblocks") + F.col("own"))).alias("task"), F.lit(False).alias("proto"), F.col("key").alias("of"), "id", "vector")
    theirs = protos.join(both).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    theirs = theirs.select(F.lit(0).cast("long").alias("key"), F.explode(F.transform(every("qblocks"), lambda q: F.col("own") * F.col("qblocks") + q)).alias("task"), F.lit(True).alias("proto"), F.col("key").alias("of"), "id", "vector")

    def run(block: list[tuple]) -> Iterator[tuple]:
        block = sorted(block, key=lambda r: r[2:5])  # in one order, so that every pass has the same cosines
        left, right = [r for r in block if not r[2]], [r for r in block if r[2]]
        if not left or not right:
            return
        keys, first = np.unique([r[3] for r in right], return_index=True)
        m = unit([r[5] for r in block])
        cos = np.maximum.reduceat(m[: len(left)] @ m[len(left) :].T, first, axis=1)
        of = np.array([r[3] for r in left])
        other = of[:, None] != keys[None, :]
        if between:
            lo, hi = between
            other &= (cos >= lo) & (cos <= hi)
            value = cos[other]
            group = np.minimum(np.floor((value - lo) / (hi - lo) * BINS), BINS - 1).astype(np.int64)
        else:
            value, group = cos[other], np.broadcast_to(of[:, None], cos.shape)[other]
        order = np.lexsort((value, group))
        value, group = value[order], group[order]
        found, start, count = np.unique(group, return_index=True, return_counts=True)
        for g, a, c in zip(found.tolist(), start.tolist(), count.tolist()):
            yield g, c, float(value[a]), float(value[a + c - 1])

    return _tasks(ours.unionByName(theirs), "bin long, n long, low double, high double", run)


def accepted(best: DataFrame, threshold: float, margin: float) -> DataFrame:
    """Matches that are good enough and lead the next key by the margin."""
    return best.filter((F.col("best") >= threshold) & (F.col("best") - F.coalesce("second", F.lit(float("-inf"))) >= margin))


def one_per_photo(matches: DataFrame) -> DataFrame:
    """matches (photo_id, id, face_index, person, score): of a photo's faces that claim one person, the best; ties go to the earlier face."""
    order = W.partitionBy("photo_id", "person").orderBy(F.desc("score"), "face_index")
    return matches.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def carried(old: DataFrame, new: DataFrame, same_generation: bool = True, least: float = CARRY_IOU, alike: float = CARRY_COSINE, margin: float = CARRY_MARGIN) -> DataFrame:
    """(photo_id, old_id, new_id, iou): which face of a new detector run an old face of its photo became.

    Both sides: (photo_id, id, x, y, w, h, embedding). Boxes have to overlap, and vectors to agree if they are of one
    generation. An old face whose two best candidates are close gives up; a new face goes to the old one that overlaps it most.
    """
    from shutterlake.functions.scalars import cosine, iou

    side = lambda rows, p: rows.select("photo_id", *[F.col(c).alias(f"{p}{c}") for c in ("id", "x", "y", "w", "h", "embedding")])
    pairs = side(old, "old_").join(side(new, "new_"), "photo_id").withColumn("iou", iou("old_", "new_")).filter(F.col("iou") >= least)
    if same_generation:
        pairs = pairs.filter(cosine(F.col("old_embedding"), F.col("new_embedding")) >= alike)
    of_old = W.partitionBy("photo_id", "old_id").orderBy(F.desc("iou"), "new_id")
    sure = pairs.withColumn("n", F.row_number().over(of_old)).withColumn("next", F.lead("iou").over(of_old)).filter((F.col("n") == 1) & (F.col("next").isNull() | (F.col("iou") - F.col("next") >= margin)))
    of_new = W.partitionBy("photo_id", "new_id").orderBy(F.desc("iou"), "old_id")
    return sure.withColumn("m", F.row_number().over(of_new)).filter("m = 1").select("photo_id", "old_id", "new_id", "iou")


def decoded_cells(rows: DataFrame, least: float) -> DataFrame:
    """(photo_id, id, score, x, y, w, h): boxes of a detector's grids (photo_id, stride, columns, cls, obj, bbox as flat arrays) whose score, the root of cls * obj, is at least least."""
    cells = rows.select("photo_id", "stride", "columns", F.posexplode(F.arrays_zip("cls", "obj", "bbox")).alias("cell", "c"))
    clip: Callable[[Column], Column] = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    score = F.sqrt(clip(F.col("c.cls")) * clip(F.col("c.obj")))
    cx = (F.col("cell") % F.col("columns") + F.col("c.bbox")[0]) * F.col("stride")
    cy = (F.floor(F.col("cell") / F.col("columns")) + F.col("c.bbox")[1]) * F.col("stride")
    w, h = F.exp(F.col("c.bbox")[2]) * F.col("stride"), F.exp(F.col("c.bbox")[3]) * F.col("stride")
    boxes = cells.select("photo_id", F.struct("stride", "cell").alias("at"), score.alias("score"), (cx - w / 2).alias("x"), (cy - h / 2).alias("y"), w.alias("w"), h.alias("h")).filter(F.col("score") >= least)
    return boxes.withColumn("id", F.xxhash64("photo_id", "at")).drop("at")
