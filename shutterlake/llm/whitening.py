"""Operator 11: whitening of embeddings by a polarisation covariance.

An entry c of a vector counts as the integer x = floor(64 c) + 1000000. Three passes of
numpy over Arrow batches, each giving a task's sums only:

1. the number of vectors n, and the sum S of each dimension;
2. for each dimension the sum of squares of centred values, and for each pair of dimensions
   the sum of squares of their sums. A covariance is half of what the pair's variance has more
   than both dimensions' (polarisation). Values are centred at the integer next to the mean, so all
   sums are exact integers; what that integer is off the mean is taken out exactly afterwards;
3. for the check, the covariance of the whitened values.

The driver gets sums by dimension and pair of dimensions, whose number hangs on the model that made the vectors, not on the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows that are worked on at once.
ROWS = 2048
#: Entries of 64 c from here on have no exact long; their rows are left out.
MOST = float(1 << 53)
#: An integer sum is given as high * LIMB + low, so that sums of sums stay exact.
LIMB = 1 << 60


def vectors(batch: pa.RecordBatch, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) of the usable vectors of a batch's column `vector`, of dims entries each, or else for each length; x as int64.

    Usable: neither null nor holding a null, a non-finite entry or one from MOST on. A row is its number in the batch.
    """
    column = batch.column("vector")
    sizes = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    values = pc.list_flatten(column)
    entries = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is NaN
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))[:-1]]) if len(sizes) else sizes
    for size in [dims] if dims else sorted(set(sizes[sizes > 0].tolist())):
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            own = np.floor(SCALE * entries[starts[part][:, None] + np.arange(size)])
            good = (np.abs(own) < MOST).all(axis=1)  # False for NaN
            if good.any():
                yield part[good], own[good].astype(np.int64) + SHIFT


def exact(values: np.ndarray, most: float) -> np.ndarray:
    """values, as Python integers if a result as large as most would not fit 64 bits."""
    return values if most < 2.0**62 else values.astype(object)


def limbs(value: int) -> tuple[int, int]:
    high, low = divmod(int(value), LIMB)
    return high, low


SUMS = "dims int, i int, j int, n long, high decimal(38,0), low decimal(38,0)"
KINDS = pa.schema([("dims", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("high", pa.decimal128(38)), ("low", pa.decimal128(38))])


def _given(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS.types)], schema=KINDS)


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy("dims", "i", "j").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))


def dimension_sums(rows: DataFrame) -> DataFrame:
    """(dims, i, j, n, high, low): n vectors of each length, and the sum of x of each dimension i."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in vectors(batch):
                size = x.shape[1]
                counts[size] = counts.get(size, 0) + len(x)
                total[size] = total.get(size, 0) + exact(x, float(np.abs(x).max()) * len(x)).sum(axis=0).astype(object)
        out = [(size, i, 0, counts[size], *limbs(s)) for size, own in total.items() for i, s in enumerate(own)]
        if out:
            yield _given(out)

    return _added(rows.mapInArrow(told, SUMS))


@dataclass
class Moments:
    """n vectors with sums S by dimension."""

    n: int
    sums: list[int]

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def middles(self) -> list[int]:
        """The integers next to the means."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rests(self) -> list[int]:
        """n times what the means have more than the middles."""
        return [s - self.n * m for s, m in zip(self.sums, self.middles)]


def moments(rows: DataFrame) -> Moments | None:
    """n and S of the vectors of the most frequent length, the smallest of equally frequent ones; None without vectors. Vectors of other lengths have no covariance with these and are left out."""
    sums = dimension_sums(rows)
    first = sums.groupBy("dims").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "dims").first()
    if first is None:
        return None
    own = {r["i"]: int(r["high"]) * LIMB + int(r["low"]) for r in sums.filter(F.col("dims") == first["dims"]).collect()}
    return Moments(first["n"], [own[i] for i in range(first["dims"])])


def pair_squares(rows: DataFrame, m: Moments) -> DataFrame:
    """(dims, i, j, n, high, low), i <= j: the sum of (d_i + d_j)^2, of d_i^2 where i is j; d is x without the middle."""
    middles, dims = np.array(m.middles, np.int64), m.dims

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dims, dims), object), 0
        for batch in batches:
            for _, x in vectors(batch, dims):
                d = x - middles
                d = np.ascontiguousarray(exact(d, 4.0 * float(np.abs(d).max()) ** 2 * len(d)).T)
                for i in range(dims):
                    total[i, i] += int((d[i] * d[i]).sum())
                    both = d[i + 1 :] + d[i]
                    total[i, i + 1 :] += (both * both).sum(axis=1).astype(object)
                n += len(x)
        if n:
            yield _given([(dims, i, j, n, *limbs(total[i, j])) for i in range(dims) for j in range(i, dims)])

    return _added(rows.mapInArrow(told, SUMS))


def covariance(rows: DataFrame, m: Moments) -> np.ndarray:
    """The covariance of x, divisor n, each entry the double next to the exact value."""
    found = {(r["i"], r["j"]): int(r["high"]) * LIMB + int(r["low"]) for r in pair_squares(rows, m).collect()}
    rest, n, dims = m.rests, m.n, m.dims
    # n * sum of (value - mean)^2, of a dimension and of the sum of two
    spread = {(i, j): n * s - (rest[i] + (rest[j] if i != j else 0)) ** 2 for (i, j), s in found.items()}
    out = np.zeros((dims, dims))
    for i in range(dims):
        out[i, i] = float(Fraction(spread[i, i], n * n))
        for j in range(i + 1, dims):
            out[i, j] = out[j, i] = float(Fraction(spread[i, j] - spread[i, i] - spread[j, j], 2 * n * n))
    return out


@dataclass
class Whitening:
    """Components as columns, by falling eigenvalue, and what turns x into whitened values."""

    m: Moments
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = (x - np.array(self.m.middles, np.int64)).astype(np.float64) - np.array([float(Fraction(r, self.m.n)) for r in self.m.rests])
        return centred @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum of (n x - S)^2 over dimensions; None if that is no long."""
        d = x - np.array(self.m.middles, np.int64)
        most = self.m.n * (float(np.abs(d).max()) + 1)
        kind = object if self.m.dims * most**2 >= 2.0**62 else np.int64
        z = d.astype(kind) * self.m.n - np.array(self.m.rests, kind)
        return [v if v < 1 << 63 else None for v in map(int, (z * z).sum(axis=1))]


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows (vector). Components along which the vectors do not spread, up to rounding, have no whitened values and are not among them; None if there are none at all."""
    m = moments(rows)
    if m is None:
        return None
    v = covariance(rows, m)
    values, columns = np.linalg.eigh(v)
    values, columns = values[::-1][:components], columns[:, ::-1][:, :components]
    spread = values > values[0] * m.dims * np.finfo(float).eps if values[0] > 0 else np.zeros(len(values), bool)
    if not spread.any():
        return None
    return Whitening(m, np.ascontiguousarray(columns[:, spread]), values[spread], values[spread] / np.trace(v))


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened values' covariance minus the identity, over all rows."""
    k = len(w.eigenvalues)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, k)), 0
        for batch in batches:
            for _, x in vectors(batch, w.m.dims):
                own = w.whitened(x)  # their mean is zero, as x is centred exactly
                total += own.T @ own
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k), pa.int32()), pa.array(np.tile(np.arange(k), k), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    off = F.abs(F.col("s") / w.m.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return rows.mapInArrow(told, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).agg(F.max(off)).first()[0]


WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each usable row of embeddings (vec_id, vector) once for each component.

    Left out: null vectors, vectors with null or non-finite entries or with entries of 2^47 and more, and vectors that have
    not the most frequent length. A deviation beyond a long is null. Rows with null or repeated vec_ids count each for
    itself; vectors that do not spread at all, one vector alone among them, and empty tables give no rows. Other columns are left out, whatever their names.
    """
    rows = embeddings.select("vec_id", "vector")
    w = fitted(rows.select("vector"), components)
    if w is None:
        return embeddings.sparkSession.createDataFrame([], WHITE)
    error, k = identity_error(rows.select("vector"), w), len(w.eigenvalues)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for at, x in vectors(batch, w.m.dims):
                n = len(x)
                every = lambda values, kind: pa.array(np.tile(values, n), kind)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(at, k))), every(np.arange(1, k + 1), pa.int32()), pa.array(np.full(n * k, w.m.n), pa.int64()), pa.array(w.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                     pa.array(w.whitened(x).ravel()), every(w.explained, pa.float64()), pa.array(np.full(n * k, error))],
                    [c.split()[0] for c in WHITE.split(", ")],
                )

    return rows.mapInArrow(told, WHITE)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))
