"""Operator 4: quality by importance resampling.

Two generative models of hashed word n-grams (n = 1, 2), one of target text (documents
labelled good) and one of all raw text, give each document the logarithm of their
likelihood ratio. Adding Gumbel noise and keeping the k highest draws k documents without
replacement in proportion to that ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import table, written
from .text_arrays import Words, chains, slices

BITS = 16
#: Added to each bucket's count; the share of the raw model in the target model, so that no n-gram has an infinite ratio.
SMOOTH, BLEND = 1.0, 0.02
BINS = 4096


def buckets(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, first): for a slice of texts the buckets of all their unigrams and bigrams, text by text, and where each text begins."""
    for _, _, data, offsets in slices(texts):
        words = Words(data, offsets)
        one = words.hashes(False)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
        two = chains(one, 2)
        inside = np.flatnonzero(text[:-1] == text[1:]) if len(text) > 1 else np.zeros(0, np.int64)
        h = np.concatenate([one, two[inside]])
        of = np.concatenate([text, text[inside]])
        order = np.argsort(of, kind="stable")
        yield (h[order] >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(offsets) - 1))])


def counted(texts: DataFrame, bits: int = BITS, parts: int = 16) -> np.ndarray:
    """n-gram counts over all rows of texts (text); a task sends one fixed array, and these are added up in a few streams."""
    size = 1 << bits

    def sent(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([compress(total.astype("<i8").tobytes(), 1)], pa.binary())], ["counts"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at, _ in buckets(batch.column("text"), bits):
                total += np.bincount(at, minlength=size)
        if total.any():
            yield sent(total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(decompress(x), "<i8")
        yield sent(total)

    rows = texts.select("text").mapInArrow(told, "counts binary").repartition(parts).mapInArrow(added, "counts binary").collect()
    return sum((np.frombuffer(decompress(r["counts"]), "<i8") for r in rows), np.zeros(size, np.int64))


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(bucket | target) / P(bucket | raw), smoothed."""
    p = (raw + SMOOTH) / (raw.sum() + SMOOTH * len(raw))
    q = (target + SMOOTH * p * len(raw)) / (target.sum() + SMOOTH * len(raw))
    return np.log(((1 - BLEND) * q + BLEND * p) / p)


def weighed(docs: DataFrame, ratios: np.ndarray, bits: int = BITS) -> DataFrame:
    """(doc_id, n_grams, log_weight) of each whole text: the sum of its n-grams' log ratios. Null or empty text: 0 n-grams and weight 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
            for at, first in buckets(batch.column("text"), bits):
                total = np.concatenate([[0.0], np.cumsum(shared.value[at])])
                counts.append(np.diff(first))
                sums.append(total[first[1:]] - total[first[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(counts)), pa.array(np.concatenate(sums))], ["doc_id", "n_grams", "log_weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(told, "doc_id long, n_grams long, log_weight double")


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise from a hash of doc_id and seed: the same in every run."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def top_k(rows: DataFrame, keys: list[str], k: int, out: str, bins: int = BINS, enough: int = 10_000) -> DataFrame:
    """rows with out: whether a row is among the k first by keys, each a double and high values first; of equal keys the next one decides.

    Counts of equal-width bins narrow the k-th highest value down, pass by pass; the driver sees one pass's counts.
    Only the rows of the last bin are ranked, `enough` at most unless rows are equal in all keys.
    """
    n = rows.count()
    if not n or k >= n or k <= 0:
        return rows.withColumn(out, F.lit(k > 0))
    sure, last, above = F.lit(False), F.lit(True), 0
    for key in keys:
        bounds = rows.filter(last).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        lo, hi = bounds["lo"], bounds["hi"]
        while hi > lo and n > enough:
            width = (hi - lo) / bins
            number = F.least(F.floor((F.col(key) - lo) / width), F.lit(bins - 1))
            counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in rows.filter(last & F.col(key).between(lo, hi)).groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
            for b in sorted(counts, reverse=True):
                if above + counts[b][0] >= k:
                    break
                above += counts[b][0]
            n, lo, hi = counts[b]
        sure, last = sure | (last & (F.col(key) > hi)), last & F.col(key).between(lo, hi)
        if n <= enough:
            break
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*[F.col(key).desc() for key in keys]))
    ranked = rows.filter(last).withColumn(out, rank <= k - above)
    return rows.filter(~last).withColumn(out, sure).unionByName(ranked)


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, kept) of each row of docs (doc_id, text).

    labels: (doc_id, quality); quality 1 marks target text. k: documents to draw; by default the labelled rows' share
    of good ones, of all rows. key is log_weight plus Gumbel noise. Rows that repeat a doc_id share their
    noise. A null text has log_weight 0, a null doc_id has its own noise and is no target text. Without good labels all weights
    are 0 and the draw is uniform. Other columns are left out, whatever their names; an empty table gives none.
    """
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # raw text is counted where it lies; labels grow with the documents, so target text comes from a shuffled semi join at every size
    raw, target = counted(texts), counted(texts.join(good.hint("merge"), "doc_id", "left_semi"))
    ratios = log_ratios(raw, target) if target.sum() else np.zeros(len(raw))
    rows = weighed(texts, ratios)
    # ties go to the smaller doc_id, rows that share it to the one that was written first
    rows = written(rows.withColumn("key", F.col("log_weight") + gumbel(seed)).withColumn("by_id", F.coalesce(-F.col("doc_id").cast("double"), F.lit(float("-inf")))).withColumn("by_row", -F.monotonically_increasing_id().cast("double")), "weights")
    if k is None:
        share = labels.agg(F.avg((F.col("quality") == 1).cast("int")).alias("s")).first()["s"]
        k = round(rows.count() * (1.0 if share is None else share))
    return top_k(rows, ["key", "by_id", "by_row"], k, "kept").drop("by_id", "by_row")


def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
