"""Operator 3: toxicity severity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w . x - threshold_k): one weight for each word, shared by all
ordered thresholds. x holds log(1 + count) of the words and word beginnings that the fit
has selected, by their full 64-bit hash, so that a long text of rare words cannot run into
a toxic word's bucket. Beginnings stand for a stem's inflections and compounds. The severity is the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, written
from .language_id import held_out
from .text_arrays import NOT_WORD, Words, slices

#: Bounds of the fit: labelled documents of either kind, words kept as features, documents a word must be in.
PER_LABEL, FEATURES, MIN_DOCS = 2000, 512, 6
#: Lengths of word beginnings, in bytes.
HEADS = (4, 5, 6, 7)
GRADES = 3


@dataclass
class Model:
    """words: sorted hashes; weights: theirs; thresholds: ascending, one for each grade above 0."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each text, given as (words, counts), P(grade >= k) of each k from 1."""
        score = np.array([(self.weights[at] * np.log1p(n)).sum() for at, n in counts])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score.reshape(-1, 1), -60, 60)))


def word_counts(texts: pa.Array, only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each whole text its distinct words and word beginnings, letters and digits in lower case, and how often they occur: hashes, or numbers in `only`, to which they are then confined."""
    for _, _, data, offsets in slices(texts):
        words = Words(data, offsets, NOT_WORD)
        kinds = []
        for head in (0, *HEADS):
            h, first = words.hashes(True, head), words.first
            if only is not None:
                at = np.minimum(np.searchsorted(only, h), max(0, len(only) - 1))
                hit = np.flatnonzero(only[at] == h) if len(only) else np.zeros(0, np.int64)
                h, first = at[hit], np.searchsorted(hit, first)
            kinds.append((h, first))
        for i in range(len(offsets) - 1):
            yield np.unique(np.concatenate([h[first[i] : first[i + 1]] for h, first in kinds]), return_counts=True)


def cumulative_link(x: list[tuple[np.ndarray, np.ndarray]], n_features: int, grades: np.ndarray, top: int, ridge: float = 0.2, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by gradient steps on the penalised likelihood of the cumulative-link model. x: (feature numbers, counts) of each document."""
    row = np.repeat(np.arange(len(x)), [len(at) for at, _ in x])
    column = np.concatenate([at for at, _ in x] or [np.zeros(0, int)]).astype(int)
    value = np.log1p(np.concatenate([n for _, n in x] or [np.zeros(0)]))
    w, low, gaps = np.zeros(n_features), np.zeros(1), np.zeros(max(0, top - 1))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, low, gaps)]
    weight = np.where(grades > 0, len(grades) / (2 * max(1, (grades > 0).sum())), len(grades) / (2 * max(1, (grades == 0).sum())))
    for step in range(1, rounds + 1):
        theta = np.concatenate([low, low + np.cumsum(np.exp(gaps))])
        score = np.bincount(row, weights=w[column] * value, minlength=len(x))
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -60, 60)))  # P(grade >= 1), ..., P(grade >= top)
        padded = np.hstack([np.ones((len(x), 1)), above, np.zeros((len(x), 1))])
        own = np.maximum(np.take_along_axis(padded, grades[:, None], 1) - np.take_along_axis(padded, grades[:, None] + 1, 1), 1e-9)[:, 0]
        slope = np.hstack([np.zeros((len(x), 1)), above * (1 - above), np.zeros((len(x), 1))])
        at, after = np.take_along_axis(slope, grades[:, None], 1)[:, 0], np.take_along_axis(slope, grades[:, None] + 1, 1)[:, 0]
        by_score = weight * (at - after) / own  # of the log likelihood
        by_theta = np.zeros(top + 2)
        np.add.at(by_theta, grades, -weight * at / own)
        np.add.at(by_theta, grades + 1, weight * after / own)
        by_theta = by_theta[1:-1]
        by_w = np.bincount(column, weights=by_score[row] * value, minlength=n_features) - ridge * w
        by_gaps = np.cumsum(by_theta[1:][::-1])[::-1] * np.exp(gaps)
        for p, g, m in zip((w, low, gaps), (by_w / len(x), np.array([by_theta.sum() / len(x)]), by_gaps / len(x)), moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return w, np.concatenate([low, low + np.cumsum(np.exp(gaps))])


def selected_words(sample: DataFrame, n_positive: int, n_other: int, most: int, min_docs: int, least_odds: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """(words, log odds) from sample (toxic, h): the words in min_docs documents that mark toxic documents best, by the likelihood ratio, with at least least_odds times the odds there. At most `most` rows reach the driver.

    Words that mark the others are left out: a long clean text has many, and they would outweigh an insult.
    """
    seen = sample.select("toxic", F.explode("h").alias("word")).groupBy("word").agg(F.count(F.when(F.col("toxic"), 1)).alias("a"), F.count(F.when(~F.col("toxic"), 1)).alias("b"))
    p, q = F.col("a") / max(1, n_positive), F.col("b") / max(1, n_other)
    part = lambda x: F.when(x > 0, x * F.log(2 * x / (p + q))).otherwise(0.0)
    odds = F.log((F.col("a") + 0.5) / max(1, n_positive)) - F.log((F.col("b") + 0.5) / max(1, n_other))
    best = seen.filter(F.col("a") + F.col("b") >= min_docs).select("word", odds.alias("odds"), (part(p) + part(q)).alias("gain")).filter(F.col("odds") > float(np.log(least_odds)))
    found = best.orderBy(F.col("gain").desc(), "word").limit(most).collect()
    words = np.array([r["word"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([r["odds"] for r in found])[order] if found else np.zeros(0)


def graded(density: np.ndarray, toxic: np.ndarray, top: int) -> np.ndarray:
    """Severity grades from a yes-or-no label: 0 for documents that are not toxic; the toxic ones get 1 to top in equal parts by density, of words that mark toxic documents."""
    grades = np.zeros(len(toxic), int)
    rows = np.flatnonzero(toxic)
    order = rows[np.argsort(density[rows], kind="stable")]
    grades[order] = 1 + (np.arange(len(order)) * top) // max(1, len(order))
    return grades


def fit(docs: DataFrame, labels: DataFrame, top: int = GRADES, per_label: int = PER_LABEL) -> Model | None:
    """Fits the model on about per_label toxic and per_label other labelled documents, chosen by a hash of doc_id, none of them held out; equal texts count once, repeated labels too. None without both kinds.

    labels: (doc_id, toxic), and grade where severities are known: then toxic documents without a grade are left out, and a
    document that is not toxic has grade 0. Without the column they are made by graded(), out of fold: the sample has two
    halves, and a document's density is that of words with at least ten-fold odds in the other half. The chosen
    ids, some 2 * per_label, are broadcast, so that texts stay where they are; of ids that many different texts share, about
    as many texts stay. The driver gets the selected words and how often each chosen document has them, whatever the length of its text.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("toxic", F.col("toxic") > 0)
    given = "grade" in labels.columns
    grade = F.when(F.col("toxic"), F.col("grade").cast("int")).otherwise(0) if given else F.lit(None).cast("int")
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id"), "toxic").agg(F.max(grade).alias("grade"))
    if given:
        known = known.filter("grade is not null")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = lambda kind, most: min(1.0, most / max(1, sizes.get(kind, 0)))
    within = lambda place, most: F.pmod(place, F.lit(1 << 30)) < F.when(F.col("toxic"), share(True, most)).otherwise(share(False, most)) * (1 << 30)
    chosen = known.filter(within(F.xxhash64("_id", F.lit("sample")), per_label))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = list(word_counts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "toxic", "grade")], *[pa.array(x, pa.list_(pa.int64())) for x in ([h.view(np.int64) for h, _ in counts], [n for _, n in counts])]], ["doc_id", "toxic", "grade", "h", "n"])

    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic", "grade").mapInArrow(counted, "doc_id long, toxic boolean, grade int, h array<long>, n array<long>")
    once = rows.groupBy(F.xxhash64("h", "n").alias("same"), "toxic").agg(F.min_by(F.struct("doc_id", "grade", "h", "n"), F.struct("doc_id", "grade")).alias("r")).select("toxic", "same", "r.*")
    sample = written(once, "sample")
    counts = lambda df: {r["toxic"]: r["n"] for r in df.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sizes = counts(sample)
    if max(sizes.values(), default=0) > 4 * per_label:  # many texts of one id
        sample = written(sample.filter(within(F.xxhash64("same", F.lit("texts")), 2 * per_label)), "sample")
    kinds = counts(sample)
    if len(kinds) < 2:
        return None
    words, _ = selected_words(sample, kinds[True], kinds[False], FEATURES, MIN_DOCS)
    strong = []  # for the documents of each half, the telling words of the other
    for half in () if given else (0, 1):
        other = sample.filter(F.pmod("same", F.lit(2)) != half)
        of = counts(other)
        strong.append(selected_words(other, of.get(True, 0), of.get(False, 0), FEATURES, max(2, MIN_DOCS // 2), 10.0)[0])

    def confined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, density = [], []
            for same, h, n in zip(*[batch.column(c).to_pylist() for c in ("same", "h", "n")]):
                own, times = np.array(h, np.int64).view(np.uint64), np.array(n, np.int64)
                found.append(_inside(words, own, times))
                density.append(float(_inside(strong[same % 2], own, times)[1].sum() / max(1, times.sum())) if strong else 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("same", "toxic", "grade")], *[pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)], pa.array(density, pa.float64())], ["same", "toxic", "grade", "at", "n", "density"])

    found = sorted(sample.mapInArrow(confined, "same long, toxic boolean, grade int, at array<long>, n array<long>, density double").collect(), key=lambda r: (r["same"], r["toxic"]))
    toxic, inside = np.array([r["toxic"] for r in found], bool), [(np.array(r["at"], np.int64), np.array(r["n"], np.int64)) for r in found]
    grades = np.array([r["grade"] for r in found]) if given else graded(np.array([r["density"] for r in found]), toxic, top)
    if not grades.max():
        return None
    w, thresholds = cumulative_link(inside, len(words), grades, int(grades.max()))
    return Model(words, w, thresholds)


def _inside(words: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers in the sorted words, counts) of those of a document's words that are among them."""
    at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
    hit = words[at] == h if len(words) else np.zeros(len(h), bool)
    return at[hit], n[hit]


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, severity, grade, toxic, p_toxic) of each row of docs (doc_id, text), from its whole text.

    severity: the expected grade; grade: the likeliest; toxic: P(grade >= 1) is at least a half. A null
    text is an empty one. Without a model all are 0. Repeated rows and null doc_ids stay; other columns are
    left out, whatever their names; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if own is None:
                above = np.zeros((batch.num_rows, 1))
            else:
                above = own.chances(list(word_counts(batch.column("text"), own.words)))
            each = np.hstack([np.ones((len(above), 1)), above]) - np.hstack([above, np.zeros((len(above), 1))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(above.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= 0.5), pa.array(above[:, 0])], ["doc_id", "severity", "grade", "toxic", "p_toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(told, "doc_id long, severity double, grade int, toxic boolean, p_toxic double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
