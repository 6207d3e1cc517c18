"""Operator 6: language identification by hierarchical discrimination.

Linear support vector machines tell language families apart, one against the rest; within the
family, one machine for each pair of its languages decides. Languages that no list
places are put into families by their mean trigram profiles, about as many families as each
has languages, so that n of them need about n^1.5 machines. Features are hashed byte
trigrams of the whole text, as relative frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import table
from .text_arrays import slices

BITS = 13
#: Bounds of the sample that the machines are fitted on: documents of a language, documents of all, and the least of a language whatever the second bound.
PER_LANGUAGE, SAMPLE, LEAST = 400, 20_000, 20
#: Rows whose trigrams are counted at once.
ROWS = 256
# fixed values: families of languages
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic"}
UNKNOWN = "und"
#: Where only one language is known, nothing is left to tell apart.
CERTAIN = 20.0

#: A sample as sparse rows: (buckets, frequencies) of each document.
Rows = list[tuple[np.ndarray, np.ndarray]]


def _folded() -> np.ndarray:
    """Bytes with A-Z as a-z and every other ASCII character as a space."""
    out = np.arange(256, dtype=np.uint32)
    out[:128] = 32
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, numbers of each text's first trigram and one more). Runs of spaces are left out; texts have a space at either end."""
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n + 2, 32, np.uint32)
    padded[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))] = _folded()[data]
    code = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:]
    letter = padded[1:-1] != 32
    keep = np.flatnonzero(letter)
    bucket = (code[keep] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return bucket, np.searchsorted(keep, offsets + 2 * np.arange(n + 1))


def svm(x: Rows, rows: np.ndarray, y: np.ndarray, size: int = 1 << BITS, cost: float = 1.0, rounds: int = 20, seed: int = 3) -> np.ndarray:
    """Weights and, last, bias of a linear machine with hinge loss on some of the sparse rows x, by dual coordinate descent. y: -1 or 1 for each of them; both classes weigh the same."""
    w, alpha, square = np.zeros(size + 1), np.zeros(len(rows)), np.array([1 + float(x[r][1] @ x[r][1]) for r in rows])
    most = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, own = x[rows[i]]
            new = min(max(alpha[i] - (y[i] * (w[at] @ own + w[-1]) - 1) / square[i], 0.0), most[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * own
                w[-1] += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w


def clustered(profiles: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """The number of each profile's cluster: spherical k-means from farthest-first centres."""
    unit = profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)
    centres = [0]
    near = unit @ unit[0]
    while len(centres) < k:
        centres.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[centres[-1]])
    middle = unit[centres]
    for _ in range(rounds):
        of = np.argmax(unit @ middle.T, 1)
        middle = np.array([unit[of == i].sum(0) if (of == i).any() else middle[i] for i in range(k)])
        middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-12)
    return np.argmax(unit @ middle.T, 1)


@dataclass
class Model:
    """Families of languages and their machines, each a column of weights with its bias as last row: root has one for each family, pairs one for each pair of a family's languages, in the order of combinations()."""

    families: list[list[str]]
    root: np.ndarray
    pairs: list[np.ndarray]

    def inner(self, x: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of the winning language of a family, by votes and then by its smallest margin, and that margin."""
        n, names = len(x), self.families[family]
        if len(names) == 1:
            return np.zeros(n, int), np.full(n, CERTAIN)
        margins = x @ self.pairs[family][:-1] + self.pairs[family][-1]
        votes, least = np.zeros((n, len(names))), np.full((n, len(names)), np.inf)
        for k, (i, j) in enumerate(combinations(range(len(names)), 2)):
            votes[:, i] += margins[:, k] < 0
            votes[:, j] += margins[:, k] >= 0
            least[:, i] = np.minimum(least[:, i], -margins[:, k])
            least[:, j] = np.minimum(least[:, j], margins[:, k])
        best = np.argmax(votes + 1e-6 * np.tanh(least), 1)
        return best, np.take_along_axis(least, best[:, None], 1)[:, 0]

    def predict(self, bucket: np.ndarray, first: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text, given as trigrams() gives them."""
        out, scores = [], [np.zeros(0)]
        for a in range(0, len(first) - 1, ROWS):
            own = first[a : a + ROWS + 1]
            n = len(own) - 1
            row = np.repeat(np.arange(n, dtype=np.int64), np.diff(own))
            x = np.bincount(row << BITS | bucket[own[0] : own[-1]], minlength=n << BITS).reshape(n, -1).astype(np.float32)
            x /= np.maximum(np.diff(own), 1)[:, None]
            if len(self.families) > 1:
                margins = x @ self.root[:-1] + self.root[-1]
                two = np.sort(margins, 1)[:, -2:]
                family, margin = np.argmax(margins, 1), (two[:, 1] - two[:, 0]) / 2
            else:
                family, margin = np.zeros(n, int), np.full(n, CERTAIN)
            names, score = np.full(n, "", object), 1 / (1 + np.exp(-2 * margin))
            for k in np.unique(family):
                rows = np.flatnonzero(family == k)
                best, least = self.inner(x[rows], k)
                names[rows] = np.array(self.families[k], object)[best]
                score[rows] *= 1 / (1 + np.exp(-2 * least))
            out += names.tolist()
            scores.append(np.clip(score, 0.0, 1.0))
        return out, np.concatenate(scores)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def families_of(langs: list[str], profiles: np.ndarray, families: dict[str, str]) -> list[list[str]]:
    """The languages in families: as listed, and the others by their profiles, in about the root of their number."""
    own: dict[str, list[str]] = {}
    rest = [i for i, lang in enumerate(langs) if lang not in families]
    of = clustered(profiles[rest], int(np.ceil(np.sqrt(len(rest))))) if rest else []
    for i, k in zip(rest, of):
        own.setdefault(f"cluster {k}", []).append(langs[i])
    for lang in langs:
        if lang in families:
            own.setdefault(families[lang], []).append(lang)
    return [own[name] for name in sorted(own)]


def fit(docs: DataFrame, families: dict[str, str] = FAMILIES, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """Fits the machines on a sample of docs (doc_id, text, lang) by a hash of doc_id and text, none of them held out; None without labelled documents.

    Of each language, about per_language documents, or as many as let all languages share `sample` documents, LEAST
    at any rate, and the one of least hash in any case: every language that a labelled text with a letter has is
    learned, however rare. Rows without a doc_id, or that share one, are chosen each by its text; rows
    equal in doc_id, text and lang count once. The sample's trigram counts reach the driver as sparse rows, some
    10 KB a document. The languages' names and counts do so too.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("place", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.lit("sample")))
    sizes = rows.groupBy("lang", "place").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect()
    if not sizes:
        return None
    each = max(LEAST, min(per_language, sample // len(sizes)))
    spark = docs.sparkSession
    # a share of all hashes from the least one up
    shares = spark.createDataFrame([(r["lang"], max(r["least"], min((1 << 63) - 1, -(1 << 63) + (each << 64) // r["n"]))) for r in sizes], "of_lang string, most long")
    # one row a language
    chosen = rows.join(F.broadcast(shares), F.col("lang") == F.col("of_lang")).filter(F.col("place") <= F.col("most"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offsets in slices(batch.column("text")):
                bucket, first = trigrams(data, offsets)
                for a, b in zip(first[:-1], first[1:]):
                    at, n = np.unique(bucket[a:b], return_counts=True)
                    found.append(at.astype("<u4").tobytes() + n.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("lang"), pa.array(found, pa.binary())], ["place", "lang", "counts"])

    found = chosen.select("place", "lang", "text").mapInArrow(counted, "place long, lang string, counts binary").dropDuplicates(["lang", "place"]).collect()
    found.sort(key=lambda r: (r["lang"], r["place"]))
    return fitted([r["lang"] for r in found], [np.frombuffer(r["counts"], "<u4").reshape(2, -1) for r in found], families)


def fitted(labels: list[str], counts: list[np.ndarray], families: dict[str, str] = FAMILIES) -> Model | None:
    """The machines for documents of these labels, given as (buckets, counts)."""
    if not labels:
        return None
    x = [(at.astype(np.int64), n / max(1, n.sum())) for at, n in counts]
    scale = 1 / max(1e-9, float(np.mean([np.linalg.norm(v) for _, v in x])))
    x = [(at, v * scale) for at, v in x]
    langs, truth = sorted(set(labels)), np.array(labels, object)
    profiles = np.zeros((len(langs), 1 << BITS), np.float32)
    number = {lang: i for i, lang in enumerate(langs)}
    for lang, (at, v) in zip(labels, x):
        profiles[number[lang], at] += v
    groups = families_of(langs, profiles, families)
    family_of = {lang: k for k, names in enumerate(groups) for lang in names}
    of = np.array([family_of[lang] for lang in labels])
    scaled = lambda w: np.append(w[:-1] * scale, w[-1]).astype(np.float32)
    every = np.arange(len(x))
    root = [scaled(svm(x, every, np.where(of == k, 1.0, -1.0))) for k in range(len(groups))] if len(groups) > 1 else []
    pairs = []
    for names in groups:
        own = []
        for a, b in combinations(names, 2):
            rows = np.flatnonzero((truth == a) | (truth == b))
            own.append(scaled(svm(x, rows, np.where(truth[rows] == b, 1.0, -1.0))))
        pairs.append(np.array(own, np.float32).T)
    return Model(groups, np.array(root, np.float32).T, pairs)


def told_rows(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, lang_pred, score): each row of docs as a struct, with its language from its whole text alone, whatever its doc_id."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    place = [c.lower() for c in docs.columns].index("text")  # the text travels once, within its row
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            langs, scores = [], []
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, offsets in slices(pc.struct_field(batch.column("row"), [place]).cast(pa.string())):
                found, score = own.predict(*trigrams(data, offsets)) if own else ([UNKNOWN] * (b - a), np.zeros(b - a))
                langs += [lang if ok else UNKNOWN for lang, ok in zip(found, letters[a:b])]
                scores.append(np.where(letters[a:b], score, 0.0))
            if langs:
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], ["row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(told, schema)


def tagged(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score of each row; columns of these names are replaced, all others pass through, whatever their names.

    und with score 0 where the text is null or has no letter, or where no model could be
    fitted. Repeated rows stay; an empty table gives none.
    """
    return told_rows(docs, model).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")], "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = tagged(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
