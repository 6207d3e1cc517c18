"""Operator 7: document fingerprints by spot signatures.

Every common word (an anchor: a listed function word, or any very short word, as these are
function words in most languages) with the chain of the next content words after it is a
signature; a document's fingerprint is the set of its signatures. Function words are
dense in running text and rare in menus and advertisements, so the set follows the
prose. Sets are compared by Jaccard similarity. copies_of() joins fingerprints: sets are numbered by
length, listed under their rarest signatures, long lists are partitioned by set length, each part
with its neighbour, and pairs are ruled out by length before any signature is compared. It sees
fingerprints only, so the texts are not shuffled for it. The query's two likenesses of given pairs
are exact numbers, which nothing may prune.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import dropped, scratch, table
from .ngram_join import joined
from .text_arrays import NOT_WORD, Words, mixed, slices

CHAIN = 2
#: Words of so many bytes at most are anchors in any language.
SHORT = 3
BUCKET_MB = 64
#: Rows of about 20 bytes that are broadcast at most: heads of buckets. More are joined by a shuffle of the texts.
MOST_HEADS = 1_000_000
# fixed values: frequent function words of four languages
COMMON = {
    "en": "the of and to in a is that for it with as was on be by are this have from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
ANCHORS = sorted({w for words in COMMON.values() for w in words})


def _hashes_of(words: list[str]) -> np.ndarray:
    (_, _, data, offsets), = slices(pa.array(words))
    return np.sort(Words(data, offsets).hashes(True))


def signature_sets(texts: pa.Array, chain: int = CHAIN, anchors: list[str] = ANCHORS) -> list[np.ndarray]:
    """For each text its sorted distinct signatures (32 bits). A text with words but without a whole chain has one signature, of all its words; a text without words has none."""
    known, out = _hashes_of(anchors), []
    for _, _, data, offsets in slices(texts):
        words = Words(data, offsets, NOT_WORD)
        h = words.hashes(True)
        if not len(h):
            out += [np.zeros(0, np.uint32)] * (len(offsets) - 1)
            continue
        anchor = (known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) | (words.end - words.start <= SHORT)
        spots, content = np.flatnonzero(anchor), np.flatnonzero(~anchor)
        after = np.searchsorted(content, spots)
        whole = after + chain <= len(content)
        spots, after = spots[whole], after[whole]
        text_end = words.first[np.searchsorted(words.first, spots, "right")]
        inside = content[after + chain - 1] < text_end if len(spots) else np.zeros(0, bool)
        spots, after = spots[inside], after[inside]
        sig = h[spots]
        for k in range(chain):
            sig = mixed(sig + h[content[after + k]] * np.uint64(2 * k + 3))
        sig = (sig >> np.uint64(32)).astype(np.uint32)
        bounds = np.searchsorted(spots, words.first)
        for i in range(len(offsets) - 1):
            own = np.unique(sig[bounds[i] : bounds[i + 1]])
            a, b = words.first[i], words.first[i + 1]
            if not len(own) and b > a:
                all_words = h[a:b] * (2 * np.arange(b - a, dtype=np.uint64) + np.uint64(1))
                own = np.array([mixed(all_words.sum(keepdims=True))[0] >> np.uint64(32)]).astype(np.uint32)
            out.append(own)
    return out


def encoded(signatures: np.ndarray) -> str:
    """A fingerprint as text: the number of signatures and their sorted values, base64."""
    return f"{len(signatures)}:{base64.b64encode(signatures.astype('<u4').tobytes()).decode()}"


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without a look at them where their lengths alone keep it below at_least. Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_signatures) of each row of docs (doc_id, text).

    Null text: as an empty one, without signatures. Null doc_ids and repeated rows stay; very long texts count whole; other
    columns are left out, whatever their names; an empty table gives none.
    """
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = signature_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encoded(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "fingerprint", "n_signatures"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(told, "doc_id long, fingerprint string, n_signatures long")


class SpotSets:
    """Fingerprints as sets for the join: 64 bits a signature, sorted."""

    def __call__(self, fingerprints: pa.Array) -> Iterator[np.ndarray]:
        for own in fingerprints.to_pylist():
            yield np.sort(mixed(decoded(own or "").astype(np.uint64) + np.uint64(1)))


def copies_of(fingerprints: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles: signatures, component_id) of fingerprints (doc_id, fingerprint) whose sets have a Jaccard similarity of at least percent.

    A set is compared only with those of lengths that can reach the threshold, rarest signatures
    first; what is left is compared whole. Fingerprints without signatures, null ones too, link with nothing; other odd rows as in ngram_join.joined.
    """
    return joined(fingerprints.select("doc_id", F.col("fingerprint").alias("text")), SpotSets(), percent)


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of docs (doc_id, text), as a table in the shared folder."""
    path = scratch(docs.sparkSession, "fingerprints")
    found = fingerprinted(docs).select("doc_id", "fingerprint")
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """copies_of() the fingerprints of docs (doc_id, text)."""
    return copies_of(stored(docs), percent)


def components_of(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, component_id): one row for each doc_id of near_copies(), as a table in the shared folder. Rows that share a doc_id have the smallest component of them; null doc_ids have none."""
    prints = stored(docs)
    path = scratch(docs.sparkSession, "copies")
    found = copies_of(prints, percent).filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    found.write.parquet(path)
    dropped(prints)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def _larger(bounds: list[int], key: Column) -> Column:
    """How many of the descending bounds are above key: a binary search, bit by bit."""
    if not bounds:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    known = F.lit(bounds).cast("array<bigint>")
    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) > key, at + step).otherwise(at))


def with_next(docs: DataFrame, buckets: int | None = None, told: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text) so dealt that in each bucket the rows stand in descending order, each followed by its next document.

    told (doc_id, component_id), one row a doc_id: its rows, which have a null text, travel to the same buckets, each before the documents of its doc_id.

    Buckets are ranges of doc_id of about BUCKET_MB. The last row of a bucket has its next document in the
    following one, so each bucket ends with a copy (ghost) of that one's first row; the very last with the
    first row of all. Null doc_ids come last; rows of one doc_id stand in descending order of their texts. One
    shuffle of the texts; the driver sees two numbers a bucket.
    """
    spark, least = docs.sparkSession, -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if buckets is None:
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // (BUCKET_MB << 20))
    bounds = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)}, reverse=True) if buckets > 1 else []
    key = F.coalesce("doc_id", F.lit(least).cast("long"))
    rows = rows.withColumn("bucket", _larger(bounds, key))
    heads = {r["bucket"]: r["head"] for r in rows.groupBy("bucket").agg(F.max(key).alias("head")).collect()}
    order = sorted(heads)
    follows = spark.createDataFrame([(b, heads[b], order[i - 1]) for i, b in enumerate(order)], "at int, head long, before int")
    follows = F.broadcast(follows) if len(order) <= MOST_HEADS else follows
    # one row a bucket; the head's text goes to the bucket before
    ghosts = rows.join(follows, (F.col("bucket") == F.col("at")) & (key == F.col("head"))).groupBy("before", "doc_id").agg(F.max("text").alias("text"))
    no = F.lit(None).cast("long")
    both = rows.select("doc_id", "text", "bucket", F.lit(False).alias("ghost"), no.alias("component_id")).union(ghosts.select("doc_id", "text", "before", F.lit(True), no))
    if told is not None:
        both = both.union(told.select("doc_id", F.lit(None).cast("string"), _larger(bounds, F.col("doc_id")), F.lit(False), "component_id"))
    return both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "ghost", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_first())


def edited(text: str, following: str) -> str:
    """text with its last third (in code points) replaced by as much of the head of the following text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of with_next() as COMPARED: each document with its own next one, and the component that the row before its doc_id's documents tells, if there is one."""
    names = [c.split()[0] for c in COMPARED.split(", ")]
    told, last = (None, None), []
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            rows = last
            for i, text, ghost, component in zip(*(batch.slice(start, 1000).column(c).to_pylist() for c in ("doc_id", "text", "ghost", "component_id"))):
                if text is None:
                    told = (i, component)
                else:
                    rows.append((i, text, ghost, told[1] if i is not None and told[0] == i else None))
            last = rows[-1:]
            sets = signature_sets(pa.array([r[1] for r in rows], pa.string()))
            own = [k for k in range(len(rows) - 1) if not rows[k][2]]
            if not own:
                continue
            changed = [edited(rows[k][1], rows[k + 1][1]) for k in own]
            theirs = signature_sets(pa.array(changed, pa.string()))
            yield pa.RecordBatch.from_arrays([
                pa.array([rows[k][0] for k in own], pa.int64()), pa.array([len(rows[k][1]) for k in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([encoded(sets[k]) for k in own]), pa.array([encoded(s) for s in theirs]),
                pa.array([likeness(sets[k], s) for k, s in zip(own, theirs)], pa.float64()), pa.array([likeness(sets[k], sets[k + 1]) for k in own], pa.float64()),
                pa.array([rows[k][3] for k in own], pa.int64()),
            ], names)


def edited_and_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """COMPARED: each row of docs (doc_id, text) with its fingerprint, that of its edited text, their likeness, the likeness to the next document, and the group of near copies that its doc_id is in.

    Null text: as an empty one, likened as such, in a group of its own. Null doc_ids come last and have no group. Rows that share a doc_id are
    rows of their own with one group, the smallest of theirs. Very long texts count whole; other columns are left out, whatever their names; an empty table gives none.
    """
    return with_next(docs, buckets, components_of(docs)).mapInArrow(_compared, COMPARED)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_and_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
