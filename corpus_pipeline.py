"""From raw documents to packed training sequences, in stages of the operators in shutterlake.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again as the next stage's docs: a lost executor costs one stage at most.
All stages but the last return the columns of documents, and any others that docs has, whatever their
names: a stage carries its rows as structs beside what it computes. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shutterlake.llm import language_id, line_dedup, mixing, ngram_join, packing
from shutterlake.llm.common import table, written

#: A language that is less certain is rejected.
MIN_SCORE = 0.5
#: Near copies: shingles of so many words, a Jaccard similarity of at least so many percent. op1_ngram_join keeps its own contract's 4 and 85.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Bytes of rows that Python gets at once, about; a longer row is a batch of its own. Each running task holds a batch several times, in the JVM's heap, beside it and in Python.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or of an uncertain language go. Null texts go, null doc_ids and repeated rows are judged by their texts, and very long texts by the whole."""
    told = language_id.told_rows(docs, language_id.fit(docs))
    return told.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("row.*")


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold go from all of them; a document that loses all its lines stays, empty, and the mix takes nothing from it.

    A null text becomes an empty one. Rows equal in doc_id and text count as one document and all stay; rows without a doc_id are documents too.
    """
    told = line_dedup.common_lines_cut(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return told.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def keyed(docs: DataFrame) -> DataFrame:
    """(key, row): each row as a struct, and its own key, whatever its doc_id: a 64-bit hash of all columns and of which are null. Rows that are equal in all columns share it."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.xxhash64(*columns, *[c.isNull() for c in columns]).alias("key"), F.struct("*").alias("row"))


def field(name: str) -> Column:
    return F.col("row")[name].alias(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies by five-word shingles at 80 %, the row with the smallest doc_id stays, once.

    Every row is a document by its key: rows that share a doc_id, and rows without one, go only as near copies of another
    row, or if they equal it in all columns. Null doc_ids come last in a group; rows of one doc_id stand in order of
    their keys, so that reruns agree. Rows without words are copies of nothing but equal rows.
    """
    rows = keyed(docs)
    groups = ngram_join.joined(rows.select(F.col("key").alias("doc_id"), field("text")), ngram_join.ShingleSets(NEAR_WORDS), NEAR_PERCENT)
    members = rows.select("key", F.struct(field("doc_id").isNull(), field("doc_id"), "key").alias("place")).join(groups.select(F.col("doc_id").alias("key"), "component_id").distinct(), "key")
    stay = members.groupBy("component_id").agg(F.min_by("key", "place").alias("key")).select("key")
    return rows.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, to the nearest whole number.

    The mix deals rows by their keys, so that rows without a doc_id, or that share one, are taken each by its own words; equal
    rows are taken as often as all of them together. Null and empty texts are not taken; null is a source. The mix
    cuts at most one document of a shard, so rounding moves a source's words by half a document for each of its shards at most.
    """
    rows = keyed(docs)
    taken = mixing.mix(rows.select(F.col("key").alias("doc_id"), field("text"), field("source"))).filter("size > 0")
    copies = taken.groupBy(F.col("doc_id").alias("key")).agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("copies")).filter("copies > 0")
    return rows.dropDuplicates(["key"]).join(copies, "key").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row and their places in the sequences. Repeated rows are packed each for itself, null texts as one separator; null doc_ids stay null."""
    return packing.packed(docs.select("doc_id", "text"))


def in_small_batches(stage: Stage) -> Stage:
    """The stage with BATCH_BYTES set for its session. It stays set, as the caller writes what a stage returns; no result hangs on it."""
    def told(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_BYTES, BATCH)
        return stage(spark, docs, sf_dir)

    return told


STAGES = [
    ("language", in_small_batches(by_language)),
    ("line_dedup", in_small_batches(without_common_lines)),
    ("ngram_join", in_small_batches(one_of_each_group)),
    ("mixing", in_small_batches(mixed)),
    ("packing", in_small_batches(in_sequences)),
]

# mixing and packing cut by tokenizer ids and hashes, which SQL cannot express; tests hold run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


query = run
