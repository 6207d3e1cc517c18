"""Operator 8, native: line deduplication against levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs) in the shared folder, bucketed and sorted by the
128-bit hash of a line's key. Each batch of documents is merge-anti-joined with the runs, so
that keys which are known to be common are not counted again, and adds its own run to
level 0. As soon as a level holds `fanout` runs they are merged, bucket by bucket and
without a shuffle, into one run of the next level, and deleted; n batches leave about
log(n) runs. A line's place in its document goes with its hash, so that what a document
loses is a list of places, and the text is cut in time linear in its lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACES, ascii_lower, dropped, scratch, table, written

MIN_DOCS = 10
BATCHES, FANOUT = 4, 2
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """The lines of a text, split at \\n. A null text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed(*columns: Column) -> tuple[Column, Column]:
    """128 bits of hash in two longs: the 64-bit hash under two seeds."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)


def keyed(docs: DataFrame, min_chars: int = 1, batches: int = 1) -> DataFrame:
    """(batch, r1, r2, at, h1, h2): each line of docs (doc_id, text) by its row and place, with the hash of its key.

    A key is the line stripped of white space at both ends, A-Z in lower case; lines of shorter keys than
    min_chars code points are left out. A row is known by its doc_id and text: rows equal in both are one document.
    """
    r1, r2 = hashed(F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(r1.alias("r1"), r2.alias("r2"), lines_of(F.col("text")).alias("lines"))
    rows = rows.select("r1", "r2", F.posexplode("lines").alias("at", "line")).select("r1", "r2", "at", ascii_lower(F.btrim("line", F.lit(SPACES))).alias("key")).filter(F.length("key") >= min_chars)
    h1, h2 = hashed(F.col("key"))
    return rows.select(F.pmod("r1", F.lit(batches)).cast("int").alias("batch"), "r1", "r2", "at", h1.alias("h1"), h2.alias("h2"))


def counted(postings: DataFrame) -> DataFrame:
    """(h1, h2, n_docs): in how many documents each key is."""
    return postings.groupBy(*KEY, "r1", "r2").agg(F.lit(1)).groupBy(*KEY).agg(F.count("*").alias("n_docs"))


class LineRuns:
    """Levelled runs of line hashes in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _sorted_run(self, counts: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", scratch(self.spark, "run")).format("parquet").saveAsTable(name)
        return name

    def _merged(self, runs: list[str]) -> DataFrame:
        """The runs as one. Of two runs each task merges one sorted bucket of either."""
        out = self.spark.table(runs[0])
        for name in runs[1:]:
            out = out.withColumnRenamed("n_docs", "n").join(self.spark.table(name).hint("merge"), KEY, "full_outer")
            out = out.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("n_docs", F.lit(0))).alias("n_docs"))
        return out

    def _deleted(self, runs: list[str]) -> None:
        for name in runs:
            run = self.spark.table(name)
            dropped(run)
            self.spark.sql(f"DROP TABLE {name}")

    def add(self, counts: DataFrame) -> None:
        """Adds a batch's (h1, h2, n_docs) as a run, and merges full levels."""
        level = 0
        self.levels[0].append(self._sorted_run(counts))
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            level += 1
            self.levels[level].append(self._sorted_run(self._merged(full)))
            self._deleted(full)

    def known(self, min_docs: int = 1) -> DataFrame | None:
        """Keys that the batches so far hold in at least min_docs documents; None before the first batch."""
        runs = [run for level in reversed(self.levels) for run in level]
        return self._merged(runs).filter(F.col("n_docs") >= min_docs).select(*KEY) if runs else None

    def deleted(self) -> None:
        """Deletes all runs, which nothing may read afterwards."""
        self._deleted([run for level in self.levels for run in level])
        self.levels = [[]]


def cut_out(docs: DataFrame, postings: DataFrame, known: DataFrame | None) -> DataFrame:
    """(row, kept, n_lines, n_dropped): each row of docs as a struct, and its text without the lines whose key is known.

    The postings meet the keys in a join that Spark can split where a key is hot, as a key
    is known once; the places that each document has to lose then join its text.
    """
    r1, r2 = hashed(F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"), r1.alias("r1"), r2.alias("r2"))
    if known is None:
        return rows.select("row", F.col("text").alias("kept"), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    lost = postings.join(known, KEY).groupBy("r1", "r2").agg(F.collect_set("at").alias("lost"))
    rows = rows.join(lost, ["r1", "r2"], "left").select("row", "text", "lost", lines_of(F.col("text")).alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    stay = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    return rows.select("row", F.when(F.col("lost").isNull(), F.col("text")).otherwise(stay).alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))


def columns_of(cut: DataFrame) -> DataFrame:
    """The rows of cut_out() with the columns of its input; kept, n_lines and n_dropped replace columns of these names."""
    new = ["kept", "n_lines", "n_dropped"]
    return cut.select(*[F.col("row")[c].alias(c) for c in cut.schema["row"].dataType.names if c not in new], *new)


def common_lines_cut(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """cut_out() of docs with the keys that min_docs documents hold. The documents enter the runs in batches, by the hash of their row."""
    path = scratch(docs.sparkSession, "postings")
    keyed(docs, min_chars, batches).write.partitionBy("batch").parquet(path)
    postings = docs.sparkSession.read.schema("batch int, r1 long, r2 long, at int, h1 long, h2 long").parquet(path)
    runs = LineRuns(docs.sparkSession, fanout)
    for b in range(batches):
        counts, common = counted(postings.filter(F.col("batch") == b)), runs.known(min_docs)
        # what is common already needs no more counts
        runs.add(counts if common is None else counts.join(common.hint("merge"), KEY, "left_anti"))
    known = written(runs.known(min_docs), "common")
    runs.deleted()
    return cut_out(docs, postings.drop("batch"), known)


def common_lines_dropped(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """docs with kept, n_lines and n_dropped: lines whose key min_docs documents hold go from every document.

    Null or empty text: one empty line, kept. Keys shorter than min_chars never go. Rows
    equal in doc_id and text count as one document and lose the same lines; others are
    documents of their own, those without a doc_id too. Extra columns pass through, whatever
    their names, but for those that the new ones replace. An empty table gives none.
    """
    return columns_of(common_lines_cut(docs, min_docs, min_chars, batches))


def new_lines_kept(runs: LineRuns, batch: DataFrame, min_chars: int = 1) -> DataFrame:
    """One step of a stream of batches: the batch without lines that earlier batches hold, as by common_lines_dropped(); then its own lines enter the runs."""
    postings = written(keyed(batch, min_chars), "postings")
    known = runs.known()
    out = written(columns_of(cut_out(batch, postings, known)), "cleaned")
    counts = counted(postings)
    runs.add(counts if known is None else counts.join(known.hint("merge"), KEY, "left_anti"))
    return out


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common_lines_dropped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
