"""Operator 10, native: mixing sources to target weights by Sainte-Laguë apportionment.

Every source's target becomes a number of equal-token blocks by the highest
quotients target / (2 j - 1). The same rule deals a source's blocks to its
shards, which are salted parts of its documents, so that a source with a third of
all rows spreads over many tasks. Within a shard the documents stand in a seeded
order and their words form one line, which is cut into blocks; the mix takes
whole passes over the line and then its first blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import WORD, table, written

BLOCK = 64
#: Documents of a shard, and the most shards of a source, as one task deals a source's blocks to its shards; shards of larger sources have more documents.
SHARD_ROWS, SHARDS = 4096, 10_000
REPEATS = 3
SALTS = 256


def sized(docs: DataFrame) -> DataFrame:
    """docs and size, its number of words (null text: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, ...) with the target of each source.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... A target is the smaller
    of repeats * source_size and weight * level. The level at which the targets
    share out all words follows from sorting sources by the level at which they
    are full: one prefix sum instead of rounds of resharing. One row a source.
    """
    w = sources.withColumn("weight", ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    w = w.withColumn("cap", F.lit(repeats) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = W.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy()
    w = w.withColumn("left_words", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0)) + F.col("cap"))
    w = w.withColumn("left_weight", F.sum("weight").over(every) - F.sum("weight").over(order) + F.col("weight"))
    w = w.withColumn("nth", F.count("*").over(order))
    level = F.col("left_words") / F.col("left_weight")  # if this source and all that fill up later are not full
    w = w.withColumn("level", F.min(F.when(level <= F.col("full_at"), F.struct(F.col("nth"), level.alias("level")))).over(every)["level"])
    return w.withColumn("target", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))).drop("cap", "full_at", "left_words", "left_weight", "level", "nth")


def apportioned(parts: DataFrame, key: list[str], vote: str, seats: str, order: list[str], out: str) -> DataFrame:
    """Sainte-Laguë: deals the seats of each key group to its rows by the highest quotients vote / (2 j - 1).

    With sum V of votes, N seats and S rows, all quotients of at least
    V / (2 N - S) belong to the N highest and none below V / (2 N + S) does. So each
    row surely wins its seats above the first bound, and only the few between both
    bounds (about two a row) are ranked. Ties go to the row first in order.
    """
    g = W.partitionBy(*key)
    p = parts.withColumn("_v", F.sum(vote).over(g)).withColumn("_s", F.count(F.when(F.col(vote) > 0, 1)).over(g))
    seat = lambda least: F.floor((F.col(vote) / least + 1) / 2)  # noqa: E731  seats of quotient at least that
    sure = F.when((F.col(vote) > 0) & (2 * F.col(seats) > F.col("_s")), seat(F.col("_v") / (2 * F.col(seats) - F.col("_s")) * 1.000000001)).otherwise(0)
    most = F.when(F.col(vote) > 0, seat(F.col("_v") / (2 * F.col(seats) + F.col("_s")) * 0.999999999) + 1).otherwise(0)
    p = p.withColumn("_sure", F.greatest(sure, F.lit(0)).cast("long")).withColumn("_most", most.cast("long"))
    p = p.withColumn("_open", F.col(seats) - F.sum("_sure").over(g))
    runs = p.select(*key, *order, vote, "_open", F.explode(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, "_most"))).alias("_j"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy((F.col(vote) / (2 * F.col("_j") - 1)).desc(), *[F.col(c).asc_nulls_last() for c in order], "_j"))
    names = list(dict.fromkeys([*key, *order]))
    won = runs.withColumn("_r", rank).filter("_r <= _open").groupBy(*[F.col(c).alias(f"_key_{c}") for c in names]).agg(F.count("*").alias("_won"))
    on = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in names]
    return p.join(won, on, "left").select(*parts.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias(out))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 7, shard_rows: int = SHARD_ROWS, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs (doc_id, text, source).

    Null or empty texts have size 0 and give nothing; sources without words get
    target 0. Repeated and null doc_ids are rows of their own, null is a source. Reruns agree, as shards and the order
    within hang on seed, doc_id and text alone: rows without a doc_id, or that share one, are dealt out by their texts. Other columns are left out, whatever their names. An
    empty table gives none. Texts are read once; the rest works on the written sizes.
    """
    base = written(sized(docs.select("doc_id", "text", "source")).select("doc_id", "source", "size", F.xxhash64("doc_id", "text").alias("mark")), "sizes")
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    goal = targets(by_source, repeats).withColumn("_all", F.lit(0))
    goal = goal.withColumn("blocks", F.round(F.sum("target").over(W.partitionBy("_all")) / block).cast("long"))
    quota = apportioned(goal, ["_all"], "target", "blocks", ["source"], "quota").drop("_all", "blocks", "weight")

    # a source may hold a third of all rows, so its quota, one row, is copied for each of SALTS parts of them
    salted = quota.withColumnRenamed("source", "_source").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    part = F.pmod(F.xxhash64(F.lit(seed + 2), "mark"), F.lit(SALTS))
    dealt = base.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (part == F.col("_part"))).drop("_source", "_part")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "mark"), F.least(F.ceil(F.col("source_rows") / shard_rows), F.lit(SHARDS))).cast("long"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    shards = apportioned(shards, ["source"], "shard_size", "quota", ["shard"], "blocks").select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "blocks")
    rows = dealt.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    line = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "mark"), "mark", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_end", F.sum("size").over(line)).withColumn("_words", F.least(F.col("blocks") * block, repeats * F.col("shard_size")))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("_words") / F.col("shard_size"))).otherwise(0)
    rest = F.col("_words") - passes * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(rest, F.col("_end")) - (F.col("_end") - F.col("size")))
    return rows.select("doc_id", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
