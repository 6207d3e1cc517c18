"""Latency statistics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shutterlake.sources.shared import written

#: Bins of one pass over brackets, and values of a bracket that are put in order at last.
BINS, FEW = 1024, 2000


def rounded_rank(values: Column, p: float) -> Column:
    """The percentile at index round(p (n - 1)) of a sorted array; null if it is empty."""
    return F.try_element_at(values, (F.floor(p * (F.size(values) - 1) + 0.5) + 1).cast("int"))


def rounded_ranks(values: DataFrame, ps: list[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(key, p, n, value): of the values (key, value) of each key and each p, the one at index round(p (n - 1)) in order. Nulls and NaNs do not count; a key without others has no row.

    Every key and p has a bracket of values that holds the one that is sought. A pass counts the values of all brackets
    in bins at once and narrows each to its bin; brackets of at most few values, or of one value, are done. No array and
    no task holds a key's values, and the number of passes hangs on how the values lie, not on how many they are.
    """
    rows = values.select("key", F.col("value").cast("double").alias("value")).filter("value is not null and not isnan(value)")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    now = sizes.select("key", F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p"), "n", "low", "high")
    now = written(now.select("key", "p", "n", F.floor(F.col("p") * (F.col("n") - 1) + 0.5).cast("long").alias("rank"), "low", "high", F.col("n").alias("inside")), "brackets")
    is_open = (F.col("low") < F.col("high")) & (F.col("inside") > few)
    side = lambda df: df.select(F.col("key").alias("_key"), *[c for c in df.columns if c != "key"])
    while not now.filter(is_open).isEmpty():
        met = rows.join(side(now.filter(is_open)), F.col("key").eqNullSafe(F.col("_key")) & F.col("value").between(F.col("low"), F.col("high")))
        span = F.col("high") / 2 - F.col("low") / 2  # halves, as the difference of two doubles may be none
        at = F.least(F.floor((F.col("value") / 2 - F.col("low") / 2) / span * bins), F.lit(bins - 1)).alias("bin")
        counts = met.groupBy("key", "p", at).agg(F.count("*").alias("c"), F.min("value").alias("_low"), F.max("value").alias("_high"))
        upto = counts.withColumn("before", F.sum("c").over(W.partitionBy("key", "p").orderBy("bin")) - F.col("c"))
        found = upto.join(side(now.filter(is_open)).select("_key", F.col("p").alias("_p"), "n", "rank"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("p") == F.col("_p"))).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
        narrowed = found.select("key", "p", "n", (F.col("rank") - F.col("before")).alias("rank"), F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("c").alias("inside"))
        now = written(now.filter(~is_open).unionByName(narrowed), "brackets")
    one = now.filter("low = high").select("key", "p", "n", F.col("low").alias("value"))
    met = rows.join(side(now.filter("low < high")), F.col("key").eqNullSafe(F.col("_key")) & F.col("value").between(F.col("low"), F.col("high")))
    picked = met.withColumn("_n", F.row_number().over(W.partitionBy("key", "p").orderBy("value")) - 1).filter(F.col("_n") == F.col("rank"))
    return one.unionByName(picked.select("key", "p", "n", "value"))


def latency_stats(samples: DataFrame, by: list[str]) -> DataFrame:
    """Flips, exact nearest-rank percentiles, maximum, and misses (not served from the bitmap cache) of latency_ms."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms)")
    return samples.groupBy(*by).agg(F.count("*").alias("flips"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.max("latency_ms").alias("max_ms"), F.count_if(F.col("served_from") != "bitmap-cache").alias("misses"))


def gated(stats: DataFrame, open_ms: Column | float = 0.0, p99: float = 50, most_open: float = 1000) -> DataFrame:
    """stats with gate: there were flips, p99 is within bounds, nothing missed, and the folder opened in time."""
    opened = open_ms if isinstance(open_ms, Column) else F.lit(open_ms)
    return stats.withColumn("gate", (F.col("flips") > 0) & (F.col("p99") <= p99) & (F.col("misses") == 0) & (opened <= most_open))


def last_samples(samples: DataFrame, by: list[str], n: int = 2000) -> DataFrame:
    """The newest n samples of each key."""
    return samples.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("seq")))).filter(F.col("_n") <= n).drop("_n")


def worker_averages(timings: DataFrame) -> DataFrame:
    """Milliseconds a photo of each step, from sums of microseconds."""
    return timings.groupBy("step").agg((F.sum("us") / 1000 / F.greatest(F.count("*"), F.lit(1))).alias("avg_ms"))
