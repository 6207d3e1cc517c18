"""Tables in the folder that driver and executors share, to cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir; in a folder of its own where none is set, on a local master only (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to a new path of the shared folder and read again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str, add: str | None = None, total: str | None = None) -> DataFrame:
    """df with name: each row's place in a total order, from 1; total: the sum of the column add over all rows before it.

    Rows are sorted in ranges, written, and counted range by range, so that no task sees more than a range; only one row a range is ordered in one task.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33)), "ranges")
    sums = rows.groupBy("_part").agg(F.count("*").alias("_n"), (F.sum(add) if add else F.lit(0)).alias("_sum"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    out = rows.join(sums, "_part").withColumn(name, F.col("_from") + F.col("_at") + 1)
    if add:
        own = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
        out = out.withColumn(total, F.col("_base") + F.coalesce(F.sum(add).over(own), F.lit(0)))
    return out.drop("_part", "_at", "_from", "_base")
