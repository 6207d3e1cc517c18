"""What the operators of this subpackage share: tables, the shared folder, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space as the contracts define it, as a Java regular expression's class and as characters.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\f\r"
#: Deletes the shuffle files of a query as it ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of its own where none is set, on a local master only (tests)."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{context.applicationId}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, losing executors loses nothing, and the shuffles behind it go at once."""
    spark = df.sparkSession
    path, before = scratch(spark, tag), spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files behind tables that written() made, which nothing may read afterwards, and lets Spark clean the shuffle files of finished plans, which it does as the driver collects garbage."""
    spark = tables[0].sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for table in tables for name in table.inputFiles()}:
        if f"/{spark.sparkContext.applicationId}/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are. Pure ASCII takes the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long ids: (id, component), component being the smallest id.

    Alternates the large-star and small-star steps, each a groupBy with map-side
    minimum, until every id hangs on its component alone, which one count by id tells. Only
    the number of ids that do not reaches the driver. Each round is written to the shared
    folder, so that lineage stays short. An id without links does not appear.
    """
    def unsettled(pairs: DataFrame) -> int:
        """Ids that hang on several others, or hang on one and are hung on."""
        ends = pairs.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up + down > 1").count()

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs if not larger else pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        joined = both.join(least, "u")
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if larger else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.filter("u <> v")

    high, low = F.greatest(a, b), F.least(a, b)
    now = written(links.select(high.cast("long").alias("u"), low.cast("long").alias("v")).filter("u <> v").distinct(), "links")
    while unsettled(now):
        then = written(star(star(now, True), False).distinct(), "links")
        dropped(now)
        now = then
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct().toDF("id", "component"))
