"""Sources and sinks of the catalog: file listings, metadata, settings, the catalog table, the journal, reports, sidecars."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, functions as F

from shutterlake.functions import scalars as S
from shutterlake.operators.rules import recipes_of_toml, rules_frame
from shutterlake.sources.listing import PhotoListing

# fixed values: settings, their ranges and defaults
SETTINGS = {
    "auto_assign_threshold": (0.0, 1.0, 0.45), "auto_assign_margin": (0.0, 1.0, 0.08), "cluster_threshold": (0.0, 1.0, 0.50), "min_det_score": (0.0, 1.0, 0.8),
    "soft_threshold": (0.0, 1e9, 0.0), "cache_budget_mb": (0.0, 1e7, 2048.0), "highlight": (0.0, 255.0, 250.0), "shadow": (0.0, 255.0, 5.0),
}


def scan(spark: SparkSession, root: str, depth: int | None = None) -> DataFrame:
    """(path, dir, name, mtime, size) of JPEG and RAF files under root. Folders are listed in parallel, no content is read. Names that begin with a dot are left out. depth: levels of folders that are partitions of their own."""
    spark.dataSource.register(PhotoListing)
    reader = spark.read.format("photo_listing").option("path", root)
    rows = (reader.option("depth", depth) if depth is not None else reader).load().dropDuplicates(["path"])
    return rows.withColumn("mtime", F.floor("mtime").cast("long")).filter(S.kind_of(F.col("name")).isNotNull())


def new_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the files that scan() would give, each once, in order of time and path; mtime with fractions."""
    spark.dataSource.register(PhotoListing)
    return spark.readStream.format("photo_listing").option("path", root).load()


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): one JSON document a file; a file that is no JSON object is {}."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))
    return rows.withColumn("doc", F.when(F.from_json("doc", "map<string,string>").isNotNull(), F.col("doc")).otherwise("{}"))


def settings(spark: SparkSession, text: str) -> DataFrame:
    """(name, value) of TOML settings; what is missing or out of range has its default."""
    given = tomllib.loads(text)
    rows = []
    for name, (low, high, default) in SETTINGS.items():
        value = given.get(name)
        good = isinstance(value, (int, float)) and not isinstance(value, bool) and low <= value <= high
        rows.append((name, float(value if good else default)))
    return spark.createDataFrame(rows, "name string, value double")


def rules(spark: SparkSession, text: str) -> DataFrame:
    return rules_frame(spark, recipes_of_toml(text))


def vocabulary(spark: SparkSession, text: str) -> DataFrame:
    """(tag, place) of the list `tags` in TOML, each once."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(dict.fromkeys(tomllib.loads(text).get("tags", [])))], "tag string, place int")


def upserted(catalog: DataFrame, pairs: DataFrame) -> DataFrame:
    """The catalog (id, folder_id, path, rating, tags, trashed, missing) with a scan's pairs: paths are new or refreshed, found photos are missing no more, verdicts stay."""
    p = pairs.select("id", F.col("folder_id").alias("_f"), F.col("primary_path").alias("_p"))
    rows = catalog.join(p, "id", "full")
    return rows.select(
        "id", F.coalesce("_f", "folder_id").alias("folder_id"), F.coalesce("_p", "path").alias("path"), F.coalesce("rating", F.lit(0)).alias("rating"), "tags",
        F.coalesce("trashed", F.lit(False)).alias("trashed"), F.when(F.col("_p").isNotNull(), False).otherwise(F.coalesce("missing", F.lit(False)) | ~F.coalesce("trashed", F.lit(False))).alias("missing"),
    )


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Overwrites a whole catalog of folders; small folders share tasks, large ones are split. See versions.upsert_scan for writes of some folders."""
    catalog.hint("rebalance", "folder_id").write.mode("overwrite").partitionBy("folder_id").parquet(path)


def append_journal(actions: DataFrame, path: str) -> None:
    actions.write.mode("append").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_sidecars(photos: DataFrame, path: str) -> None:
    """One line of text a photo: its XMP packet."""
    photos.select(S.xmp_packet(F.col("rating"), F.col("tags")).alias("value")).write.mode("overwrite").text(path)
