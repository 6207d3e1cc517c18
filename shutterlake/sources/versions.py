"""The catalog table as versions: a write adds the folders that it touches, and counts once its number is committed.

    data/version=n/folder_id=f/   rows of the folders that version n touched
    touched/version=n/            these folders, also those that are empty now
    commits/version=n/            written last: without it version n does not exist

A folder's rows are those of the last committed version that touched it. Other folders keep their files. A write
that failed leaves the last version as it was; one that is repeated under its number replaces what it left, or does
nothing if it was committed. Files of overtaken versions stay until somebody deletes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from shutterlake.sources.files import upserted

CATALOG = "id string, folder_id long, path string, rating int, tags string, trashed boolean, missing boolean"
#: Rows of a file: a large folder is spread over as many as it needs.
ROWS = 1_000_000


def _there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """(version) of a table's committed writes; None before the first."""
    return _there(spark, f"{path}/commits", "version long")


def read_catalog(spark: SparkSession, path: str, schema: str = CATALOG) -> DataFrame:
    """The rows of a catalog as of its last committed version; without one, none."""
    commits = committed(spark, path)
    rows = _there(spark, f"{path}/data", f"{schema}, version long") if commits is not None else None
    if rows is None:
        return spark.createDataFrame([], schema)
    live = spark.read.schema("folder_id long, version long").parquet(f"{path}/touched").join(commits, "version", "left_semi").groupBy("folder_id").agg(F.max("version").alias("version"))
    return rows.join(live, ["folder_id", "version"], "left_semi").select(*[c.split()[0] for c in schema.split(", ")])


def write_folders(rows: DataFrame, touched: DataFrame, path: str, number: int, rows_a_file: int = ROWS) -> bool:
    """Writes rows, all there are now of the folders touched (folder_id), as version number. False, and nothing is done, if that is committed already.

    Folders share files' tasks by size: small ones meet, large ones are split. Rows without a folder_id have no place and are refused.
    """
    spark = rows.sparkSession
    commits = committed(spark, path)
    if commits is not None and not commits.filter(F.col("version") == number).isEmpty():
        return False
    checked = rows.withColumn("folder_id", F.when(F.col("folder_id").isNull(), F.raise_error(F.lit("a row without folder_id"))).otherwise(F.col("folder_id")))
    checked.hint("rebalance", "folder_id").write.mode("overwrite").partitionBy("folder_id").option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/data/version={number}")
    touched.select(F.col("folder_id").cast("long").alias("folder_id")).distinct().write.mode("overwrite").parquet(f"{path}/touched/version={number}")
    spark.range(1).select("id").write.mode("overwrite").parquet(f"{path}/commits/version={number}")
    return True


def upsert_scan(pairs: DataFrame, path: str, number: int, schema: str = CATALOG) -> bool:
    """A scan's pairs (id, folder_id, primary_path, ...) put into the catalog: the folders that the scan has are read, renewed and written as version number, no others are touched.

    An id belongs to one folder. A folder that the scan found empty has to be named by a row of a null id.
    """
    touched = pairs.select("folder_id").distinct()
    now = read_catalog(pairs.sparkSession, path, schema).join(touched, "folder_id", "left_semi")
    return write_folders(upserted(now, pairs.filter("id is not null")), touched, path, number)


def catalog_sink(path: str, schema: str = CATALOG) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of scans; a batch has whole folders."""
    def write(batch: DataFrame, number: int) -> None:
        pairs = batch.persist()
        upsert_scan(pairs, path, number, schema)
        pairs.unpersist()

    return write
