"""Queries that go through the library's own tables and files, written to the shared folder and read back, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shutterlake.functions import scalars as S
from shutterlake.operators import catalog as C, identity as D
from shutterlake.plans.catalog_queries import query
from shutterlake.plans.identity_queries import faces
from shutterlake.sources import files as T, versions as V
from shutterlake.sources.adapters import view
from shutterlake.sources.shared import scratch


@query(r"""@k AS (SELECT folder_id, dir, dir||'/'||name AS path, lower(name) LIKE '%.jpg' AS jpeg, lower(regexp_replace(name, '\.[^.]*$', '')) AS st FROM files_v),
g AS (SELECT folder_id, coalesce(max(path) FILTER (jpeg), max(path) FILTER (NOT jpeg)) AS path FROM k GROUP BY folder_id, dir, st)
SELECT folder_id, path, folder_id % 2 = 0 AND CAST(regexp_extract(path, '(\d+)\.[^.]*$', 1) AS BIGINT) % 3 = 0 AS missing FROM g""", "files_v")
def catalog_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after a scan of all folders, and one of every second folder that misses a third of its photos; the second comes twice, as after a failure."""
    path = scratch(spark, "catalog")
    found = C.pair_files(view(spark, sf_dir, "files_v"))
    again = found.filter((F.col("folder_id") % 2 == 0) & (F.substring("stem", 5, 15).cast("long") % 3 != 0))
    for number, scan in ((1, found), (2, again), (2, again)):
        V.upsert_scan(scan, path, number)
    return V.read_catalog(spark, path).select("folder_id", "path", "missing")


@query("SELECT folder_id, kind, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs, max(seq) AS last_seq FROM actions_v GROUP BY folder_id, kind", "actions_v")
def journal_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a journal holds after three appends."""
    path, actions = scratch(spark, "journal"), view(spark, sf_dir, "actions_v")
    for k in range(3):
        T.append_journal(actions.filter(F.col("seq") % 3 == k), path)
    return spark.read.schema(actions.schema).parquet(path).groupBy("folder_id", "kind").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"), F.max("seq").alias("last_seq"))


@query("""SELECT folder_id, CAST(count(*) FILTER (NOT trashed AND NOT missing) AS BIGINT) AS total, CAST(count(*) FILTER (NOT trashed AND NOT missing AND rating > 0) AS BIGINT) AS starred, CAST(count(*) FILTER (trashed) AS BIGINT) AS trashed
FROM photos_v GROUP BY folder_id""", "photos_v")
def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder counts, read back from a JSON report."""
    path = scratch(spark, "report")
    T.write_report(C.folder_stats(view(spark, sf_dir, "photos_v")), path)
    return spark.read.schema("folder_id long, total long, starred long, trashed long").json(path)


@query("""SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN 128 END AS n, CASE WHEN vec_id % 3 <> 0 THEN round(CAST(embedding[1] AS DOUBLE), 6) END AS first, CASE WHEN vec_id % 3 <> 0 THEN round(CAST(embedding[64] AS DOUBLE), 6) END AS last FROM embeddings""")
def embedding_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 128 numbers through their blobs and back; a third of the blobs is too short and gives none."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    given = F.when(F.col("vec_id") % 3 == 0, F.col("embedding")).otherwise(F.concat("embedding", "embedding")).cast("array<float>")
    back = rows.select("vec_id", S.floats_of(S.blob_of(given)).alias("v"))
    end = lambda k: F.round(F.get("v", k).cast("double"), 6)
    return back.select("vec_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("n"), end(F.lit(0)).alias("first"), end(F.lit(127)).alias("last"))


@query("SELECT p_partkey AS id, p_size || '-' || (p_size % 6) || printf('-[%02X, %02X, %02X]-[00, %02X, FF]', p_size % 256, p_size * 7 % 256, p_size * 11 % 256, p_size % 16) AS fingerprint FROM part")
def clipping_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The string that names clipping settings."""
    n = F.col("p_size").cast("int")
    bright, dark = F.array(n % 256, n * 7 % 256, n * 11 % 256), F.array(F.lit(0), n % 16, F.lit(255))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), S.clipping_fingerprint(n, n % 6, bright, dark).alias("fingerprint"))


@query("""@f AS (SELECT DISTINCT photo_id FROM faces_v WHERE person_id = 3 OR photo_id % 50 = 0)
SELECT photo_id FROM f WHERE NOT EXISTS (SELECT 1 FROM faces_v g WHERE g.photo_id = f.photo_id AND person_id = 3 AND NOT ignored)""", "faces_v")
def stray_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that a filter by a person lets through though no face there is that person's: other people's, and ignored faces."""
    rows = faces(spark, sf_dir)
    filtered = rows.filter((F.col("person_id") == 3) | (F.col("photo_id") % 50 == 0)).select("photo_id").distinct()
    return D.stray_filtered(filtered, rows, 3)
