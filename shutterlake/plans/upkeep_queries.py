"""Queries of folder opening, metadata, detector grids and upkeep of scans and persons, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shutterlake.functions import scalars as S
from shutterlake.operators import catalog as C, identity as D, imaging as I, vectors as V
from shutterlake.plans.catalog_queries import query
from shutterlake.plans.identity_queries import faces
from shutterlake.plans.more_queries import NUM, number, photos
from shutterlake.sources.adapters import view


@query(r"""@k AS (SELECT DISTINCT folder_id, dir, dir||'/'||name AS path, CASE WHEN lower(name) LIKE '%.jpg' THEN 'jpeg' ELSE 'raf' END AS kind, regexp_replace(name, '\.[^.]*$', '') AS st FROM files_v),
g AS (SELECT folder_id, dir, regexp_replace(substr(coalesce(max(path) FILTER (kind = 'jpeg'), max(path) FILTER (kind = 'raf')), length(dir) + 2), '\.[^.]*$', '') AS stem FROM k GROUP BY folder_id, dir, lower(st)),
f AS (SELECT *, CAST(substr(stem, 5) AS BIGINT) AS n FROM g),
r AS (SELECT folder_id, dir, stem, CASE WHEN n % 3 <> 0 THEN n % 6 ELSE 0 END AS rating, n % 3 <> 0 AND n % 23 = 0 AS trashed, false AS missing FROM f UNION ALL SELECT folder_id, dir, 'GONE' || substr(stem, 5), n % 6, n % 2 = 0, n % 2 = 1 FROM f WHERE n % 7 = 0),
v AS (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY lower(stem), stem DESC, dir) - 1 AS pos FROM r WHERE NOT trashed AND NOT missing AND rating > 0),
c AS (SELECT folder_id, count(*) FILTER (NOT trashed AND NOT missing) AS total, count(*) FILTER (missing) AS missing FROM r GROUP BY folder_id)
SELECT folder_id, dir, stem, pos, total, c.missing AS missing FROM v JOIN c USING (folder_id)""", "files_v")
def opened_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings against a catalog that knows two thirds of them and photos that are gone: the starred photos in name order, and counts of found and missing ones."""
    files = view(spark, sf_dir, "files_v")
    n = F.substring("stem", 5, 15).cast("long")
    found = C.pair_files(files).select("folder_id", "dir", "stem", "id", n.alias("n"))
    tags = F.lit(None).cast("array<string>").alias("tags")
    known = found.filter("n % 3 <> 0").select("folder_id", "dir", "stem", "id", (F.col("n") % 6).cast("int").alias("rating"), tags, (F.col("n") % 23 == 0).alias("trashed"))
    gone = found.filter("n % 7 = 0").select("folder_id", "dir", F.concat(F.lit("GONE"), F.substring("stem", 5, 15)), F.concat(F.lit("gone-"), "id"), (F.col("n") % 6).cast("int"), tags, F.col("n") % 2 == 0)
    return C.opened(files, known.union(gone), "name", "starred").select("folder_id", "dir", "stem", "pos", "total", "missing")


@query(f"""@r AS (SELECT id, dir, CASE {NUM} % 4 WHEN 0 THEN dir WHEN 1 THEN '/root/f1' ELSE '/root/f' || folder_id END AS root FROM photos_v)
SELECT id, CASE WHEN dir = root THEN '' WHEN starts_with(dir, root || '/') THEN substr(dir, length(root) + 2) ELSE dir END AS relative FROM r""", "photos_v")
def relative_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders below their root, the root itself, and folders of another root whose name only begins alike."""
    root = F.when(number() % 4 == 0, F.col("dir")).when(number() % 4 == 1, "/root/f1").otherwise(F.concat(F.lit("/root/f"), F.col("folder_id").cast("string")))
    return photos(spark, sf_dir).select("id", C.relative_dir(F.col("dir"), root).alias("relative"))


@query("""@m AS (SELECT p_partkey AS photo_id, p_size AS n, 1 + p_partkey % 12 AS mo, 1 + p_partkey % 28 AS dd FROM part)
SELECT photo_id, CAST(CASE WHEN n % 5 = 0 THEN photo_id * 1000 ELSE CAST(date_diff('day', DATE '1970-01-01', make_date(2000 + n, mo, dd)) AS BIGINT) * 86400000 + 3723000 + n % 10 * 100 END AS BIGINT) AS capture_ms,
  CASE WHEN n % 5 <> 0 AND n % 8 >= 4 THEN 5152 ELSE 7728 END AS width, CASE WHEN n % 5 <> 0 AND n % 8 >= 4 THEN 7728 ELSE 5152 END AS height
FROM m JOIN photos_v p ON CAST(substr(p.id, 2) AS BIGINT) = photo_id WHERE NOT trashed""", "photos_v")
def photo_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture time and displayed size of photos that are not in the trash, from their documents; a fifth of these says nothing."""
    n, i = F.col("p_size"), F.col("p_partkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    parts = ['{"SourceFile":"x","ExifIFD:DateTimeOriginal":"', (2000 + n).cast("string"), ":", two(1 + i % 12), ":", two(1 + i % 28), ' 01:02:03","ExifIFD:SubSecTimeOriginal":"', (n % 10).cast("string"), '","IFD0:Orientation":', (n % 8 + 1).cast("string"), "}"]
    said = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    documents = spark.read.parquet(f"{sf_dir}/part.parquet").select(i.cast("long").alias("photo_id"), F.when(n % 5 == 0, '{"SourceFile":"x"}').otherwise(said).alias("doc"))
    rows = photos(spark, sf_dir).filter("not trashed").select(number().alias("photo_id"), F.lit(7728).alias("width"), F.lit(5152).alias("height"), number().alias("mtime"))
    return I.photo_metadata_job(documents, rows)


@query("""@t AS (SELECT *, seq % 5 <> 0 AND to_rating IS NOT NULL AS rated FROM actions_v)
SELECT seq, CASE WHEN kind = 'rate' AND rated THEN seq % 6 END AS rate_from, CASE WHEN kind = 'rate' AND rated THEN to_rating END AS rate_to, CASE WHEN kind = 'tags' AND seq % 5 <> 0 THEN 't' || (seq % 3) || ',b' END AS tags_to FROM t""", "actions_v")
def action_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What actions say: numbers of ratings, lists of tags, nothing for other kinds; a fifth of the texts is no JSON."""
    kind, seq = F.col("kind"), F.col("seq")
    rate = F.concat(F.lit('{"from":'), (seq % 6).cast("string"), F.lit(',"to":'), F.col("to_rating").cast("string"), F.lit("}"))
    tags = F.concat(F.lit('{"from":[],"to":["t'), (seq % 3).cast("string"), F.lit('","b"]}'))
    text = F.when(seq % 5 == 0, "oops").when(kind == "rate", rate).otherwise(tags)
    rows = view(spark, sf_dir, "actions_v").select("seq", S.payload(kind, text).alias("p"))
    return rows.select("seq", F.col("p.rate.from").cast("long").alias("rate_from"), F.col("p.rate.to").cast("long").alias("rate_to"), F.array_join("p.tags.to", ",").alias("tags_to"))


@query("""WITH e AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS cls, CAST(embedding[i + 17] AS DOUBLE) AS obj, CAST(embedding[i + 33] AS DOUBLE) AS dx, CAST(embedding[i + 49] AS DOUBLE) AS dy FROM (SELECT vec_id, embedding, unnest(range(16)) AS i FROM embeddings)),
s AS (SELECT vec_id, sqrt(least(1.0, greatest(0.0, cls)) * least(1.0, greatest(0.0, obj))) AS score, (i % 4 + dx) * 8 AS cx, (i // 4 + dy) * 8 AS cy, exp(cls / 2) * 8 AS w, exp(obj / 3) * 8 AS h FROM e)
SELECT vec_id AS photo_id, round(score, 6) AS score, round(cx - w / 2, 6) AS x, round(cy - h / 2, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM s WHERE score >= 0.1""")
def grid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of detector grids of four columns, made of the vectors' numbers."""
    at = lambda k: F.get("embedding", k).cast("double")
    cells = F.sequence(F.lit(0), F.lit(15))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("photo_id"), F.lit(8).alias("stride"), F.lit(4).alias("columns"), F.transform(cells, at).alias("cls"), F.transform(cells, lambda i: at(i + 16)).alias("obj"),
        F.transform(cells, lambda i: F.array(at(i + 32), at(i + 48), at(i) / 2, at(i + 16) / 3)).alias("bbox"),
    )
    return V.decoded_cells(rows, 0.1).select("photo_id", *[F.round(c, 6).alias(c) for c in ("score", "x", "y", "w", "h")])


@query("SELECT face_id FROM faces_v WHERE photo_id % 3 <> 0 AND photo_id % 5 <> 0", "faces_v")
def usable_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces whose scan is ok and of the current generation; those of stale scans and of another generation stay out."""
    rows, n = faces(spark, sf_dir), F.col("photo_id")
    scans = rows.select(n).distinct().select(n, F.when(n % 3 == 0, "stale").otherwise("ok").alias("status"), F.when(n % 5 == 0, "g1").otherwise("g2").alias("model_gen"))
    return D.usable(rows, scans, "g2").select("face_id")


@query("""@n AS (SELECT photo_id, CAST(substr(photo_id, 2) AS BIGINT) AS n FROM scans_v)
SELECT photo_id, CASE WHEN n % 4 = 1 THEN n + 5 ELSE n END AS mtime, CASE WHEN n % 4 = 1 THEN n * 2 ELSE n END AS size FROM n""", "scans_v")
def refreshed_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = number("photo_id")
    scans = view(spark, sf_dir, "scans_v").withColumn("mtime", n).withColumn("size", n)
    stats = scans.filter(n % 4 == 1).select("photo_id", (F.col("mtime") + 5).alias("mtime"), (F.col("size") * 2).alias("size"))
    return D.stats_refreshed(scans, stats).select("photo_id", "mtime", "size")


@query("""@p AS (SELECT DISTINCT CAST(person_id AS BIGINT) AS person_id FROM faces_v WHERE person_id IS NOT NULL),
n AS (SELECT trim(trim(CASE c_custkey % 3 WHEN 0 THEN chr(9) || 'PERSON ' || (c_custkey % 50) WHEN 1 THEN 'Guest ' || (c_custkey % 40) || ' ' ELSE '  ' END, chr(9))) AS name FROM customer),
k AS (SELECT lower(name) AS k, min(name) AS name FROM n WHERE name <> '' GROUP BY 1),
f AS (SELECT (SELECT coalesce(max(person_id), 0) FROM p) + row_number() OVER (ORDER BY k) AS person_id, name FROM k WHERE k NOT IN (SELECT 'person ' || person_id FROM p))
SELECT person_id, 'Person ' || person_id AS name FROM p UNION ALL SELECT person_id, name FROM f""", "faces_v")
def found_or_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons after names came in: known ones in other case and with white space, new ones, repeated ones, empty ones."""
    known = faces(spark, sf_dir).filter("person_id is not null").select("person_id").distinct().select("person_id", F.concat(F.lit("Person "), F.col("person_id").cast("string")).alias("name"))
    n = F.col("c_custkey")
    name = F.when(n % 3 == 0, F.concat(F.lit("\tPERSON "), (n % 50).cast("string"))).when(n % 3 == 1, F.concat(F.lit("Guest "), (n % 40).cast("string"), F.lit(" "))).otherwise("  ")
    return D.found_or_created(known, spark.read.parquet(f"{sf_dir}/customer.parquet").select(name.alias("name")))
