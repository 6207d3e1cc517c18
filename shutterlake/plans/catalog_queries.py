"""Catalog queries on the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shutterlake.functions import scalars as S
from shutterlake.operators import catalog as C
from shutterlake.sources.adapters import view, with_views

QUERIES, ORACLES = {}, {}
VOCABULARY = ["album", "print", "story"]


def query(oracle: str = "", *views: str):
    """Registers a query under its function's name; oracle: DuckDB SQL after the views' definitions."""
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            head = with_views(*views) if views else ""
            ORACLES[f.__name__] = f"{head}{', ' if head and oracle.lstrip().startswith('@') else ''}{oracle.lstrip().removeprefix('@')}"
        return f

    return keep


@query("""
SELECT folder_id, CAST(count(*) FILTER (NOT trashed AND NOT missing) AS BIGINT) AS total,
  CAST(count(*) FILTER (NOT trashed AND NOT missing AND rating > 0) AS BIGINT) AS starred, CAST(count(*) FILTER (NOT trashed AND NOT missing AND rating = 0) AS BIGINT) AS unstarred,
  CAST(count(*) FILTER (trashed) AS BIGINT) AS trashed, CAST(count(*) FILTER (missing AND NOT trashed) AS BIGINT) AS missing
FROM photos_v GROUP BY folder_id""", "photos_v")
def folder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.folder_stats(view(spark, sf_dir, "photos_v"))


@query("""@m(mode, lo, hi) AS (VALUES ('all',0,5),('unstarred',0,0),('starred',1,5),('star1',1,1),('star2',2,2),('star3',3,3),('star4',4,4),('star5',5,5),
  ('star1plus',1,5),('star2plus',2,5),('star3plus',3,5),('star4plus',4,5),('star5plus',5,5))
SELECT mode, folder_id, count(*) AS n, min(id) AS first_id FROM photos_v JOIN m ON rating BETWEEN lo AND hi GROUP BY mode, folder_id""", "photos_v")
def star_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = view(spark, sf_dir, "photos_v").select("folder_id", "id", "rating")
    modes = F.array(*[F.when(C.star_filter(m), F.lit(m)) for m in C.FILTER_MODES])
    rows = photos.select("folder_id", "id", F.explode(F.array_compact(modes)).alias("mode"))
    return rows.groupBy("mode", "folder_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""@ok AS (SELECT * FROM photos_v p WHERE NOT trashed AND NOT missing AND rating >= 1 AND list_contains(coalesce(tags, []), 'print')
    AND EXISTS (SELECT 1 FROM faces_v f WHERE f.photo_id = CAST(substr(p.id, 2) AS BIGINT) AND NOT f.ignored)),
r AS (SELECT folder_id, id, rating, row_number() OVER (PARTITION BY folder_id ORDER BY capture_ts ASC NULLS LAST, stem, id) - 1 AS pos, count(*) OVER (PARTITION BY folder_id) AS n FROM ok)
SELECT folder_id, id, CAST(rating AS BIGINT) AS rating, CAST(pos AS BIGINT) AS pos, CAST(n AS BIGINT) AS n FROM r WHERE pos BETWEEN 0 AND 19""", "photos_v", "faces_v")
def combined_view_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = view(spark, sf_dir, "photos_v")
    faces = view(spark, sf_dir, "faces_v").filter("not ignored").select(F.concat(F.lit("p"), F.lpad(F.col("photo_id").cast("string"), 15, "0")).alias("id"))
    rows = photos.filter(~F.col("trashed") & ~F.col("missing")).filter(C.star_filter("starred") & C.tag_filter("print")).join(faces, "id", "left_semi")
    rows = C.ranked(rows, "capture").join(rows.groupBy("folder_id").agg(F.count("*").alias("n")), "folder_id")
    return C.page(rows, 0, 12).select("folder_id", "id", F.col("rating").cast("long").alias("rating"), "pos", "n")


@query("""@o AS (SELECT *,
  row_number() OVER (PARTITION BY folder_id ORDER BY capture_ts ASC NULLS LAST, stem, id) - 1 AS capture, row_number() OVER (PARTITION BY folder_id ORDER BY capture_ts DESC NULLS FIRST, stem DESC, id DESC) - 1 AS capture_reverse,
  row_number() OVER (PARTITION BY folder_id ORDER BY stem, dir, id) - 1 AS name, row_number() OVER (PARTITION BY folder_id ORDER BY stem DESC, dir DESC, id DESC) - 1 AS name_reverse,
  row_number() OVER (PARTITION BY folder_id ORDER BY rating DESC, capture_ts ASC NULLS LAST, stem, id) - 1 AS rating_, row_number() OVER (PARTITION BY folder_id ORDER BY rating, capture_ts DESC NULLS FIRST, stem DESC, id DESC) - 1 AS rating_reverse
  FROM photos_v)
SELECT folder_id, id, capture, capture_reverse, name, name_reverse, rating_ AS by_rating, rating_reverse AS by_rating_reverse FROM o""", "photos_v")
def sort_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "photos_v")
    for sort in C.SORTS:
        for reverse in (False, True):
            rows = C.ranked(rows, sort, reverse, {"rating": "by_rating"}.get(sort, sort) + "_reverse" * reverse)
    return rows.select("folder_id", "id", "capture", "capture_reverse", "name", "name_reverse", "by_rating", "by_rating_reverse")


@query(r"""@k AS (SELECT DISTINCT ON (dir, name) *, dir||'/'||name AS path, CASE WHEN lower(name) LIKE '%.jpg' THEN 'jpeg' ELSE 'raf' END AS kind, regexp_replace(name, '\.[^.]*$', '') AS st FROM files_v ORDER BY dir, name, mtime, size),
g AS (SELECT folder_id, dir, lower(st) AS stem_key, max(path) FILTER (kind = 'jpeg') AS jpeg_path, max(path) FILTER (kind = 'raf') AS raf_path, count(*) AS n_files FROM k GROUP BY ALL)
SELECT folder_id, dir, regexp_replace(substr(coalesce(jpeg_path, raf_path), length(dir) + 2), '\.[^.]*$', '') AS stem, jpeg_path, raf_path, coalesce(jpeg_path, raf_path) AS primary_path, CAST(n_files AS BIGINT) AS n_files FROM g""", "files_v")
def pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pair_files(view(spark, sf_dir, "files_v")).select("folder_id", "dir", "stem", "jpeg_path", "raf_path", "primary_path", "n_files")


@query(r"""@s AS (SELECT DISTINCT folder_id, dir, upper(regexp_replace(name, '\.[^.]*$', '')) AS stem FROM files_v WHERE mtime % 5 <> 0),
c AS (SELECT folder_id, dir, stem, max(rating) AS rating, bool_or(trashed) AS trashed FROM photos_v WHERE hash_ok GROUP BY ALL)
SELECT folder_id, dir, stem, CASE WHEN c.rating IS NULL THEN 'new' WHEN s.stem IS NOT NULL THEN 'seen' WHEN c.trashed THEN 'trashed' ELSE 'missing' END AS state,
  CAST(coalesce(c.rating, 0) AS BIGINT) AS rating, coalesce(c.trashed, false) AS trashed
FROM s FULL JOIN c USING (folder_id, dir, stem)""".replace("WHERE hash_ok", "WHERE rating <> 3"), "files_v", "photos_v")
def reconcile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files_v").filter("mtime % 5 <> 0")
    scan = files.select("folder_id", "dir", F.upper(S.stem_of(F.col("name"))).alias("stem")).distinct()
    stored = view(spark, sf_dir, "photos_v").filter("rating <> 3").groupBy("folder_id", "dir", "stem").agg(F.max("rating").alias("rating"), F.bool_or("trashed").alias("trashed")).withColumn("tags", F.lit(None).cast("array<string>"))
    return C.reconcile(scan, stored, ["folder_id", "dir", "stem"]).select("folder_id", "dir", "stem", "state", F.col("rating").cast("long").alias("rating"), "trashed")


@query("""@s AS (SELECT (folder_id + CASE WHEN rating = 5 THEN 1 WHEN rating = 4 THEN 2 ELSE 0 END) % 20 AS folder_id, id FROM photos_v),
g AS (SELECT s.folder_id, p.folder_id AS owner, count(*) AS n FROM s JOIN photos_v p USING (id) WHERE s.folder_id <> p.folder_id GROUP BY ALL)
SELECT folder_id, owner, n, row_number() OVER (PARTITION BY folder_id ORDER BY n DESC, owner) AS rank FROM g""", "photos_v")
def foreign_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = view(spark, sf_dir, "photos_v")
    moved = F.when(F.col("rating") == 5, 1).when(F.col("rating") == 4, 2).otherwise(0)
    return C.foreign_owners(photos.select(((F.col("folder_id") + moved) % 20).alias("folder_id"), "id"), photos).withColumn("rank", F.col("rank").cast("long"))


@query("""@u AS (SELECT folder_id, tag, count(*) AS n FROM (SELECT folder_id, unnest(tags) AS tag FROM photos_v) GROUP BY ALL),
v(tag, place) AS (VALUES ('album', 0), ('print', 1), ('story', 2)), e AS (SELECT f.folder_id, v.tag, v.place FROM (SELECT DISTINCT folder_id FROM photos_v) f, v)
SELECT folder_id, tag, CAST(coalesce(n, 0) AS BIGINT) AS n, row_number() OVER (PARTITION BY folder_id ORDER BY place ASC NULLS LAST, tag) AS rank FROM e FULL JOIN u USING (folder_id, tag)""", "photos_v")
def tag_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tag_facet(view(spark, sf_dir, "photos_v"), VOCABULARY)


@query("""@r AS (SELECT folder_id, id, row_number() OVER (PARTITION BY folder_id ORDER BY capture_ts ASC NULLS LAST, stem, id) - 1 AS pos FROM photos_v WHERE NOT trashed AND NOT missing),
c AS (SELECT folder_id, count(*) // 2 AS cursor FROM r GROUP BY folder_id), s AS (SELECT *, CASE WHEN pos >= cursor THEN pos - cursor ELSE 3 * (cursor - pos) END AS priority FROM r JOIN c USING (folder_id))
SELECT folder_id, id, pos, cursor, priority, row_number() OVER (PARTITION BY folder_id ORDER BY priority, pos) AS rank, pos - cursor BETWEEN -3 AND 8 AS near FROM s""", "photos_v")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.ranked(view(spark, sf_dir, "photos_v").filter("not trashed and not missing"), "capture").select("folder_id", "id", "pos")
    cursors = rows.groupBy("folder_id").agg(F.floor(F.count("*") / 2).alias("cursor"))
    near = C.neighbourhood(rows, cursors).select("folder_id", "id", F.lit(True).alias("near"))
    out = C.prioritized(rows, cursors).join(near, ["folder_id", "id"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    return out.select("folder_id", "id", "pos", "cursor", "priority", "rank", "near")


@query("""@r AS (SELECT folder_id, id, row_number() OVER (PARTITION BY folder_id ORDER BY stem, dir, id) - 1 AS pos FROM photos_v), o AS (SELECT folder_id, id, rating AS place FROM photos_v WHERE rating >= 4)
SELECT folder_id, id, pos, row_number() OVER (PARTITION BY folder_id ORDER BY place ASC NULLS LAST, pos) - 1 AS overlay FROM r LEFT JOIN o USING (folder_id, id)""", "photos_v")
def order_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = view(spark, sf_dir, "photos_v")
    return C.overlaid(C.ranked(photos, "name").select("folder_id", "id", "pos"), photos.filter("rating >= 4").select("folder_id", "id", F.col("rating").alias("place")))


@query("""@g AS (SELECT folder_id AS cache, dir||'/'||lower(split_part(name, '.', 1)) AS id, CAST(sum(size) AS BIGINT) AS bytes, max(mtime) % 97 AS recency, min(mtime) % 11 = 0 AS spared FROM files_v GROUP BY ALL),
s AS (SELECT *, sum(bytes) OVER (PARTITION BY cache) AS total, coalesce(sum(CASE WHEN spared THEN 0 ELSE bytes END) OVER (PARTITION BY cache ORDER BY recency, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM g)
SELECT cache, id, bytes, recency, spared, NOT spared AND total - gone > 100000000 AS evict FROM s""", "files_v")
def evict_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files_v")
    stem = F.concat(F.col("dir"), F.lit("/"), F.lower(F.substring_index("name", ".", 1)))
    groups = files.groupBy(F.col("folder_id").alias("cache"), stem.alias("id")).agg(F.sum("size").alias("bytes"), (F.max("mtime") % 97).alias("recency"), (F.min("mtime") % 11 == 0).alias("spared"))
    return C.evictions(groups, 100_000_000, ["cache"])


@query("""@e AS (SELECT lpad(lower(hex(face_id)), 16, '0')||'-f'||CAST(face_index AS VARCHAR)||'.jpg' AS name FROM faces_v WHERE NOT ignored),
p AS (SELECT lpad(lower(hex(face_id)), 16, '0')||'-f'||CAST(face_index AS VARCHAR)||CASE WHEN face_id % 13 = 0 THEN 'r1.jpg' ELSE '.jpg' END AS name FROM faces_v WHERE face_id % 5 <> 0)
SELECT name, 'missing' AS state FROM e WHERE name NOT IN (SELECT name FROM p) UNION ALL SELECT name, 'stale' FROM p WHERE name NOT IN (SELECT name FROM e)""", "faces_v")
def artifact_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = view(spark, sf_dir, "faces_v")
    base = F.concat(F.lpad(F.lower(F.hex("face_id")), 16, "0"), F.lit("-f"), F.col("face_index").cast("string"))
    expected = faces.filter("not ignored").select(F.concat(base, F.lit(".jpg")).alias("name"))
    present = faces.filter("face_id % 5 <> 0").select(F.concat(base, F.when(F.col("face_id") % 13 == 0, "r1.jpg").otherwise(".jpg")).alias("name")).filter(S.is_artifact(F.col("name")))
    return C.audited(expected, present)


@query("""SELECT id, '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmp:Rating="'
  ||CAST(rating AS VARCHAR)||'">'||CASE WHEN len(coalesce(tags, [])) > 0 THEN '<dc:subject><rdf:Bag>'||array_to_string(list_transform(tags, lambda t: '<rdf:li>'||replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')||'</rdf:li>'), '')||'</rdf:Bag></dc:subject>' ELSE '' END
  ||'</rdf:Description></rdf:RDF></x:xmpmeta>' AS packet FROM photos_v""", "photos_v")
def xmp_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "photos_v").select("id", S.xmp_packet(F.col("rating"), F.col("tags")).alias("packet"))


@query("""SELECT folder_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (s.status = 'ok') AS BIGINT) AS scanned, CAST(count(*) FILTER (s.status = 'error' AND exhausted) AS BIGINT) AS errors,
  CAST(count(*) FILTER (s.status = 'error' AND NOT exhausted) AS BIGINT) AS retrying, CAST(count(*) FILTER (s.status IS NULL OR s.status = 'stale' OR (s.status = 'error' AND NOT exhausted)) AS BIGINT) AS pending
FROM photos_v p LEFT JOIN scans_v s ON s.photo_id = p.id WHERE NOT trashed AND NOT missing GROUP BY folder_id""", "photos_v", "scans_v")
def scan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.operators.identity import scan_progress as progress

    return progress(view(spark, sf_dir, "photos_v"), view(spark, sf_dir, "scans_v"))


@query("""@last AS (SELECT photo_id, max_by(to_rating, seq) AS rating FROM actions_v WHERE kind = 'rate' AND NOT undone GROUP BY photo_id),
gone AS (SELECT photo_id, max_by(kind, seq) = 'trash' AS trashed FROM actions_v WHERE kind IN ('trash', 'restore') AND NOT undone GROUP BY photo_id),
p AS (SELECT folder_id, id, coalesce(l.rating, p.rating) AS rating, coalesce(g.trashed, p.trashed) AS trashed, capture_ts, stem FROM photos_v p LEFT JOIN last l ON l.photo_id = CAST(substr(p.id, 2) AS BIGINT) LEFT JOIN gone g ON g.photo_id = CAST(substr(p.id, 2) AS BIGINT) WHERE NOT p.missing),
v AS (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY capture_ts ASC NULLS LAST, stem, id) - 1 AS pos, count(*) OVER (PARTITION BY folder_id) AS starred FROM p WHERE NOT trashed AND rating >= 3)
SELECT folder_id, id, CAST(rating AS BIGINT) AS rating, CAST(pos AS BIGINT) AS pos, CAST(starred AS BIGINT) AS starred FROM v""", "photos_v", "actions_v")
def starred_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.operators.journal import snapshot

    photos = view(spark, sf_dir, "photos_v").filter("not missing").withColumn("photo_id", F.substring("id", 2, 15).cast("long"))
    state = snapshot(view(spark, sf_dir, "actions_v")).select("photo_id", F.col("rating").alias("_rating"), F.col("trashed").alias("_trashed"))
    now = photos.join(state, "photo_id", "left").withColumn("rating", F.coalesce("_rating", "rating")).withColumn("trashed", F.coalesce("_trashed", "trashed"))
    rows = C.ranked(now.filter(~F.col("trashed")).filter(C.star_filter("star3plus")), "capture")
    counts = rows.groupBy("folder_id").agg(F.count("*").alias("starred"))
    return rows.join(counts, "folder_id").select("folder_id", "id", F.col("rating").cast("long").alias("rating"), "pos", "starred")
