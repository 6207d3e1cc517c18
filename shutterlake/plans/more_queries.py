"""Further catalog, journal, face and scalar queries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shutterlake.functions import scalars as S
from shutterlake.operators import catalog as C, identity as D, imaging as I, journal as J, metrics as M
from shutterlake.plans.catalog_queries import query
from shutterlake.plans.identity_queries import faces, no_rejections
from shutterlake.plans.media_queries import RGB, pixels
from shutterlake.sources.adapters import view
from shutterlake.streaming.streams import retries_batch

NUM = "CAST(substr(id, 2) AS BIGINT)"


def number(column: str = "id"):
    return F.substring(column, 2, 15).cast("long")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "photos_v")


@query(f"SELECT id, CASE WHEN {NUM} % 5 = 0 THEN 'untrusted' WHEN {NUM} % 3 = 0 THEN 'changed' ELSE 'valid' END AS state FROM photos_v", "photos_v")
def artifact_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = photos(spark, sf_dir).select("id", number().alias("mtime"), (number() * 2).alias("size"))
    recorded = now.filter("mtime % 5 <> 0").select("id", F.when(F.col("mtime") % 3 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), "size")
    return C.artifact_state(now, recorded).select("id", "state")


@query(f"""@s AS (SELECT photo_id AS id, status, exhausted, CASE WHEN CAST(substr(photo_id, 2) AS BIGINT) % 11 = 0 THEN 'g1' ELSE 'g2' END AS gen FROM scans_v)
SELECT p.id FROM photos_v p LEFT JOIN s ON s.id = p.id WHERE p.rating <> 2 AND (status IS NULL OR status = 'stale' OR (status = 'error' AND (NOT exhausted OR gen <> 'g2')) OR (status = 'ok' AND gen <> 'g2'))""", "photos_v", "scans_v")
def needs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir)
    stat = rows.select("id", number().alias("mtime"), number().alias("size"))
    scans = view(spark, sf_dir, "scans_v").withColumn("mtime", number("photo_id")).withColumn("size", number("photo_id")).withColumn("model_gen", F.when(number("photo_id") % 11 == 0, "g1").otherwise("g2"))
    again = scans.filter("not exhausted").select(F.col("photo_id").alias("id"))
    return D.needs_scan(stat, scans, "g2", rows.filter("rating = 2").select("id"), again).select("id")


@query("""@r AS (SELECT folder_id, id, row_number() OVER (PARTITION BY folder_id ORDER BY stem, dir, id) - 1 AS pos FROM photos_v),
t AS (SELECT r.*, row_number() OVER (PARTITION BY folder_id ORDER BY pos) AS n FROM r JOIN photos_v p USING (folder_id, id) WHERE p.has_jpeg AND id NOT IN (SELECT photo_id FROM scans_v)) SELECT folder_id, id, pos FROM t WHERE n <= 5""", "photos_v", "scans_v")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.ranked(photos(spark, sf_dir), "name").select("folder_id", "id", "pos", "has_jpeg")
    return C.work_list(rows, view(spark, sf_dir, "scans_v").select(F.col("photo_id").alias("id")), rows.filter("has_jpeg"), 5).select("folder_id", "id", "pos")


@query("""@a AS (SELECT seq, a.folder_id, photo_id, EXISTS (SELECT 1 FROM photos_v p WHERE CAST(substr(p.id, 2) AS BIGINT) = a.photo_id AND p.folder_id = a.folder_id) AS own FROM actions_v a) SELECT seq, photo_id, own FROM a""", "photos_v", "actions_v")
def owned_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = photos(spark, sf_dir).select(number().alias("id"), "folder_id")
    good, bad = C.owned_actions(view(spark, sf_dir, "actions_v"), own)
    return good.select("seq", "photo_id", F.lit(True).alias("own")).unionByName(bad.select("seq", "photo_id", F.lit(False).alias("own")))


@query(f"SELECT id, CAST(CASE WHEN rating = 0 AND {NUM} % 2 = 0 THEN 4 ELSE rating END AS BIGINT) AS rating, CASE WHEN {NUM} % 2 = 0 THEN 7728 END AS width FROM photos_v", "photos_v")
def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir)
    facts = rows.filter(number() % 2 == 0).select("id", "capture_ts", F.lit(7728).alias("width"), F.lit(5152).alias("height"), F.lit(4).alias("adopted"))
    return C.merged_facts(rows, facts).select("id", F.col("rating").cast("long").alias("rating"), "width")


@query("SELECT lpad(lower(hex(photo_id)), 16, '0') AS photo_id, CAST(sum(100 + face_id) AS BIGINT) AS bytes, count(*) AS n FROM faces_v GROUP BY photo_id", "faces_v")
def artifact_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lpad(F.lower(F.hex("photo_id")), 16, "0"), F.lit("-f"), F.col("face_index").cast("string"), F.lit(".jpg"))
    return C.artifact_bytes(faces(spark, sf_dir).select(name.alias("name"), (100 + F.col("face_id")).alias("size")))


@query("""@r AS (SELECT folder_id, id, row_number() OVER (PARTITION BY folder_id ORDER BY stem, dir, id) - 1 AS pos FROM photos_v WHERE rating > 0),
s AS (SELECT folder_id, max(id) AS id, 40 + folder_id AS slot FROM photos_v GROUP BY folder_id), n AS (SELECT folder_id, count(*) AS n FROM r GROUP BY folder_id)
SELECT folder_id, coalesce(pos, greatest(0, least(slot, n - 1))) AS cursor, n FROM s LEFT JOIN r USING (folder_id, id) JOIN n USING (folder_id)""", "photos_v")
def resume_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir)
    saved = rows.groupBy("folder_id").agg(F.max("id").alias("id")).withColumn("slot", F.col("folder_id") + 40)
    return C.resumed(C.ranked(rows.filter("rating > 0"), "name"), saved)


@query("""@e AS (SELECT photo_id, seq, CASE cmd WHEN 'undo' THEN 'error' WHEN 'redo' THEN 'error' ELSE cmd END AS kind FROM commands_v),
d AS (SELECT photo_id, max(seq) AS ended FROM e WHERE kind = 'trash' GROUP BY photo_id), l AS (SELECT e.*, max(CASE WHEN kind IN ('rate', 'tags') THEN seq END) OVER (PARTITION BY photo_id) AS job FROM e LEFT JOIN d USING (photo_id) WHERE ended IS NULL OR seq > ended),
j AS (SELECT photo_id, max(job) AS job_seq, count(*) FILTER (kind = 'error' AND seq > job) >= 5 AS failed, arg_max('disk ' || seq, seq) FILTER (kind = 'error' AND seq > job AND seq % 3 > 0) AS last_error FROM l WHERE job IS NOT NULL GROUP BY photo_id)
SELECT CAST(count(*) FILTER (NOT failed) AS BIGINT) AS pending, CAST(count(*) FILTER (failed) AS BIGINT) AS failed, max(job_seq) FILTER (failed) AS last_job, arg_max(last_error, job_seq) FILTER (failed AND last_error IS NOT NULL) AS last_error FROM j""", "commands_v")
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("cmd").isin("undo", "redo"), "error").otherwise(F.col("cmd"))
    events = view(spark, sf_dir, "commands_v").select("photo_id", "seq", kind.alias("kind"), F.col("to_rating").alias("rating"), F.lit("").alias("tags"), F.lit(None).cast("long").alias("token"), F.when(F.col("seq") % 3 > 0, F.concat(F.lit("disk "), "seq")).alias("error"))
    return J.queue_status(J.outbox(events))


@query(f"SELECT id, CAST(rating AS BIGINT) AS rating FROM photos_v WHERE rating > 0 AND ({NUM} % 4 = 0 OR rating IS DISTINCT FROM CASE WHEN {NUM} % 4 = 1 THEN 5 ELSE rating END)", "photos_v")
def write_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir)
    written = rows.filter(number() % 4 != 0).select("id", F.when(number() % 4 == 1, 5).otherwise(F.col("rating")).alias("file_rating"))
    return J.backfill(rows.filter("rating > 0").select("id", "rating"), written).select("id", F.col("rating").cast("long").alias("rating"))


@query("SELECT folder_id, id AS photo_id, 'restore' AS kind FROM photos_v WHERE trashed AND has_jpeg AND rating <> 1", "photos_v")
def external_restores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir).withColumn("trash_path", F.concat(F.lit("/trash/"), "id")).withColumn("original_path", F.concat(F.lit("/root/"), "id"))
    listing = rows.filter("has_jpeg").select(F.col("original_path").alias("path")).union(rows.filter("rating = 1").select("trash_path"))
    trashed = rows.filter("trashed").select(F.col("id").alias("photo_id"), "folder_id", "trash_path", "original_path")
    return J.external_restores(trashed, listing)


@query("SELECT folder_id, max_by(kind, seq) AS sort, max_by(undone, seq) AS reverse, max_by(to_rating, seq) AS \"filter\", max_by(photo_id, seq) AS cursor_id, max(seq) AS recency FROM actions_v GROUP BY folder_id", "actions_v")
def view_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.view_states(view(spark, sf_dir, "actions_v").select("folder_id", F.col("kind").alias("sort"), F.col("undone").alias("reverse"), F.col("to_rating").alias("filter"), F.col("photo_id").alias("cursor_id"), F.col("seq").alias("ts")))


@query("SELECT photo_id, array_to_string(list_sort(list(DISTINCT CAST(person_id AS BIGINT))), ',') AS persons FROM faces_v WHERE person_id IS NOT NULL AND NOT ignored GROUP BY photo_id", "faces_v")
def persons_of_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.persons_of_photos(faces(spark, sf_dir)).withColumn("persons", F.array_join(F.transform("persons", lambda p: p.cast("string")), ","))


@query("SELECT face_id, rank FROM (SELECT face_id, row_number() OVER (PARTITION BY person_id ORDER BY det_score DESC, face_id) AS rank FROM faces_v WHERE person_id IS NOT NULL AND NOT ignored) WHERE rank <= 10", "faces_v")
def top_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_faces(faces(spark, sf_dir), 10).select("face_id", "rank")


@query("""@p AS (SELECT DISTINCT photo_id, photo_id % 3 <> 0 AS ok FROM faces_v UNION ALL SELECT -1, true), l AS (SELECT photo_id, list(face_id ORDER BY face_id) FILTER (person_id IS NOT NULL) AS named, list(face_id ORDER BY face_id) FILTER (person_id IS NULL) AS unnamed FROM faces_v WHERE NOT ignored GROUP BY photo_id)
SELECT photo_id, CASE WHEN ok THEN coalesce(array_to_string(named, ','), '') END AS named, CASE WHEN ok THEN coalesce(array_to_string(unnamed, ','), '') END AS unnamed FROM p LEFT JOIN l USING (photo_id)""", "faces_v")
def faces_of_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = faces(spark, sf_dir)
    every = rows.select("photo_id").distinct().union(spark.range(1).select(F.lit(-1).cast("long")))
    scans = every.select("photo_id", F.when(F.col("photo_id") % 3 != 0, "ok").otherwise("stale").alias("status"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return D.faces_of_photos(every, scans, rows).select("photo_id", listed("named"), listed("unnamed"))


@query("""@x AS (SELECT face_id, unnest([3, 5]) AS person_id FROM faces_v WHERE face_id % 9 = 0), e AS (SELECT face_id, CASE WHEN face_id % 8 = 0 THEN NULL ELSE 3 END AS t FROM faces_v WHERE face_id % 4 = 0),
d AS (SELECT f.face_id, f.person_id FROM faces_v f JOIN e USING (face_id) WHERE f.person_id IS NOT NULL AND f.person_id IS DISTINCT FROM t)
SELECT 'face' AS part, f.face_id, CAST(CASE WHEN e.face_id IS NULL THEN person_id ELSE t END AS BIGINT) AS person_id, CASE WHEN e.face_id IS NULL THEN assigned_by WHEN t IS NOT NULL THEN 'user' END AS assigned_by FROM faces_v f LEFT JOIN e USING (face_id)
UNION ALL SELECT 'rejection', face_id, person_id, NULL FROM (SELECT * FROM x UNION SELECT * FROM d) r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.face_id = r.face_id AND e.t = r.person_id)""", "faces_v")
def name_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = faces(spark, sf_dir)
    edits = rows.filter("face_id % 4 = 0").select("face_id", F.when(F.col("face_id") % 8 != 0, F.lit(3)).cast("long").alias("to_person"))
    out, no = D.named(rows, no_rejections(spark, sf_dir), edits, 10**9)
    return out.select(F.lit("face").alias("part"), "face_id", "person_id", "assigned_by").union(no.select(F.lit("rejection"), "face_id", "person_id", F.lit(None).cast("string")))


@query("SELECT face_id, ignored OR face_id % 6 = 0 AS ignored, CAST(CASE WHEN face_id % 6 <> 0 THEN person_id END AS BIGINT) AS person_id FROM faces_v", "faces_v")
def ignore_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = faces(spark, sf_dir)
    return D.ignored(rows, rows.filter("face_id % 6 = 0")).select("face_id", "ignored", "person_id")


@query("""@f AS (SELECT face_id, photo_id, person_id, CASE WHEN person_id IS NOT NULL THEN CASE WHEN face_id % 2 = 0 THEN 'auto' ELSE 'user' END END AS who FROM faces_v)
SELECT face_id, CAST(CASE WHEN photo_id % 4 = 1 AND who = 'auto' THEN NULL ELSE person_id END AS BIGINT) AS person_id, CASE WHEN photo_id % 4 = 1 AND who = 'auto' THEN NULL ELSE who END AS assigned_by FROM f""", "faces_v")
def clear_autos(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.when(F.col("person_id").isNotNull(), F.when(F.col("face_id") % 2 == 0, "auto").otherwise("user"))
    rows = faces(spark, sf_dir).withColumn("assigned_by", by)
    folders = rows.select("photo_id", (F.col("photo_id") % 4).alias("folder_id")).distinct()
    return D.autos_cleared(rows, folders, 1).select("face_id", "person_id", "assigned_by")


@query("""SELECT photo_id, CASE WHEN CAST(substr(photo_id, 2) AS BIGINT) % 3 = 1 AND status = 'ok' THEN 'stale' ELSE status END AS status FROM scans_v""", "scans_v")
def adopt_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    generations = spark.createDataFrame([("g1", 1, "h1"), ("g2", 2, "h2"), ("g3", 3, "h2")], "gen string, release int, hash string")
    scans = view(spark, sf_dir, "scans_v").withColumn("model_gen", F.when(number("photo_id") % 3 == 1, "g1").otherwise("g2"))
    return D.generation_adopted(scans, generations).select("photo_id", "status")


@query("""SELECT photo_id, CASE WHEN CAST(substr(photo_id, 2) AS BIGINT) % 4 = 0 THEN 'error' WHEN CAST(substr(photo_id, 2) AS BIGINT) % 4 = 1 THEN 'stale' ELSE status END AS status,
  CAST(1 + CASE WHEN CAST(substr(photo_id, 2) AS BIGINT) % 4 = 0 THEN 1 ELSE 0 END AS INT) AS attempts FROM scans_v""", "scans_v")
def scan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = view(spark, sf_dir, "scans_v").withColumn("attempts", F.lit(1)).withColumn("last_error", F.lit(None).cast("string"))
    failed = scans.filter(number("photo_id") % 4 == 0).select("photo_id", F.lit("decode").alias("message"))
    return D.marked_stale(D.scan_failed(scans, failed), scans.filter(number("photo_id") % 4 == 1)).select("photo_id", "status", "attempts")


@query(f"""SELECT id, {NUM} % 7 <> 0 AND {NUM} % 5 <> 0 AS accepted, CAST(CASE WHEN {NUM} % 7 <> 0 AND {NUM} % 5 <> 0 THEN 2 ELSE 1 END AS BIGINT) AS revision FROM photos_v""", "photos_v")
def guarded_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = photos(spark, sf_dir).select(F.col("id").alias("photo_id"), (number() % 7 != 0).alias("enabled"), F.lit(1).alias("epoch"), F.lit("g").alias("generation"), F.lit(1).cast("long").alias("revision"), number().alias("mtime"), number().alias("size"))
    results = state.drop("enabled").withColumn("size", F.when(F.col("mtime") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    good, bad = D.committed(results, state)
    pick = lambda d, ok: d.select(F.col("photo_id").alias("id"), F.lit(ok).alias("accepted"), "revision")
    return pick(good, True).unionByName(pick(bad, False))


@query(RGB + " SELECT photo_id, round(count(*) FILTER (greatest(r, g, b) >= 250) / count(*), 6) AS highlights, round(count(*) FILTER (greatest(r, g, b) <= 5) / count(*), 6) AS shadows FROM q GROUP BY photo_id", "pixels_v")
def clipped_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.clipped_share(pixels(spark, sf_dir)).select("photo_id", F.round("highlights", 6).alias("highlights"), F.round("shadows", 6).alias("shadows"))


@query("""@p AS (SELECT photo_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, 2.0 * x + val / 100.0 AS u, 2.0 * y - val / 50.0 AS v FROM pixels_v),
s AS (SELECT photo_id, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(x, u) AS xu, covar_pop(x, v) AS xv, covar_pop(y, u) AS yu, covar_pop(y, v) AS yv, var_pop(x) + var_pop(y) AS var FROM p GROUP BY photo_id), t AS (SELECT *, (xu + yv) / var AS p, (xv - yu) / var AS q FROM s)
SELECT photo_id, round(p, 8) AS a, round(q, 8) AS c, round(mu - (p * mx - q * my), 8) AS tx, round(mv - (q * mx + p * my), 8) AS ty FROM t""", "pixels_v")
def similarity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    points = view(spark, sf_dir, "pixels_v").select("photo_id", d("x").alias("x"), d("y").alias("y"), (2 * d("x") + d("val") / 100).alias("u"), (2 * d("y") - d("val") / 50).alias("v"))
    return I.similarity_fit(points, "photo_id").select("photo_id", *[F.round(c, 8).alias(c) for c in ("a", "c", "tx", "ty")])


@query("SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM perf_v) WHERE n <= 20", "perf_v")
def last_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.last_samples(view(spark, sf_dir, "perf_v"), ["session_id"], 20).select("seq")


@query("SELECT served_from AS step, round(sum(CAST(floor(latency_ms * 1000) AS BIGINT)) / 1000 / count(*), 6) AS avg_ms FROM perf_v GROUP BY served_from", "perf_v")
def worker_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "perf_v").select(F.col("served_from").alias("step"), F.floor(F.col("latency_ms") * 1000).cast("long").alias("us"))
    return M.worker_averages(rows).withColumn("avg_ms", F.round("avg_ms", 6))


@query("""@e AS (SELECT photo_id, seq, CASE cmd WHEN 'undo' THEN 'ok' WHEN 'redo' THEN 'claim' ELSE 'error' END AS kind FROM commands_v), r AS (SELECT *, coalesce(max(CASE WHEN kind <> 'error' THEN seq END) OVER (PARTITION BY photo_id), -1) AS last FROM e)
SELECT photo_id, CAST(count(*) FILTER (kind = 'error' AND seq > last) AS INT) AS attempts, count(*) FILTER (kind = 'error' AND seq > last) > 3 AS terminal FROM r GROUP BY photo_id""", "commands_v")
def retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("cmd") == "undo", "ok").when(F.col("cmd") == "redo", "claim").otherwise("error")
    return retries_batch(view(spark, sf_dir, "commands_v").select("photo_id", "seq", kind.alias("kind")))


@query(r"""SELECT p_partkey AS id, TRY_CAST(regexp_extract(trim(CAST(p_size - 25 AS VARCHAR) || ' (x)'), '^[+-]?[0-9.]*', 0) AS DOUBLE) AS lead, lower(trim(p_name)) AS norm, replace(replace(replace(p_name || '<&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml,
  CAST(least(255, floor(0.2126 * (p_size * 5 % 256) + 0.7152 * (p_size * 7 % 256) + 0.0722 * (p_size * 11 % 256) + 0.5)) AS INT) AS luma,
  CASE WHEN p_size % 8 + 1 >= 5 THEN 5152 ELSE 7728 END AS width, CAST(date_diff('day', DATE '1970-01-01', make_date(1990 + p_size % 30, 1 + p_size % 12, 1 + p_size % 28)) AS INT) AS days,
  CASE WHEN p_size % 2 = 0 THEN 'DR' || CAST(p_size AS VARCHAR) ELSE 'Auto (DR' || CAST(p_size AS VARCHAR) || ')' END AS dr,
  CASE WHEN p_size BETWEEN 10 AND 40 THEN CAST(p_size AS DOUBLE) ELSE 25.0 END AS guarded FROM part""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("p_size"), F.col("p_size").cast("string")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("id"), S.leading_number(F.concat((n - 25).cast("string"), F.lit(" (x)"))).alias("lead"), S.normalized_name(F.col("p_name")).alias("norm"), S.xml_escaped(F.concat("p_name", F.lit("<&>"))).alias("xml"),
        S.luma(n * 5 % 256, n * 7 % 256, n * 11 % 256).alias("luma"), S.oriented(F.lit(7728), F.lit(5152), n % 8 + 1)["width"].alias("width"), S.days_from_civil(1990 + n % 30, 1 + n % 12, 1 + n % 28).alias("days"),
        S.dynamic_range(F.when(n % 2 == 0, text).otherwise(F.concat(text, F.lit("%")))).alias("dr"), S.guarded(n.cast("double"), 10, 40, 25.0).alias("guarded"),
    )


@query("""@p AS (SELECT *, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN CAST(substr(id, 2) AS BIGINT) % 1000 END AS trashed_at FROM photos_v)
SELECT 'trash' AS list, folder_id, id, CAST(coalesce(trashed_at, 0) AS BIGINT) AS at, row_number() OVER (PARTITION BY folder_id ORDER BY coalesce(trashed_at, 0) DESC, id) AS rank FROM p WHERE trashed
UNION ALL SELECT 'missing', folder_id, id, NULL, row_number() OVER (PARTITION BY folder_id ORDER BY stem, id) FROM p WHERE missing AND NOT trashed""", "photos_v")
def trash_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir).withColumn("trashed_at", F.when(number() % 2 == 0, number() % 1000))
    return C.trash_list(rows).select(F.lit("trash").alias("list"), "folder_id", "id", F.col("trashed_at").alias("at"), "rank").union(C.missing_list(rows).select(F.lit("missing"), "folder_id", "id", F.lit(None).cast("long"), "rank"))


@query(f"""@p AS (SELECT *, {NUM} AS n FROM photos_v)
SELECT v.view, id FROM p, (VALUES ('five'), ('unscored'), ('unknown'), ('zero')) v(view) WHERE NOT trashed AND NOT missing AND CASE v.view
  WHEN 'five' THEN rating >= 2 AND list_contains(coalesce(tags, []), 'print') AND n % 7 = 3 AND n % 11 <> 0 AND n % 300 < 150 AND n % 3 = 1
  WHEN 'unscored' THEN n % 11 <> 0 AND n % 300 < 20 WHEN 'unknown' THEN n % 3 = 2 AND rating = 0 ELSE false END""", "photos_v")
def combined_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views by all five filters, by focus alone, by photos without a recipe, and below a focus score of 0, which none has."""
    rows, n = photos(spark, sf_dir), number()
    people = rows.select("id", (n % 7).alias("person_id"))
    scores = rows.filter(n % 11 != 0).select("id", (n % 300).cast("double").alias("score"))
    labels = rows.select("id", F.when(n % 3 == 1, "promo").when(n % 3 == 0, "pale").alias("label"))
    views = {"five": ("star2plus", "print", 3, 150.0, "promo"), "unscored": ("all", None, None, 20.0, None), "unknown": ("unstarred", None, None, None, "__unknown__"), "zero": ("all", None, None, 0.0, None)}
    out = [C.combined(rows, people, scores, labels, *v).select(F.lit(k).alias("view"), "id") for k, v in views.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query(f"""@s AS (SELECT (folder_id + CASE WHEN rating = 5 THEN 1 WHEN rating = 4 THEN 2 ELSE 0 END) % 20 AS folder_id, dir, stem, id FROM photos_v WHERE {NUM} % 13 <> 0 UNION ALL SELECT folder_id, dir, stem, 'n' || id FROM photos_v WHERE rating = 3),
f AS (SELECT s.folder_id, p.folder_id AS owner, count(*) AS n FROM s JOIN photos_v p USING (id) WHERE s.folder_id <> p.folder_id GROUP BY ALL),
o AS (SELECT folder_id, string_agg(owner || ':' || n, ',' ORDER BY n DESC, owner) AS owners FROM f GROUP BY folder_id),
w AS (SELECT s.* FROM s LEFT JOIN photos_v p USING (id) WHERE p.folder_id IS NULL OR p.folder_id = s.folder_id),
r AS (SELECT coalesce(p.folder_id, w.folder_id) AS folder_id, coalesce(p.rating, 0) AS rating, coalesce(p.trashed, false) AS trashed, w.id IS NULL AND NOT coalesce(p.trashed, false) AS missing FROM w FULL JOIN photos_v p ON p.id = w.id),
c AS (SELECT folder_id, count(*) FILTER (NOT trashed AND NOT missing) AS total, count(*) FILTER (NOT trashed AND NOT missing AND rating > 0) AS starred, count(*) FILTER (trashed) AS trashed, count(*) FILTER (missing) AS missing FROM r GROUP BY folder_id),
v AS (SELECT folder_id, max_by(kind, seq) AS sort, max_by(photo_id, seq) AS cursor_id FROM actions_v GROUP BY folder_id)
SELECT folder_id, CAST(total AS BIGINT) AS total, CAST(starred AS BIGINT) AS starred, CAST(trashed AS BIGINT) AS trashed, CAST(missing AS BIGINT) AS missing, owners, sort, cursor_id FROM c LEFT JOIN o USING (folder_id) LEFT JOIN v USING (folder_id)""", "photos_v", "actions_v")
def folder_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir)
    moved = F.when(F.col("rating") == 5, 1).when(F.col("rating") == 4, 2).otherwise(0)
    found = rows.filter(number() % 13 != 0).select(((F.col("folder_id") + moved) % 20).alias("folder_id"), "dir", "stem", "id").union(rows.filter("rating = 3").select("folder_id", "dir", "stem", F.concat(F.lit("n"), "id")))
    states = J.view_states(view(spark, sf_dir, "actions_v").select("folder_id", F.col("kind").alias("sort"), F.col("undone").alias("reverse"), F.col("to_rating").alias("filter"), F.col("photo_id").alias("cursor_id"), F.col("seq").alias("ts")))
    out = C.folder_summaries(found, rows.select("folder_id", "dir", "stem", "id", "rating", "tags", "trashed"), states)
    return out.select("folder_id", "total", "starred", "trashed", "missing", F.array_join(F.transform("owners", lambda o: F.concat_ws(":", o["owner"].cast("string"), o["n"].cast("string"))), ",").alias("owners"), "sort", "cursor_id")


@query("""@e AS (SELECT photo_id, seq, CASE cmd WHEN 'undo' THEN 'error' WHEN 'redo' THEN 'error' ELSE cmd END AS kind FROM commands_v),
d AS (SELECT photo_id, max(seq) AS ended FROM e WHERE kind = 'trash' GROUP BY photo_id), l AS (SELECT e.*, max(CASE WHEN kind IN ('rate', 'tags') THEN seq END) OVER (PARTITION BY photo_id) AS job FROM e LEFT JOIN d USING (photo_id) WHERE ended IS NULL OR seq > ended),
j AS (SELECT photo_id, max(job) AS job_seq, count(*) FILTER (kind = 'error' AND seq > job) >= 5 AS failed FROM l WHERE job IS NOT NULL GROUP BY photo_id)
SELECT photo_id, job_seq FROM j WHERE NOT failed ORDER BY job_seq LIMIT 25""", "commands_v")
def write_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 25 file writes of the queue."""
    kind = F.when(F.col("cmd").isin("undo", "redo"), "error").otherwise(F.col("cmd"))
    events = view(spark, sf_dir, "commands_v").select("photo_id", "seq", kind.alias("kind"), F.col("to_rating").alias("rating"), F.lit("").alias("tags"), F.lit(None).cast("long").alias("token"))
    return J.next_batch(J.outbox(events), 25).select("photo_id", "job_seq")


@query("""@q AS (SELECT DISTINCT CAST(person_id AS BIGINT) AS person_id FROM faces_v WHERE person_id IS NOT NULL), p AS (SELECT person_id, 'Person ' || person_id AS name FROM q),
r AS (SELECT person_id, CASE WHEN person_id % 2 = 0 THEN chr(9) || 'PERSON ' || (person_id + 1) || ' ' ELSE 'New ' || person_id END AS new_name FROM q), c AS (SELECT r.person_id, p.person_id AS target_id FROM r JOIN p ON lower(p.name) = lower(trim(trim(r.new_name, chr(9)))) AND p.person_id <> r.person_id)
SELECT 'person' AS part, p.person_id, CASE WHEN c.target_id IS NOT NULL THEN p.name ELSE trim(trim(r.new_name, chr(9))) END AS name FROM p JOIN r USING (person_id) LEFT JOIN c USING (person_id) UNION ALL SELECT 'conflict', person_id, CAST(target_id AS VARCHAR) FROM c""", "faces_v")
def rename_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = faces(spark, sf_dir).filter("person_id is not null").select("person_id").distinct()
    n = F.col("person_id")
    people = ids.select(n, F.concat(F.lit("Person "), n.cast("string")).alias("name"))
    new = ids.select(n, F.when(n % 2 == 0, F.concat(F.lit("\tPERSON "), (n + 1).cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("New "), n.cast("string"))).alias("new_name"))
    rows, clash = D.renamed(people, new)
    return rows.select(F.lit("person").alias("part"), "person_id", "name").union(clash.select(F.lit("conflict"), "person_id", F.col("target_id").cast("string")))


@query(r"""WITH s AS (SELECT p_partkey AS id, p_size AS n, 1 + p_partkey % 12 AS mo, 1 + p_partkey % 28 AS dd FROM part)
SELECT id, CASE WHEN n % 5 = 0 THEN id * 1000 ELSE CAST(date_diff('day', DATE '1970-01-01', make_date(2000 + n, mo, dd)) AS BIGINT) * 86400000 + 3723000 + CASE WHEN n % 3 = 0 THEN 0 ELSE n % 10 * 100 END END AS capture,
  n % 4 <> 0 AS artifact, CASE WHEN n % 2 = 0 THEN n * 65536 % 256 + n * 256 + 7 END AS colour, n % 3 > 0 AS has_metadata,
  CASE WHEN n % 3 = 0 THEN 'album,print' WHEN n % 3 = 1 THEN 'album' ELSE 'print' END AS toggled, CASE WHEN n % 2 = 0 AND n <= 40 THEN 100.0 + 25 * n ELSE 100.0 END AS latency, NOT (n % 2 = 0 AND n <= 40) AS occluded,
  CAST(floor(least(greatest(greatest(0.2 * 600, (n / 100.0) * 400) * 1.5, 1.0), 400)) AS BIGINT) AS side, CAST(least(640, greatest(1, floor((600 + n) * least(640.0 / (600 + n), 640.0 / 400) + 0.5))) AS INT) AS fit FROM s""")
def more_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, i = F.col("p_size"), F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    taken = F.when(n % 5 != 0, F.concat((2000 + n).cast("string"), F.lit(":"), two(1 + i % 12), F.lit(":"), two(1 + i % 28), F.lit(" 01:02:03")))
    colour = S.hex_colour(F.when(n % 2 == 0, F.concat(F.lit("#00"), F.lpad(F.hex(n.cast("long")), 2, "0"), F.lit("07"))).otherwise("red"))
    document = S.parsed(F.when(n % 3 > 0, F.lit('{"SourceFile":"x","b":"1"}')).otherwise(F.lit('{"SourceFile":"x"}')))
    tags = F.when(n % 3 == 0, S.tags_of(F.lit('["album"]'))).when(n % 3 == 1, F.array(F.lit("album"), F.lit("print")))
    name = F.concat(F.lpad(F.lower(F.hex(i.cast("long"))), 16, "0"), F.when(n % 4 == 0, "-x.jpg").when(n % 4 == 1, "-f1.jpg").when(n % 4 == 2, "-f2r3.jpg").otherwise("-f0.tmp9"))
    glass = S.glass_time(F.lit(100.0), 100.0 + 25 * n, n % 2 != 0)
    return rows.select(
        i.alias("id"), S.capture_ms(taken, F.when(n % 3 != 0, (n % 10).cast("string")), i).cast("long").alias("capture"), S.is_artifact(name).alias("artifact"),
        (colour[0] * 65536 + colour[1] * 256 + colour[2]).cast("long").alias("colour"), S.has_metadata(document).alias("has_metadata"), F.array_join(S.toggled(tags, F.lit("print")), ",").alias("toggled"), glass["latency_ms"].alias("latency"), glass["occluded"].alias("occluded"),
        S.square_crop(F.lit(0.5), F.lit(0.5), F.lit(0.2), n / 100.0, F.lit(600), F.lit(400))["side"].cast("long").alias("side"), S.letterbox(600 + n, F.lit(400))["width"].alias("fit"),
    )
