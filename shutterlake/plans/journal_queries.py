"""Journal queries on the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shutterlake.operators import journal as J
from shutterlake.plans.catalog_queries import query
from shutterlake.sources.adapters import view

SNAPSHOT = """SELECT photo_id, max_by(to_rating, seq) FILTER (kind = 'rate') AS rating, max(seq) FILTER (kind = 'tags') AS tags_seq, max_by(kind, seq) FILTER (kind IN ('trash', 'restore')) = 'trash' AS trashed
FROM actions_v WHERE NOT undone{more} GROUP BY photo_id"""


@query(SNAPSHOT.format(more=""), "actions_v")
def journal_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.snapshot(view(spark, sf_dir, "actions_v"))


@query("SELECT folder_id, max(seq) FILTER (NOT undone) AS undo_seq, min(seq) FILTER (undone) AS redo_seq FROM actions_v GROUP BY folder_id", "actions_v")
def undo_redo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.candidates(view(spark, sf_dir, "actions_v"))


@query("""@n AS (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY seq) AS i FROM commands_v),
f(folder_id, i, live, undone) AS (
  SELECT DISTINCT folder_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM n
  UNION ALL
  SELECT f.folder_id, n.i, CASE WHEN cmd = 'undo' THEN live[:len(live) - 1] WHEN cmd = 'redo' THEN live || undone[len(undone):len(undone)] ELSE live || [seq] END,
    CASE WHEN cmd = 'undo' THEN undone || live[len(live):len(live)] WHEN cmd = 'redo' THEN undone[:len(undone) - 1] ELSE [] END
  FROM f JOIN n ON n.folder_id = f.folder_id AND n.i = f.i + 1),
e AS (SELECT f.* FROM f JOIN (SELECT folder_id, max(i) AS i FROM n GROUP BY folder_id) m USING (folder_id, i)),
o AS (SELECT unnest(live) AS seq, false AS undone FROM e UNION ALL SELECT unnest(undone), true FROM e)
SELECT folder_id, seq, photo_id, cmd AS kind, to_rating, o.undone FROM o JOIN commands_v USING (seq)""", "commands_v")
def undo_redo_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.folded(view(spark, sf_dir, "commands_v"))


@query(f"""@a AS ({SNAPSHOT.format(more="")}), b AS ({SNAPSHOT.format(more=" AND seq % 1000 < 800")})
SELECT photo_id, concat_ws(',', CASE WHEN a.rating IS DISTINCT FROM b.rating THEN 'rate' END, CASE WHEN a.tags_seq IS DISTINCT FROM b.tags_seq THEN 'tags' END, CASE WHEN a.trashed IS DISTINCT FROM b.trashed THEN 'trash' END) AS kinds,
  a.rating, a.tags_seq, a.trashed FROM a FULL JOIN b USING (photo_id) WHERE a.rating IS DISTINCT FROM b.rating OR a.tags_seq IS DISTINCT FROM b.tags_seq OR a.trashed IS DISTINCT FROM b.trashed""", "actions_v")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = view(spark, sf_dir, "actions_v")
    return J.diff(J.snapshot(actions.filter("seq % 1000 < 800")), J.snapshot(actions))


@query("""@e AS (SELECT photo_id, seq, CASE cmd WHEN 'undo' THEN 'error' WHEN 'redo' THEN 'done' ELSE cmd END AS kind, to_rating AS rating, CAST(seq AS VARCHAR) AS tags,
    max(CASE WHEN cmd IN ('rate', 'tags') THEN seq END) OVER (PARTITION BY photo_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS op FROM commands_v),
d AS (SELECT photo_id, max(seq) AS ended FROM e WHERE kind = 'trash' OR (kind = 'done' AND (seq % 2 = 0 OR op IS NULL)) GROUP BY photo_id),
l AS (SELECT e.*, max(CASE WHEN kind IN ('rate', 'tags') THEN seq END) OVER (PARTITION BY photo_id) AS job FROM e LEFT JOIN d USING (photo_id) WHERE ended IS NULL OR seq > ended)
SELECT photo_id, max_by(rating, seq) FILTER (kind = 'rate') AS rating, max_by(tags, seq) FILTER (kind = 'tags') AS tags, max(job) AS job_seq, CAST(count(*) FILTER (kind = 'error' AND seq > job) AS BIGINT) AS attempts,
  CASE WHEN count(*) FILTER (kind = 'error' AND seq > job) >= 5 THEN 'error' ELSE 'pending' END AS status FROM l WHERE job IS NOT NULL GROUP BY photo_id""", "commands_v")
def outbox_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = view(spark, sf_dir, "commands_v")
    kind = F.when(F.col("cmd") == "undo", "error").when(F.col("cmd") == "redo", "done").otherwise(F.col("cmd"))
    newest = F.max(F.when(F.col("cmd").isin("rate", "tags"), F.col("seq"))).over(W.partitionBy("photo_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    # every second completion carries the token of a job that has been replaced
    token = F.when(F.col("seq") % 2 == 0, newest).otherwise(newest - 1)
    return J.outbox(rows.select("photo_id", "seq", kind.alias("kind"), F.col("to_rating").alias("rating"), F.col("seq").cast("string").alias("tags"), token.alias("token")))


@query(r"""@r AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(xmp_text, 'xmp:Rating="(\d+)"', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(xmp_text, '<xmp:Rating>(\d+)</xmp:Rating>', 1), '') AS INT)) AS v FROM files_v),
s AS (SELECT folder_id, dir, upper(regexp_replace(name, '\.[^.]*$', '')) AS stem, max(v) FILTER (lower(name) LIKE '%.jpg' AND v <= 5) AS rating FROM r GROUP BY ALL)
SELECT p.id, s.rating FROM photos_v p JOIN s USING (folder_id, dir, stem) WHERE p.rating = 0 AND s.rating > 0 AND CAST(substr(p.id, 2) AS BIGINT) NOT IN (SELECT photo_id FROM actions_v)""", "files_v", "photos_v", "actions_v")
def rating_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = view(spark, sf_dir, "photos_v")
    found = J.sources_of(view(spark, sf_dir, "files_v")).join(photos.select("folder_id", "dir", "stem", "id"), ["folder_id", "dir", "stem"])
    none = F.lit(None).cast("int")
    sources = found.select("id", none.alias("xattr_jpeg"), none.alias("xattr_raf"), "sidecar_raf", "sidecar_jpeg", none.alias("embedded"))
    actions = view(spark, sf_dir, "actions_v").select(F.concat(F.lit("p"), F.lpad(F.col("photo_id").cast("string"), 15, "0")).alias("photo_id"))
    return J.adopted(photos, sources, actions)
