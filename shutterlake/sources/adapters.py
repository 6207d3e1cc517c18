"""Views of the driver's tables in the schemas of a photo catalog.

Each adapter is SQL that Spark and DuckDB both accept; {name} stands for a table. Spark
runs it over DataFrames, so no view is registered in the session.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ADAPTERS = {
    "photos_v": """
SELECT 'p'||lpad(CAST(o_orderkey AS STRING),15,'0') AS id, o_custkey % 20 AS folder_id,
       '/root/f'||CAST(o_custkey % 20 AS STRING)||'/d'||CAST(o_custkey % 5 AS STRING) AS dir,
       'DSCF'||lpad(CAST(o_orderkey % 9973 AS STRING),4,'0') AS stem,
       o_orderstatus <> 'F' AS has_jpeg, o_orderstatus <> 'O' AS has_raf,
       CAST(o_orderkey % 6 AS INT) AS rating, o_orderkey % 23 = 0 AS trashed, o_orderkey % 29 = 0 AS missing,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS capture_ts,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN split('print,album',',')
            WHEN o_orderkey % 4 = 2 THEN split('print',',') ELSE split('beach,share',',') END AS tags
FROM {orders}""",
    "files_v": """
SELECT o_custkey % 20 AS folder_id, '/root/f'||CAST(o_custkey % 20 AS STRING)||'/d'||CAST(o_custkey % 5 AS STRING) AS dir,
       'DSCF'||lpad(CAST(o_orderkey % 9973 AS STRING),4,'0')||CASE WHEN o_orderkey % 2 = 0 THEN '.JPG' ELSE '.jpg' END AS name,
       o_orderkey AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS size,
       CASE WHEN o_orderkey % 3 = 0 THEN 'xmp:Rating="'||CAST(o_orderkey % 10 AS STRING)||'"'
            WHEN o_orderkey % 3 = 1 THEN '<xmp:Rating>'||CAST(o_orderkey % 6 AS STRING)||'</xmp:Rating>' END AS xmp_text
FROM {orders} WHERE o_orderstatus <> 'F'
UNION ALL
SELECT o_custkey % 20, '/root/f'||CAST(o_custkey % 20 AS STRING)||'/d'||CAST(o_custkey % 5 AS STRING),
       'dscf'||lpad(CAST(o_orderkey % 9973 AS STRING),4,'0')||'.RAF', o_orderkey + 1, CAST(floor(o_totalprice) AS BIGINT) * 2, NULL
FROM {orders} WHERE o_orderstatus <> 'O'""",
    "actions_v": """
SELECT event_id AS seq, user_id % 10 AS folder_id, ts, user_id AS photo_id,
       CASE event_type WHEN 'view' THEN 'tags' WHEN 'purchase' THEN 'trash' WHEN 'signup' THEN 'restore' ELSE 'rate' END AS kind,
       CAST(floor(value) AS BIGINT) % 6 AS to_rating, event_type = 'error' AS undone
FROM {events}""",
    "commands_v": """
SELECT event_id AS seq, user_id % 10 AS folder_id, ts, user_id AS photo_id,
       CASE event_type WHEN 'click' THEN 'rate' WHEN 'view' THEN 'tags' WHEN 'purchase' THEN 'trash'
            WHEN 'error' THEN 'undo' ELSE 'redo' END AS cmd,
       CAST(floor(value) AS BIGINT) % 6 AS to_rating
FROM {events}""",
    "metadata_v": """
SELECT p_partkey AS photo_id, p_partkey % 20 AS folder_id,
       CASE WHEN p_partkey % 37 = 0 THEN '{}' ELSE
       '{"SourceFile":"'||p_name||'","FujiFilm:FilmMode":"'||p_type||'","FujiFilm:Saturation":"'
       ||CASE WHEN p_size % 9 >= 4 THEN '+' ELSE '' END||CAST(p_size % 9 - 4 AS STRING)||' (x)","FujiFilm:WhiteBalanceFineTune":"'||p_brand
       ||'","FujiFilm:FocusPixel":"'||CAST(p_partkey % 7728 AS STRING)||' '||CAST(p_partkey % 5152 AS STRING)
       ||'","File:ImageWidth":7728,"File:ImageHeight":5152,"IFD0:Orientation":'||CAST(p_size % 8 + 1 AS STRING)||'}' END AS doc
FROM {part}""",
    "faces_v": """
SELECT vec_id AS face_id, CAST(floor(vec_id / 2.0) AS BIGINT) AS photo_id, vec_id % 2 AS face_index, embedding,
       CAST(0.8 AS DOUBLE) + CAST(vec_id * 37 % 200 AS DOUBLE) / 1000 AS det_score,
       CASE WHEN vec_id % 3 = 0 THEN label END AS person_id, CASE WHEN vec_id % 3 = 0 THEN 'user' END AS assigned_by,
       vec_id % 41 = 0 AS ignored,
       CAST(vec_id % 7 AS DOUBLE) / 20 AS x, CAST(vec_id % 5 AS DOUBLE) / 20 AS y, CAST(0.3 AS DOUBLE) AS w, CAST(0.3 AS DOUBLE) AS h
FROM {embeddings}""",
    "perf_v": """
SELECT event_id AS seq, ts, user_id AS session_id, value AS latency_ms,
       CASE event_type WHEN 'error' THEN 'original-fallback' WHEN 'signup' THEN 'preview-decode' ELSE 'bitmap-cache' END AS served_from
FROM {events}""",
    # a photo's face scan: a third of the photos has none, the others are ok, stale or failed
    "scans_v": """
SELECT 'p'||lpad(CAST(o_orderkey AS STRING),15,'0') AS photo_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'error' ELSE 'ok' END AS status, o_orderkey % 7 = 0 AS exhausted
FROM {orders} WHERE o_orderkey % 3 <> 0""",
}
#: An 8 x 8 patch for each vector; the two engines unnest with position in different words.
PIXELS_SPARK = """
SELECT vec_id AS photo_id, i % 8 AS x, CAST(floor(i / 8.0) AS INT) AS y,
       least(255, greatest(0, CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5) AS INT))) AS val
FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS i, v"""
PIXELS_DUCKDB = """
SELECT vec_id AS photo_id, i % 8 AS x, CAST(floor(i / 8.0) AS INT) AS y,
       least(255, greatest(0, CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5) AS INT))) AS val
FROM (SELECT vec_id, unnest(range(64)) i, unnest(embedding) v FROM embeddings)"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's rows, by Spark."""
    sql = PIXELS_SPARK if name == "pixels_v" else ADAPTERS[name]
    source = re.search(r"\{(\w+)\}", sql.replace("'{}'", ""))[1]
    # str.format sees braces of the JSON text too, so the table goes in by a plain replacement
    frame = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(sql.replace("'{}'", "'{{}}'").replace('\'{"', '\'{{"').replace("||'}'", "||'}}'"), **{source: frame})


def with_views(*names: str) -> str:
    """The head of a DuckDB query that defines these adapters."""
    parts = [f"{n} AS ({PIXELS_DUCKDB if n == 'pixels_v' else re.sub(r'\{(\w+)\}', r'\1', ADAPTERS[n])})" for n in names]
    return "WITH RECURSIVE " + ",\n".join(parts)
