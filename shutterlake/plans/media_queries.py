"""Rule, image and latency queries on the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shutterlake.operators import imaging as I, metrics as M, rules as R
from shutterlake.plans.catalog_queries import query
from shutterlake.sources.adapters import view

RECIPES = [
    ("promo", {"film": "PROMO", "color": {"min": 0, "max": 4}}),
    ("sized", {"film": ["SMALL", "LARGE"], "wb_shift": "Brand#2"}),
    ("pale", {"color": -4}),
]
MATCH = r"""@v AS (SELECT photo_id, json_extract_string(doc, '$."FujiFilm:FilmMode"') AS film, json_extract_string(doc, '$."FujiFilm:WhiteBalanceFineTune"') AS wb,
  TRY_CAST(regexp_extract(trim(json_extract_string(doc, '$."FujiFilm:Saturation"')), '^[+-]?[0-9.]*', 0) AS DOUBLE) AS color FROM metadata_v),
h AS (SELECT photo_id, coalesce(lower(trim(film)) = 'promo' AND color BETWEEN 0 AND 4, false) AS a, coalesce(lower(trim(film)) IN ('small', 'large') AND lower(trim(wb)) = 'brand#2', false) AS b, coalesce(abs(color + 4) < 1e-9, false) AS c FROM v),
l AS (SELECT photo_id, CASE WHEN a THEN 'promo' WHEN b THEN 'sized' WHEN c THEN 'pale' END AS first, concat_ws(',', CASE WHEN a THEN 'promo' END, CASE WHEN b THEN 'sized' END, CASE WHEN c THEN 'pale' END) AS every FROM h)
"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.matched(view(spark, sf_dir, "metadata_v"), R.rules_frame(spark, RECIPES))


@query(MATCH + "SELECT photo_id, first, every FROM l", "metadata_v")
def recipe_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir)


@query(MATCH + "SELECT photo_id FROM l WHERE first IS NULL", "metadata_v")
def recipe_filter_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shutterlake.operators.catalog import recipe_filter

    photos = view(spark, sf_dir, "metadata_v").select(F.col("photo_id").alias("id"))
    return recipe_filter(photos, labels(spark, sf_dir).select(F.col("photo_id").alias("id"), F.col("first").alias("label")), "__unknown__").withColumnRenamed("id", "photo_id")


@query("""@f(k, label, grp, place) AS (VALUES ('FujiFilm:FilmMode', 'Film simulation', 'Film / Recipe', 10), ('FujiFilm:WhiteBalanceFineTune', 'WB shift', 'Film / Recipe', 13), ('FujiFilm:Saturation', 'Color', 'Film / Recipe', 16))
SELECT photo_id, grp AS "group", label, json_extract_string(doc, '$."' || k || '"') AS value, place FROM metadata_v, f WHERE json_extract_string(doc, '$."' || k || '"') <> ''""", "metadata_v")
def metadata_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.panel(view(spark, sf_dir, "metadata_v"))


@query("""@v AS (SELECT photo_id, json_extract_string(doc, '$."FujiFilm:FocusPixel"') AS p, CAST(json_extract_string(doc, '$."IFD0:Orientation"') AS INT) AS o FROM metadata_v),
n AS (SELECT photo_id, p, o, CAST(split_part(p, ' ', 1) AS DOUBLE) / 7728 AS x, CAST(split_part(p, ' ', 2) AS DOUBLE) / 5152 AS y FROM v WHERE p IS NOT NULL)
SELECT photo_id, 'point' AS status, CASE WHEN o IN (2, 3) THEN 1 - x WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN 1 - y ELSE x END AS x, CASE WHEN o IN (3, 4) THEN 1 - y WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN 1 - x ELSE y END AS y,
  CASE WHEN o >= 5 THEN 5152 ELSE 7728 END AS width, CASE WHEN o >= 5 THEN 7728 ELSE 5152 END AS height, CAST(200 AS BIGINT) AS half FROM n
UNION ALL SELECT photo_id, 'no_af', NULL, NULL, NULL, NULL, NULL FROM v WHERE p IS NULL""", "metadata_v")
def focus_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.focus_points(view(spark, sf_dir, "metadata_v"))


@query("""SELECT served_from, count(*) AS flips, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99, max(latency_ms) AS max_ms,
  CAST(count(*) FILTER (served_from <> 'bitmap-cache') AS BIGINT) AS misses, quantile_disc(latency_ms, 0.99) <= 50 AND count(*) FILTER (served_from <> 'bitmap-cache') = 0 AS gate FROM perf_v GROUP BY served_from""", "perf_v")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gated(M.latency_stats(view(spark, sf_dir, "perf_v"), ["served_from"]))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("val")
    return view(spark, sf_dir, "pixels_v").withColumn("r", v).withColumn("g", v * 3 % 256).withColumn("b", v * 7 % 256)


RGB = "@q AS (SELECT photo_id, x, y, val AS r, val * 3 % 256 AS g, val * 7 % 256 AS b FROM pixels_v)"


@query(RGB + """, c AS (SELECT photo_id, channel, bin, count(*) AS n FROM (SELECT photo_id, unnest(['r', 'g', 'b', 'luma']) AS channel, unnest([r, g, b, CAST(least(255, floor(0.2126 * r + 0.7152 * g + 0.0722 * b + 0.5)) AS INT)]) AS bin FROM q) GROUP BY ALL),
f AS (SELECT k.photo_id, k.channel, k.bin, coalesce(c.n, 0) AS n FROM (SELECT photo_id, channel, CAST(unnest(range(256)) AS INT) AS bin FROM (SELECT DISTINCT photo_id, channel FROM c)) k LEFT JOIN c USING (photo_id, channel, bin)),
s AS (SELECT *, avg(n) OVER (PARTITION BY photo_id, channel ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM f),
t AS (SELECT *, least(1.0, smooth / greatest(1.0, max(CASE WHEN bin BETWEEN 2 AND 253 THEN smooth END) OVER (PARTITION BY photo_id, channel))) AS scaled FROM s)
SELECT photo_id, channel, CAST(max_by(bin, (smooth, bin)) AS BIGINT) AS peak, round(max(smooth), 6) AS top, round(sum(scaled), 6) AS area, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY photo_id, channel""", "pixels_v")
def histogram_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.smoothed(I.histograms(pixels(spark, sf_dir)))
    return rows.groupBy("photo_id", "channel").agg(F.max_by("bin", F.struct("smooth", "bin")).cast("long").alias("peak"), F.round(F.max("smooth"), 6).alias("top"), F.round(F.sum("scaled"), 6).alias("area"), F.sum("n").alias("n"))


@query(RGB + """, k AS (SELECT *, CASE WHEN greatest(r, g, b) >= 250 THEN 1 WHEN greatest(r, g, b) <= 5 THEN 2 END AS kind FROM q)
SELECT photo_id, CAST(least(x // 4, 1) AS INT) AS bx, CAST(least(y // 4, 1) AS INT) AS by, max_by(kind, y * 8 + x) AS kind FROM k WHERE kind IS NOT NULL GROUP BY ALL""", "pixels_v")
def clipping_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.clipping(pixels(spark, sf_dir))


@query("""@l AS (SELECT photo_id, lag(val) OVER r + lead(val) OVER r + lag(val) OVER c + lead(val) OVER c - 4 * val AS lap FROM pixels_v WINDOW r AS (PARTITION BY photo_id, y ORDER BY x), c AS (PARTITION BY photo_id, x ORDER BY y))
SELECT photo_id, round(var_pop(lap), 6) AS score, count(lap) AS n FROM l GROUP BY photo_id""", "pixels_v")
def laplacian_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sharpness(view(spark, sf_dir, "pixels_v")).withColumn("score", F.round("score", 6))


@query("""@r AS (SELECT served_from AS key, latency_ms AS value, row_number() OVER (PARTITION BY served_from ORDER BY latency_ms) - 1 AS place, count(*) OVER (PARTITION BY served_from) AS n FROM perf_v)
SELECT key, p, n, CAST(value AS DOUBLE) AS value FROM r, (SELECT CAST(unnest([0.0, 0.05, 0.5, 0.99, 1.0]) AS DOUBLE) AS p) WHERE place = CAST(floor(p * (n - 1) + 0.5) AS BIGINT)""", "perf_v")
def rounded_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded_ranks(view(spark, sf_dir, "perf_v").select(F.col("served_from").alias("key"), F.col("latency_ms").alias("value")), [0.0, 0.05, 0.5, 0.99, 1.0], few=50)
