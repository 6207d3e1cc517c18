"""Identity queries on the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shutterlake.operators import identity as D, vectors as V
from shutterlake.plans.catalog_queries import query
from shutterlake.sources.adapters import view

LIKE = 0.30
COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "faces_v").withColumn("person_id", F.col("person_id").cast("long"))


def keyed(rows: DataFrame) -> DataFrame:
    """Faces by folder: photos are dealt to four."""
    return rows.select((F.col("photo_id") % 4).alias("key"), F.col("face_id").alias("id"), "photo_id", F.col("embedding").alias("vector"), F.col("det_score").alias("score"))


def no_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 9th face says no to the persons 3 and 5."""
    pairs = F.explode(F.array(F.lit(3), F.lit(5)).cast("array<long>"))
    return faces(spark, sf_dir).filter("face_id % 9 = 0").select("face_id", pairs.alias("person_id"), F.col("face_id").alias("created_at"))


@query(f"SELECT a.face_id AS a, b.face_id AS b, round({COS.format('a.embedding', 'b.embedding')}, 6) AS cos FROM faces_v a JOIN faces_v b ON a.face_id < b.face_id AND a.photo_id % 4 = b.photo_id % 4 WHERE {COS.format('a.embedding', 'b.embedding')} >= 0.30", "faces_v")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pairs_above(keyed(faces(spark, sf_dir)), LIKE, 256).select("a", "b", F.round("cos", 6).alias("cos"))


#: The greedy pass in SQL: over rows n numbered i in order and edges e (i, j) with j < i, a row is kept if none of its earlier neighbours is.
GREEDY = """g AS (SELECT i, list(j ORDER BY j) AS js FROM e GROUP BY i),
f(i, anchors) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT f.i + 1, CASE WHEN len(list_intersect(coalesce(g.js, []), anchors)) = 0 THEN anchors || [f.i + 1] ELSE anchors END FROM f LEFT JOIN g ON g.i = f.i + 1 WHERE f.i < (SELECT count(*) FROM n)),
a AS (SELECT unnest(anchors) AS j FROM f WHERE i = (SELECT count(*) FROM n))"""


def led(rows: str = "") -> str:
    """Leader clustering in SQL over the faces that rows leaves: m (i, c) numbers each face and its cluster's founder in n."""
    return f"""@n AS (SELECT face_id, photo_id, photo_id % 4 AS key, det_score, embedding, row_number() OVER (ORDER BY det_score DESC, face_id) AS i FROM faces_v{rows}),
e AS (SELECT a.i AS i, b.i AS j FROM n a JOIN n b ON a.i > b.i AND a.key = b.key WHERE {COS.format('a.embedding', 'b.embedding')} >= 0.30),
{GREEDY},
m AS (SELECT n.i, coalesce((SELECT a.j FROM a WHERE a.j = n.i), (SELECT min(a.j) FROM a JOIN e ON e.j = a.j AND e.i = n.i)) AS c FROM n)"""


@query(led() + " SELECT x.face_id AS id, y.face_id AS cluster FROM m JOIN n x ON x.i = m.i JOIN n y ON y.i = m.c", "faces_v")
def anchor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.leader_clusters(keyed(faces(spark, sf_dir)), LIKE).select("id", "cluster")


def _rounds() -> str:
    """Exemplars in SQL: the confirmed faces without outliers, then four unrolled rounds."""
    sql = f"""@c AS (SELECT person_id AS key, face_id AS id, embedding AS v, det_score AS s FROM faces_v WHERE person_id IS NOT NULL AND assigned_by = 'user' AND NOT ignored),
k AS (SELECT c.*, count(*) OVER (PARTITION BY key) AS n, EXISTS (SELECT 1 FROM c d WHERE d.key = c.key AND d.id <> c.id AND {COS.format('c.v', 'd.v')} >= 0.35) AS liked FROM c),
l AS (SELECT *, count(*) FILTER (liked) OVER (PARTITION BY key) AS m FROM k),
r AS (SELECT key, id, v, row_number() OVER (PARTITION BY key ORDER BY s DESC, id) AS nth FROM l WHERE n < 4 OR m < 2 OR liked),
p0 AS (SELECT key, id, v, 0 AS place FROM r WHERE nth = 1)"""
    for i in range(1, 5):
        before = f"(SELECT * FROM {' UNION ALL SELECT * FROM '.join(f'p{j}' for j in range(i))})"
        sql += f""",
s{i} AS (SELECT r.key, r.id, r.v, r.nth, max({COS.format('r.v', 'b.v')}) AS near FROM r JOIN {before} b USING (key) WHERE r.id NOT IN (SELECT id FROM {before}) GROUP BY ALL),
p{i} AS (SELECT key, id, v, {i} AS place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY near, nth DESC) AS w FROM s{i}) WHERE w = 1)"""
    return sql + f",\nproto AS (SELECT * FROM {' UNION ALL SELECT * FROM '.join(f'p{j}' for j in range(5))})"


MATCH = _rounds() + f""",
u AS (SELECT face_id, photo_id, face_index, embedding FROM faces_v WHERE person_id IS NULL AND NOT ignored),
t AS (SELECT u.face_id, u.photo_id, u.face_index, p.key, max({COS.format('u.embedding', 'p.v')}) AS cos FROM u, proto p WHERE NOT (u.face_id % 9 = 0 AND p.key IN (3, 5)) GROUP BY ALL),
w AS (SELECT *, row_number() OVER o AS n, lead(cos) OVER o AS second FROM t WINDOW o AS (PARTITION BY face_id ORDER BY cos DESC, key)),
mt AS (SELECT * FROM w WHERE n = 1 AND cos >= 0.2 AND (second IS NULL OR cos - second >= 0.02))
"""


@query(_rounds() + "\nSELECT CAST(key AS BIGINT) AS person_id, id AS face_id, place FROM proto", "faces_v")
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.prototypes(faces(spark, sf_dir)).select(F.col("key").alias("person_id"), F.col("id").alias("face_id"), "place")


@query(MATCH + "SELECT photo_id, face_id, face_index, CAST(key AS BIGINT) AS person, round(cos, 6) AS score FROM mt", "faces_v")
def match_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.matches(faces(spark, sf_dir), no_rejections(spark, sf_dir), 0.2, 0.02)
    return found.select("photo_id", F.col("id").alias("face_id"), "face_index", "person", F.round("score", 6).alias("score"))


@query(MATCH + """, d AS (SELECT *, row_number() OVER (PARTITION BY photo_id, key ORDER BY cos DESC, face_index) AS first_ FROM mt WHERE NOT EXISTS (SELECT 1 FROM faces_v g WHERE g.photo_id = mt.photo_id AND g.person_id = mt.key))
SELECT f.face_id, CAST(coalesce(f.person_id, d.key) AS BIGINT) AS person_id, CASE WHEN f.person_id IS NULL AND d.key IS NOT NULL THEN 'auto' ELSE assigned_by END AS assigned_by, CASE WHEN f.person_id IS NULL THEN round(d.cos, 6) END AS similarity
FROM faces_v f LEFT JOIN (SELECT * FROM d WHERE first_ = 1) d ON d.face_id = f.face_id""", "faces_v")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.swept(faces(spark, sf_dir), no_rejections(spark, sf_dir), 0.2, 0.02).select("face_id", "person_id", "assigned_by", F.round("similarity", 6).alias("similarity"))


BOX = "greatest(0, least({0}.x + {0}.w, {1}.x + {1}.w) - greatest({0}.x, {1}.x)) * greatest(0, least({0}.y + {0}.h, {1}.y + {1}.h) - greatest({0}.y, {1}.y))"
IOU = f"({BOX}) / ({{0}}.w * {{0}}.h + {{1}}.w * {{1}}.h - ({BOX}))"


@query(f"""@o AS (SELECT photo_id, face_id, x, y, w, h, embedding FROM faces_v), n AS (SELECT photo_id, face_id, x + (face_id % 11) / 100.0 AS x, y, w, h, embedding FROM faces_v),
p AS (SELECT o.photo_id, o.face_id AS old_id, n.face_id AS new_id, {IOU.format('o', 'n')} AS iou FROM o JOIN n USING (photo_id) WHERE {IOU.format('o', 'n')} >= 0.5 AND {COS.format('o.embedding', 'n.embedding')} >= 0.5),
s AS (SELECT *, row_number() OVER w AS k, lead(iou) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY photo_id, old_id ORDER BY iou DESC, new_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY photo_id, new_id ORDER BY iou DESC, old_id) AS m FROM s WHERE k = 1 AND (nxt IS NULL OR iou - nxt >= 0.1))
SELECT photo_id, old_id, new_id, round(iou, 6) AS iou FROM t WHERE m = 1""", "faces_v")
def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = faces(spark, sf_dir).select("photo_id", F.col("face_id").alias("id"), "x", "y", "w", "h", "embedding")
    new = old.withColumn("x", F.col("x") + F.col("id") % 11 / F.lit(100.0))
    return V.carried(old, new).withColumn("iou", F.round("iou", 6))


@query(f"""@n AS (SELECT photo_id // 8 AS photo_id, face_id, det_score, x + face_id % 3 / 20.0 AS x, y, w, h, row_number() OVER (ORDER BY det_score DESC, face_id) AS i FROM faces_v),
e AS (SELECT p.i AS i, q.i AS j FROM n p JOIN n q ON p.i > q.i AND p.photo_id = q.photo_id WHERE {IOU.format('p', 'q')} >= 0.3), {GREEDY}
SELECT photo_id, face_id, round(det_score, 6) AS score FROM n JOIN a ON a.j = n.i""", "faces_v")
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen boxes a photo, so that boxes which a suppressed one overlaps may stay."""
    boxes = faces(spark, sf_dir).select(F.floor(F.col("photo_id") / 8).cast("long").alias("photo_id"), F.col("face_id").alias("id"), F.col("det_score").alias("score"), (F.col("x") + F.col("face_id") % 3 / F.lit(20.0)).alias("x"), "y", "w", "h")
    return V.suppressed(boxes, 0.3).select("photo_id", F.col("id").alias("face_id"), F.round("score", 6).alias("score"))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = faces(spark, sf_dir).filter("person_id is not null").select("person_id").distinct()
    return ids.select("person_id", F.concat(F.lit(" Person "), F.lpad(F.col("person_id").cast("string"), 3, "0")).alias("name"))


NAMES = "@q AS (SELECT DISTINCT CAST(person_id AS BIGINT) AS person_id, ' Person '||lpad(CAST(person_id AS VARCHAR), 3, '0') AS name FROM faces_v WHERE person_id IS NOT NULL)"


@query(NAMES + """, c AS (SELECT person_id, count(*) AS n_faces, max_by(face_id, (assigned_by = 'user', det_score, -face_id)) AS face_id FROM faces_v WHERE person_id IS NOT NULL AND NOT ignored AND photo_id % 4 <> 0 GROUP BY person_id)
SELECT q.person_id, name, CAST(coalesce(n_faces, 0) AS BIGINT) AS n_faces, face_id, row_number() OVER (ORDER BY lower(trim(name)), q.person_id) AS rank FROM q LEFT JOIN c USING (person_id)""", "faces_v")
def person_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = faces(spark, sf_dir).filter("photo_id % 4 <> 0").select("photo_id").distinct()
    return D.roster(faces(spark, sf_dir), persons(spark, sf_dir), photos)


REJECT = "x AS (SELECT face_id, unnest([3, 5]) AS person_id FROM faces_v WHERE face_id % 9 = 0)"


@query(f"""@{REJECT}, m AS (SELECT face_id, CASE WHEN person_id = 3 THEN 4 ELSE person_id END AS person_id FROM faces_v),
r AS (SELECT DISTINCT face_id, CASE WHEN person_id = 3 THEN 4 ELSE person_id END AS person_id FROM x)
SELECT 'face' AS part, face_id, CAST(person_id AS BIGINT) AS person_id FROM m UNION ALL SELECT 'rejection', face_id, person_id FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.face_id = r.face_id AND m.person_id = r.person_id)""", "faces_v")
def merge_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows, no = D.merged(persons(spark, sf_dir), faces(spark, sf_dir), no_rejections(spark, sf_dir), 3, 4)
    pick = lambda part, d: d.select(F.lit(part).alias("part"), "face_id", F.col("person_id").cast("long").alias("person_id"))
    return pick("face", rows).union(pick("rejection", no))


@query(f"@{REJECT} SELECT 'face' AS part, face_id, CAST(CASE WHEN person_id <> 5 THEN person_id END AS BIGINT) AS person_id, CASE WHEN person_id <> 5 THEN assigned_by END AS assigned_by FROM faces_v UNION ALL SELECT 'rejection', face_id, person_id, NULL FROM x WHERE person_id <> 5", "faces_v")
def delete_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows, no = D.deleted(persons(spark, sf_dir), faces(spark, sf_dir), no_rejections(spark, sf_dir), 5)
    return rows.select(F.lit("face").alias("part"), "face_id", "person_id", "assigned_by").union(no.select(F.lit("rejection"), "face_id", "person_id", F.lit(None).cast("string")))


@query("""SELECT 'face' AS part, face_id, CAST(CASE WHEN person_id = 2 AND face_id % 2 = 0 THEN NULL ELSE person_id END AS BIGINT) AS person_id FROM faces_v
UNION ALL SELECT DISTINCT 'rejection', face_id, person_id FROM (SELECT face_id, unnest([3, 5]) AS person_id FROM faces_v WHERE face_id % 9 = 0 UNION ALL SELECT face_id, 2 FROM faces_v WHERE face_id % 2 = 0)""", "faces_v")
def reject_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = faces(spark, sf_dir).filter("face_id % 2 = 0").select("face_id", F.lit(2).cast("long").alias("person_id"))
    rows, no = D.rejected(faces(spark, sf_dir), no_rejections(spark, sf_dir), pairs, 1)
    return rows.select(F.lit("face").alias("part"), "face_id", "person_id").union(no.select(F.lit("rejection"), "face_id", "person_id"))


def _report() -> str:
    """Calibration in SQL by its definition: pos holds each confirmed face against the exemplars of its person's other faces, neg against every other person's exemplars."""
    c = "@c AS (SELECT CAST(person_id AS BIGINT) AS key, face_id AS id, embedding AS v, det_score AS s FROM faces_v WHERE person_id IS NOT NULL AND assigned_by = 'user' AND NOT ignored)"
    # groups: a person's faces, and for each face those of its person without it
    sql = c + """,
g AS (SELECT 'p' || key AS grp, key, id, v, s FROM c UNION ALL SELECT 'f' || l.id, c.key, c.id, c.v, c.s FROM c l JOIN c ON c.key = l.key AND c.id <> l.id),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY s DESC, id) AS nth FROM g),
x0 AS (SELECT grp, key, id, v FROM r WHERE nth = 1)"""
    for i in range(1, 5):
        before = f"(SELECT * FROM {' UNION ALL SELECT * FROM '.join(f'x{j}' for j in range(i))})"
        sql += f""",
y{i} AS (SELECT r.grp, r.key, r.id, r.v, r.nth, max({COS.format('r.v', 'b.v')}) AS near FROM r JOIN {before} b USING (grp) WHERE NOT EXISTS (SELECT 1 FROM {before} d WHERE d.grp = r.grp AND d.id = r.id) GROUP BY ALL),
x{i} AS (SELECT grp, key, id, v FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY near, nth DESC) AS w FROM y{i}) WHERE w = 1)"""
    return sql + f""",
x AS (SELECT * FROM {' UNION ALL SELECT * FROM '.join(f'x{j}' for j in range(5))}),
pos AS (SELECT c.key, c.id, max({COS.format('c.v', 'x.v')}) AS cos FROM c JOIN x ON x.grp = 'f' || c.id GROUP BY ALL),
neg AS (SELECT c.key, c.id, x.key AS other, max({COS.format('c.v', 'x.v')}) AS cos FROM c JOIN x ON x.grp = 'p' || x.key AND x.key <> c.key GROUP BY ALL)
"""


def _rank_of(rows: str, p: float) -> str:
    return f"(SELECT round(list(cos ORDER BY cos)[CAST(floor({p} * (count(*) - 1) + 0.5) AS BIGINT) + 1], 6) FROM {rows})"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query(_report() + f"SELECT (SELECT count(*) FROM pos) AS positives, (SELECT round(min(cos), 6) FROM pos) AS pos_min, {_rank_of('pos', 0.05)} AS pos_p5, {_rank_of('pos', 0.5)} AS pos_median, (SELECT count(*) FROM neg) AS negatives, {_rank_of('neg', 0.95)} AS neg_p95, (SELECT round(max(cos), 6) FROM neg) AS neg_max", "faces_v")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.calibration(faces(spark, sf_dir)))


@query(_report() + """, n AS (SELECT key, count(*) AS confirmed FROM c GROUP BY key), o AS (SELECT key, count(*) AS positives, min(cos) AS lo, max(cos) AS hi FROM pos GROUP BY key), q AS (SELECT key, count(*) AS negatives, max(cos) AS hi FROM neg GROUP BY key)
SELECT n.key AS person_id, confirmed, coalesce(positives, 0) AS positives, round(o.lo, 6) AS pos_min, round(o.hi, 6) AS pos_max, coalesce(negatives, 0) AS negatives, round(q.hi, 6) AS neg_max FROM n LEFT JOIN o USING (key) LEFT JOIN q USING (key)""", "faces_v")
def calibration_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.calibration_persons(faces(spark, sf_dir)))


@query(_rounds() + f""",
u AS (SELECT face_id, embedding FROM faces_v WHERE person_id IS NULL AND NOT ignored), t AS (SELECT u.face_id, p.key, max({COS.format('u.embedding', 'p.v')}) AS cos FROM u, proto p GROUP BY ALL),
w AS (SELECT *, row_number() OVER o AS n, lead(cos) OVER o AS second FROM t WINDOW o AS (PARTITION BY face_id ORDER BY cos DESC, key))
SELECT face_id, CAST(key AS BIGINT) AS best_person, round(cos, 6) AS best, round(cos - coalesce(second, 0), 6) AS margin FROM w WHERE n = 1""", "faces_v")
def calibration_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.calibration_unassigned(faces(spark, sf_dir)))


#: The scan's new faces: the old ones moved a little, without persons; and what carries over to them.
SCAN = f"""o AS (SELECT photo_id, face_id, x, y, w, h, embedding FROM faces_v), n AS (SELECT photo_id, face_id + 1000000 AS face_id, face_index, x + (face_id % 11) / 100.0 AS x, y, w, h, embedding FROM faces_v),
cp AS (SELECT o.photo_id, o.face_id AS old_id, n.face_id AS new_id, {IOU.format('o', 'n')} AS iou FROM o JOIN n USING (photo_id) WHERE {IOU.format('o', 'n')} >= 0.5 AND {COS.format('o.embedding', 'n.embedding')} >= 0.5),
cs AS (SELECT *, row_number() OVER w AS k, lead(iou) OVER w AS nxt FROM cp WINDOW w AS (PARTITION BY photo_id, old_id ORDER BY iou DESC, new_id)),
ct AS (SELECT *, row_number() OVER (PARTITION BY photo_id, new_id ORDER BY iou DESC, old_id) AS m FROM cs WHERE k = 1 AND (nxt IS NULL OR iou - nxt >= 0.1)),
cf AS (SELECT n.photo_id, n.face_id, n.face_index, n.embedding, old.face_id AS old_id, CAST(old.person_id AS BIGINT) AS person_id, old.assigned_by, coalesce(old.ignored, false) AS ignored FROM n LEFT JOIN ct ON ct.new_id = n.face_id AND ct.m = 1 LEFT JOIN faces_v old ON old.face_id = ct.old_id)"""


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return faces(spark, sf_dir).withColumn("x", F.col("x") + F.col("face_id") % 11 / F.lit(100.0)).withColumn("face_id", F.col("face_id") + 10**6).withColumn("person_id", none("long")).withColumn("assigned_by", none("string")).withColumn("ignored", F.lit(False))


@query(f"@{SCAN} SELECT 'face' AS part, face_id, person_id FROM cf UNION ALL SELECT 'rejection', face_id, unnest([3, 5]) FROM cf WHERE old_id % 9 = 0", "faces_v")
def carried_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, no = D.carried_over(faces(spark, sf_dir), scanned(spark, sf_dir), no_rejections(spark, sf_dir))
    return rows.select(F.lit("face").alias("part"), "face_id", "person_id").unionByName(no.select(F.lit("rejection").alias("part"), "face_id", "person_id"))


@query(_rounds() + f""", {SCAN},
u AS (SELECT * FROM cf WHERE person_id IS NULL AND NOT ignored), t AS (SELECT u.face_id, u.photo_id, u.face_index, CAST(p.key AS BIGINT) AS key, max({COS.format('u.embedding', 'p.v')}) AS cos FROM u, proto p WHERE NOT (coalesce(u.old_id % 9 = 0, false) AND p.key IN (3, 5)) GROUP BY ALL),
w AS (SELECT *, row_number() OVER q AS n, lead(cos) OVER q AS second FROM t WINDOW q AS (PARTITION BY face_id ORDER BY cos DESC, key)),
mt AS (SELECT * FROM w WHERE n = 1 AND cos >= 0.2 AND (second IS NULL OR cos - second >= 0.02) AND NOT EXISTS (SELECT 1 FROM cf WHERE cf.photo_id = w.photo_id AND cf.person_id = w.key)),
d AS (SELECT *, row_number() OVER (PARTITION BY photo_id, key ORDER BY cos DESC, face_index) AS first_ FROM mt)
SELECT photo_id, face_id, key AS person, round(cos, 6) AS score FROM d WHERE first_ = 1""", "faces_v")
def scan_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = faces(spark, sf_dir)
    found = D.scan_proposals(old, scanned(spark, sf_dir), no_rejections(spark, sf_dir), D.prototypes(old), 0.2, 0.02)
    return found.select("photo_id", F.col("id").alias("face_id"), "person", F.round("score", 6).alias("score"))


CLUSTERS = led(" WHERE person_id IS NULL AND NOT ignored") + """, y AS (SELECT x.*, z.face_id AS cluster FROM m JOIN n x ON x.i = m.i JOIN n z ON z.i = m.c),
s AS (SELECT key, cluster, count(*) AS size, count(DISTINCT photo_id) AS photos, array_to_string(list(face_id ORDER BY det_score DESC, face_id), ',') AS members FROM y GROUP BY key, cluster),
k AS (SELECT *, row_number() OVER (PARTITION BY key, size > 1 ORDER BY size DESC, cluster) AS rank FROM s)
SELECT key, cluster, size, photos, members, rank FROM k WHERE rank <= CASE WHEN size > 1 THEN 30 ELSE 200 END"""


@query(CLUSTERS, "faces_v")
def face_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.clusters(keyed(faces(spark, sf_dir).filter("person_id is null and not ignored")), LIKE)
    return rows.select("key", "cluster", "size", "photos", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "rank")


#: A naming of every fourth face as person 3: photos of every fifth id were edited since; what the naming displaced was rejected; every sixth face held an automatic label of 3 before.
UNDO = """@now AS (SELECT face_id, photo_id, CAST(CASE WHEN photo_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS revision, CAST(CASE WHEN face_id % 4 = 0 OR face_id % 6 = 1 OR face_id % 6 = 5 THEN 3 ELSE person_id END AS BIGINT) AS person_id,
  CASE WHEN face_id % 4 = 0 THEN 'user' WHEN face_id % 6 = 1 OR face_id % 6 = 5 THEN 'auto' ELSE assigned_by END AS assigned_by FROM faces_v)"""


@query(UNDO + """, b AS (SELECT face_id, photo_id, CAST(person_id AS BIGINT) AS person_id, assigned_by FROM faces_v WHERE face_id % 4 = 0 AND photo_id % 5 <> 0),
r AS (SELECT now.face_id, now.photo_id, CASE WHEN b.face_id IS NOT NULL THEN b.person_id ELSE now.person_id END AS person_id, CASE WHEN b.face_id IS NOT NULL THEN b.assigned_by ELSE now.assigned_by END AS assigned_by FROM now LEFT JOIN b USING (face_id)),
mv AS (SELECT DISTINCT photo_id FROM now WHERE photo_id % 5 = 0 AND photo_id IN (SELECT photo_id FROM faces_v WHERE face_id % 6 = 1)),
w AS (SELECT *, person_id = 3 AND assigned_by = 'auto' AND face_id % 6 <> 1 AND photo_id NOT IN (SELECT photo_id FROM mv) AS born FROM r)
SELECT 'face' AS part, face_id, CASE WHEN born THEN NULL ELSE person_id END AS person_id, CASE WHEN born THEN NULL ELSE assigned_by END AS assigned_by FROM w
UNION ALL SELECT 'rejection', face_id, CAST(person_id AS BIGINT), NULL FROM faces_v WHERE face_id % 4 = 0 AND person_id IS NOT NULL AND person_id <> 3 AND photo_id % 5 = 0
UNION ALL SELECT 'person', NULL, person_id, NULL FROM (SELECT DISTINCT CAST(person_id AS BIGINT) AS person_id FROM faces_v WHERE person_id IS NOT NULL)""", "faces_v")
def undo_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    was, photo = faces(spark, sf_dir), F.col("photo_id")
    n, revision = F.col("face_id"), F.when(photo % 5 == 0, 2).otherwise(1).cast("long")
    auto = n % 6 == 1
    named = was.withColumn("revision", revision).withColumn("assigned_by", F.when(n % 4 == 0, "user").when(auto | (n % 6 == 5), "auto").otherwise(F.col("assigned_by"))).withColumn("person_id", F.when((n % 4 == 0) | auto | (n % 6 == 5), F.lit(3)).otherwise(F.col("person_id")).cast("long"))
    before = was.filter(n % 4 == 0).select("face_id", "photo_id", F.lit(1).cast("long").alias("revision"), "person_id", "assigned_by")
    written = was.filter((n % 4 == 0) & F.col("person_id").isNotNull() & (F.col("person_id") != 3)).select("face_id", "person_id")
    autos = was.filter(auto).select("face_id", "photo_id", F.lit(1).cast("long").alias("revision"))
    people, rows, no = D.naming_undone(persons(spark, sf_dir), named, written.withColumn("created_at", F.lit(1)), before, written, autos, 3, True)
    none = F.lit(None)
    return rows.select(F.lit("face").alias("part"), "face_id", "person_id", "assigned_by").union(no.select(F.lit("rejection"), "face_id", "person_id", none.cast("string"))).union(people.select(F.lit("person"), none.cast("long"), "person_id", none.cast("string")))


@query("SELECT name FROM (SELECT lpad(lower(hex(face_id)), 16, '0')||'-f'||CAST(face_index AS VARCHAR)||'.jpg' AS name, face_id FROM faces_v) WHERE face_id % 3 <> 0", "faces_v")
def erase_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that go; a row of an emptied table would be one too many."""
    rows = faces(spark, sf_dir)
    name = F.concat(F.lpad(F.lower(F.hex("face_id")), 16, "0"), F.lit("-f"), F.col("face_index").cast("string"), F.lit(".jpg"))
    listing = rows.select(F.when(F.col("face_id") % 3 == 0, F.concat(F.lit("other-"), name)).otherwise(name).alias("name"))
    files, *empty = D.all_erased(listing, r"^[0-9a-f]{16}-f\d+", persons(spark, sf_dir), rows, no_rejections(spark, sf_dir))
    for t in empty:
        files = files.union(t.select(F.lit("left over")))
    return files
