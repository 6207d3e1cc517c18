"""Identities over face vectors: naming, corrections that stick, sweeps, progress, calibration.

Tables are immutable: every change gives the new table. persons: (person_id, name); faces: (face_id, photo_id,
face_index, embedding, det_score, person_id, assigned_by, ignored, ...); rejections: (face_id, person_id, created_at).
"""

from __future__ import annotations

from collections.abc import Callable
from math import floor

from pyspark.sql import DataFrame, Window as W, functions as F

from shutterlake.functions import scalars as S
from shutterlake.operators import vectors as V
from shutterlake.sources.shared import numbered

THRESHOLD, MARGIN, CLUSTER = 0.45, 0.08, 0.50


def usable(faces: DataFrame, scans: DataFrame, generation: str | None = None) -> DataFrame:
    """Faces whose photo's scan is ok and, if one is given, of the current generation."""
    ok = scans.filter("status = 'ok'") if generation is None else scans.filter((F.col("status") == "ok") & (F.col("model_gen") == generation))
    return faces.join(ok.select("photo_id"), "photo_id", "left_semi")


def scan_progress(photos: DataFrame, scans: DataFrame) -> DataFrame:
    """Counts of each folder's visible photos: total, scanned, errors that are final, retrying, pending."""
    s = scans.select(F.col("photo_id").alias("id"), "status", "exhausted")
    rows = photos.filter("not trashed and not missing").join(s, "id", "left")
    failed = F.col("status") == "error"
    retrying = failed & ~F.col("exhausted")
    return rows.groupBy("folder_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("scanned"), F.count_if(failed & F.col("exhausted")).alias("errors"), F.count_if(retrying).alias("retrying"),
        F.count_if(F.col("status").isNull() | (F.col("status") == "stale") | retrying).alias("pending"),
    )


def needs_scan(photos: DataFrame, scans: DataFrame, generation: str, pending_writes: DataFrame, retryable: DataFrame) -> DataFrame:
    """Photos (id, mtime, size) to scan: never scanned, stale, failed and retryable, of another generation, or changed since; not those with a file write pending."""
    s = scans.select(F.col("photo_id").alias("id"), "status", "model_gen", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    again = retryable.select("id", F.lit(True).alias("_again"))
    rows = photos.join(s, "id", "left").join(again, "id", "left")
    changed = (F.col("model_gen") != generation) | (F.col("mtime") != F.col("_m")) | (F.col("size") != F.col("_s"))
    due = F.when(F.col("status").isNull() | (F.col("status") == "stale"), True).when(F.col("status") == "error", F.coalesce("_again", F.lit(False)) | changed).otherwise(changed)
    return rows.filter(due).select(*photos.columns).join(pending_writes.select("id"), "id", "left_anti")


def confirmed(faces: DataFrame) -> DataFrame:
    """What may teach: faces that a user named and that are not ignored, as (key, id, vector, score)."""
    rows = faces.filter("assigned_by = 'user' and not ignored and person_id is not null")
    return rows.select(F.col("person_id").cast("long").alias("key"), F.col("face_id").alias("id"), F.col("embedding").alias("vector"), F.col("det_score").alias("score"))


def prototypes(faces: DataFrame, k: int = V.EXEMPLARS, scans: DataFrame | None = None, generation: str | None = None) -> DataFrame:
    """(key, id, vector, place): each person's exemplars, outliers left out. scans (photo_id, status, model_gen): faces count only if their photo's scan is ok and of the generation, see usable()."""
    return V.exemplars(V.without_outliers(confirmed(faces if scans is None else usable(faces, scans, generation))), k)


def matches(faces: DataFrame, rejections: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, protos: DataFrame | None = None) -> DataFrame:
    """(photo_id, id, face_index, person, score) of unnamed faces that are like one person, by the threshold, and not nearly as much like another; rejected persons do not count."""
    protos = prototypes(faces) if protos is None else protos
    barred = rejections.groupBy(F.col("face_id").alias("id")).agg(F.collect_set(F.col("person_id").cast("long")).alias("barred"))
    open_ = faces.filter("person_id is null and not ignored").select(F.col("face_id").alias("id"), "photo_id", "face_index", F.col("embedding").alias("vector"))
    best = V.accepted(V.best_keys(open_.join(barred, "id", "left").select("id", "vector", "barred"), protos.select("key", "vector")), threshold, margin)
    return open_.drop("vector").join(best, "id").select("photo_id", "id", "face_index", F.col("first").alias("person"), F.col("best").alias("score"))


def proposals(faces: DataFrame, found: DataFrame) -> DataFrame:
    """Matches whose person is not in the photo already, one face a person and photo."""
    present = faces.filter("person_id is not null").select("photo_id", F.col("person_id").cast("long").alias("person")).distinct()
    return V.one_per_photo(found.join(present, ["photo_id", "person"], "left_anti"))


def swept(faces: DataFrame, rejections: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """faces after an assignment sweep: empty slots get the proposed person, assigned_by auto, and the similarity."""
    p = proposals(faces, matches(faces, rejections, threshold, margin)).select(F.col("id").alias("face_id"), F.col("person").alias("_person"), F.col("score").alias("_score"))
    rows = faces.join(p, "face_id", "left")
    free = F.col("person_id").isNull() & F.col("_person").isNotNull()
    by = F.when(free, "auto").otherwise(F.col("assigned_by"))
    return rows.withColumn("similarity", F.when(free, F.col("_score"))).withColumn("assigned_by", by).withColumn("person_id", F.coalesce("person_id", "_person")).drop("_person", "_score")


def carried_over(old: DataFrame, new: DataFrame, rejections: DataFrame, same_generation: bool = True) -> tuple[DataFrame, DataFrame]:
    """(new faces with the old ones' person, assigned_by and ignored, rejections under the new ids)."""
    side = lambda f: f.select("photo_id", F.col("face_id").alias("id"), "x", "y", "w", "h", "embedding")
    pairs = V.carried(side(old), side(new), same_generation)
    like = F.col("similarity") if "similarity" in old.columns else F.lit(None).cast("double")
    was = old.select(F.col("face_id").alias("old_id"), F.col("person_id").alias("_p"), F.col("assigned_by").alias("_a"), F.col("ignored").alias("_i"), like.alias("_s"))
    rows = new.join(pairs.select("old_id", F.col("new_id").alias("face_id")).join(was, "old_id"), "face_id", "left")
    rows = rows.withColumn("person_id", F.col("_p")).withColumn("assigned_by", F.col("_a")).withColumn("ignored", F.coalesce("_i", F.lit(False)))
    rows = (rows.withColumn("similarity", F.col("_s")) if "similarity" in new.columns else rows).select(*new.columns)
    kept = rejections.join(pairs.select(F.col("old_id").alias("face_id"), "new_id"), "face_id").withColumn("face_id", F.col("new_id")).drop("new_id")
    return rows, kept


def added(rejections: DataFrame, more: DataFrame) -> DataFrame:
    """Rejections with more; one a face and person, with its earliest time."""
    return rejections.unionByName(more).groupBy("face_id", "person_id").agg(F.min("created_at").alias("created_at"))


def found_or_created(persons: DataFrame, names: DataFrame) -> DataFrame:
    """persons with those of names (name) that are new by their normalized name; new ids follow the largest. Empty names are left out."""
    known = persons.withColumn("_k", S.normalized_name(F.col("name")))
    fresh = names.select(S.trimmed(F.col("name")).alias("name"), S.normalized_name(F.col("name")).alias("_k")).filter("_k is not null").groupBy("_k").agg(F.min("name").alias("name")).join(known, "_k", "left_anti")
    top = persons.agg(F.coalesce(F.max("person_id"), F.lit(0))).first()[0]
    fresh = numbered(fresh, [F.col("_k")], "_n").select((F.lit(top) + F.col("_n")).cast("long").alias("person_id"), "name")
    return persons.select(F.col("person_id").cast("long").alias("person_id"), "name").unionByName(fresh)


def named(faces: DataFrame, rejections: DataFrame, edits: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(faces, rejections) after edits (face_id, to_person): the user's word; a person that is displaced becomes a rejection, a face's own rejection of its new person goes. A null person clears."""
    e = edits.select("face_id", F.col("to_person").alias("_to"), F.lit(True).alias("_e"))
    rows = faces.join(e, "face_id", "left")
    displaced = rows.filter(F.col("_e") & F.col("person_id").isNotNull() & ~F.col("person_id").eqNullSafe(F.col("_to"))).select("face_id", "person_id", F.lit(now).cast("long").alias("created_at"))
    out = rows.withColumn("person_id", F.when(F.col("_e"), F.col("_to")).otherwise(F.col("person_id"))).withColumn("assigned_by", F.when(F.col("_e"), F.when(F.col("_to").isNotNull(), "user")).otherwise(F.col("assigned_by"))).select(*faces.columns)
    own = edits.select("face_id", F.col("to_person").alias("person_id"))
    return out, added(rejections, displaced).join(own, ["face_id", "person_id"], "left_anti")


def naming_undone(persons: DataFrame, faces: DataFrame, rejections: DataFrame, before: DataFrame, written: DataFrame, autos: DataFrame, person: int, created: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persons, faces, rejections) after the undo of a naming of faces as person, which the naming may have created.

    faces carry their photo's revision. before: (face_id, photo_id, revision, person_id, assigned_by) of the named faces; a photo
    with another revision by now was edited later and keeps everything. written: rejections (face_id, person_id)
    that the naming wrote. autos: (face_id, photo_id, revision) that were the person's automatic labels
    before. Automatic labels born of the naming go, except in photos that held one before and were detected
    anew since. A created person goes if nothing refers to it any more.
    """
    now = faces.select("photo_id", "revision").distinct()
    whole = before.join(now, ["photo_id", "revision"], "left_semi")
    b = whole.select("face_id", "photo_id", F.col("person_id").alias("_p"), F.col("assigned_by").alias("_a"), F.lit(True).alias("_b"))
    rows = faces.join(b, ["face_id", "photo_id"], "left")
    back = lambda c, o: F.when(F.col("_b"), F.col(o)).otherwise(F.col(c))
    rows = rows.withColumn("person_id", back("person_id", "_p")).withColumn("assigned_by", back("assigned_by", "_a")).select(*faces.columns)
    left = rejections.join(written.join(whole.select("face_id"), "face_id", "left_semi"), ["face_id", "person_id"], "left_anti")
    moved = autos.select("photo_id", F.col("revision").alias("_r")).distinct().join(now, "photo_id").filter(F.col("_r") != F.col("revision")).select("photo_id").distinct()
    born = rows.filter((F.col("person_id") == person) & (F.col("assigned_by") == "auto")).select("face_id", "photo_id").join(autos.select("face_id"), "face_id", "left_anti").join(moved, "photo_id", "left_anti")
    rows = rows.join(born.select("face_id", F.lit(True).alias("_g")), "face_id", "left")
    rows = rows.withColumn("person_id", F.when(F.col("_g").isNull(), F.col("person_id"))).withColumn("assigned_by", F.when(F.col("_g").isNull(), F.col("assigned_by"))).select(*faces.columns)
    if not created:
        return persons, rows, left
    used = rows.select("person_id").union(left.select("person_id")).filter(F.col("person_id") == person).distinct()
    gone = persons.filter(F.col("person_id") == person).join(used, "person_id", "left_anti").select("person_id")
    return persons.join(gone, "person_id", "left_anti"), rows, left


def ignored(faces: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    """faces with those of ids (face_id) ignored, which clears their person, or not ignored any more."""
    rows = faces.join(ids.select("face_id", F.lit(True).alias("_i")), "face_id", "left")
    clear = F.coalesce("_i", F.lit(False)) & F.lit(value)
    out = rows.withColumn("ignored", F.when(F.col("_i"), F.lit(value)).otherwise(F.col("ignored")))
    for c in ("person_id", "assigned_by"):
        out = out.withColumn(c, F.when(~clear, F.col(c)))
    return out.select(*faces.columns)


def rejected(faces: DataFrame, rejections: DataFrame, pairs: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(faces, rejections) after a durable "not this person" for pairs (face_id, person_id)."""
    rows = faces.join(pairs.select("face_id", "person_id", F.lit(True).alias("_r")), ["face_id", "person_id"], "left")
    cleared = rows.withColumn("assigned_by", F.when(F.col("_r").isNull(), F.col("assigned_by"))).withColumn("person_id", F.when(F.col("_r").isNull(), F.col("person_id")))
    return cleared.select(*faces.columns), added(rejections, pairs.withColumn("created_at", F.lit(now).cast("long")))


def renamed(persons: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(persons, conflicts): new names (person_id, new_name), except where another person has the name by its normal form; those come back as (person_id, target_id, name)."""
    k = persons.select(F.col("person_id").alias("target_id"), S.normalized_name(F.col("name")).alias("_k"))
    clash = renames.withColumn("_k", S.normalized_name(F.col("new_name"))).join(k, "_k").filter("target_id <> person_id").select("person_id", "target_id", F.col("new_name").alias("name"))
    good = renames.filter(S.normalized_name(F.col("new_name")).isNotNull()).join(clash, "person_id", "left_anti")
    return persons.join(good, "person_id", "left").select("person_id", F.coalesce(S.trimmed(F.col("new_name")), "name").alias("name")), clash


def merged(persons: DataFrame, faces: DataFrame, rejections: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persons, faces, rejections) with a person merged into another: faces move, rejections are re-keyed, those that contradict a face's person go. Merging into itself changes nothing."""
    if source == target:
        return persons, faces, rejections
    to = lambda: F.when(F.col("person_id") == source, F.lit(target)).otherwise(F.col("person_id"))
    moved = faces.withColumn("person_id", to())
    keyed = rejections.withColumn("person_id", to()).groupBy("face_id", "person_id").agg(F.min("created_at").alias("created_at"))
    return persons.filter(F.col("person_id") != source), moved, keyed.join(moved.select("face_id", "person_id"), ["face_id", "person_id"], "left_anti")


def deleted(persons: DataFrame, faces: DataFrame, rejections: DataFrame, person: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persons, faces, rejections) without a person; its faces are unnamed again."""
    own = F.coalesce(F.col("person_id") == person, F.lit(False))
    rows = faces.withColumn("assigned_by", F.when(~own, F.col("assigned_by"))).withColumn("person_id", F.when(~own, F.col("person_id")))
    return persons.filter(F.col("person_id") != person), rows, rejections.filter(F.col("person_id") != person)


def autos_cleared(faces: DataFrame, photos: DataFrame, folder_id: int) -> DataFrame:
    """faces without automatic labels in a folder; what users said stays."""
    inside = photos.filter(F.col("folder_id") == folder_id).select("photo_id", F.lit(True).alias("_in"))
    rows = faces.join(inside, "photo_id", "left")
    clear = F.coalesce(F.col("_in") & (F.col("assigned_by") == "auto"), F.lit(False))
    return rows.withColumn("person_id", F.when(~clear, F.col("person_id"))).withColumn("assigned_by", F.when(~clear, F.col("assigned_by"))).select(*faces.columns)


def marked_stale(scans: DataFrame, ids: DataFrame) -> DataFrame:
    rows = scans.join(ids.select("photo_id", F.lit(True).alias("_s")), "photo_id", "left")
    return rows.withColumn("status", F.when(F.col("_s"), "stale").otherwise(F.col("status"))).drop("_s")


def generation_adopted(scans: DataFrame, generations: DataFrame) -> DataFrame:
    """scans after a new model generation (gen, release, hash): scans of generations with other hashes than the newest release's are stale."""
    newest = generations.agg(F.max_by("hash", F.struct("release", "gen")).alias("h")).first()["h"]
    same = generations.filter(F.col("hash") == newest).select(F.col("gen").alias("model_gen"), F.lit(True).alias("_same")).distinct()
    rows = scans.join(same, "model_gen", "left")
    return rows.withColumn("status", F.when(F.col("_same").isNull() & (F.col("status") == "ok"), "stale").otherwise(F.col("status"))).drop("_same")


def scan_failed(scans: DataFrame, errors: DataFrame) -> DataFrame:
    """scans with errors (photo_id, message): status error, one attempt more."""
    e = errors.select("photo_id", F.col("message").alias("_m"))
    rows = scans.join(e, "photo_id", "full")
    status = F.when(F.col("_m").isNotNull(), "error").otherwise(F.col("status"))
    return rows.withColumn("status", status).withColumn("attempts", F.coalesce("attempts", F.lit(0)) + F.col("_m").isNotNull().cast("int")).withColumn("last_error", F.coalesce("_m", "last_error")).drop("_m")


def stats_refreshed(scans: DataFrame, stats: DataFrame) -> DataFrame:
    """scans with the mtime and size that files have after a rewrite of their metadata alone."""
    s = stats.select("photo_id", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    return scans.join(s, "photo_id", "left").withColumn("mtime", F.coalesce("_m", "mtime")).withColumn("size", F.coalesce("_s", "size")).drop("_m", "_s")


def committed(results: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, discarded): scan results (photo_id, epoch, generation, revision, mtime, size, ...) whose photo's state (the same, and enabled) has not moved on; accepted ones carry the next revision."""
    s = state.select("photo_id", "enabled", *[F.col(c).alias(f"_{c}") for c in ("epoch", "generation", "revision", "mtime", "size")])
    rows = results.join(s, "photo_id", "left")
    good = F.coalesce("enabled", F.lit(False))
    for c in ("epoch", "generation", "revision", "mtime", "size"):
        good = good & F.col(c).eqNullSafe(F.col(f"_{c}"))
    accepted = rows.filter(good).withColumn("revision", F.col("revision") + 1)
    return accepted.select(*results.columns), rows.filter(~good).select(*results.columns)


def roster(faces: DataFrame, persons: DataFrame, photos: DataFrame) -> DataFrame:
    """(person_id, name, n_faces, face_id, rank): every person, how many visible faces it has (0 too), its face (a user's first, then the best scored), by normalized name. photos: visible photo_ids."""
    rows = faces.filter("person_id is not null and not ignored").join(photos.select("photo_id"), "photo_id", "left_semi")
    best = F.max_by("face_id", F.struct(F.col("assigned_by") == "user", "det_score", -F.col("face_id")))
    counts = rows.groupBy("person_id").agg(F.count("*").alias("n_faces"), best.alias("face_id"))
    rows = numbered(persons.join(counts, "person_id", "left").withColumn("_k", S.normalized_name(F.col("name"))), [F.col("_k"), F.col("person_id")], "rank")
    return rows.select("person_id", "name", F.coalesce("n_faces", F.lit(0)).cast("long").alias("n_faces"), "face_id", F.col("rank").cast("long").alias("rank"))


def top_faces(faces: DataFrame, n: int = 50) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("person_id").orderBy(F.desc("det_score"), "face_id"))
    return faces.filter("person_id is not null and not ignored").withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)


def persons_of_photos(faces: DataFrame) -> DataFrame:
    return faces.filter("person_id is not null and not ignored").groupBy("photo_id").agg(F.array_sort(F.collect_set("person_id")).alias("persons"))


def faces_of_photos(photos: DataFrame, scans: DataFrame, faces: DataFrame) -> DataFrame:
    """(photo_id, named, unnamed): lists of face ids; null where the photo has no good scan, empty where it has no face."""
    ids = lambda p: F.array_sort(F.collect_list(F.when(p, F.col("face_id"))))
    lists = faces.filter("not ignored").groupBy("photo_id").agg(ids(F.col("person_id").isNotNull()).alias("named"), ids(F.col("person_id").isNull()).alias("unnamed"))
    rows = photos.select("photo_id").join(scans.select("photo_id", "status"), "photo_id", "left").join(lists, "photo_id", "left")
    shown = lambda c: F.when(F.col("status") == "ok", F.coalesce(c, F.array().cast("array<long>"))).alias(c)
    return rows.select("photo_id", shown("named"), shown("unnamed"))


def clusters(faces: DataFrame, least: float = CLUSTER, largest: int = 30, loose: int = 200) -> DataFrame:
    """(key, cluster, size, photos, members, rank) of unnamed faces (key, id, photo_id, vector, score) by leader clustering: of each key the largest clusters of two and more, and single faces."""
    sizes = V.leader_clusters(faces, least).join(faces.select("id", "photo_id", "score"), "id")
    groups = sizes.groupBy("key", "cluster").agg(F.count("*").alias("size"), F.count_distinct("photo_id").alias("photos"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("m"))
    groups = groups.select("key", "cluster", "size", "photos", F.transform("m", lambda x: x["id"]).alias("members"), (F.col("size") > 1).alias("many"))
    rank = F.row_number().over(W.partitionBy("key", "many").orderBy(F.desc("size"), "cluster"))
    return groups.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= F.when(F.col("many"), largest).otherwise(loose)).drop("many")


def erased(name_pattern: str, listing: DataFrame) -> DataFrame:
    """Derived files that go when all face data is erased."""
    return listing.filter(F.col("name").rlike(name_pattern)).select("name")


def all_erased(listing: DataFrame, name_pattern: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """(files to delete, the tables, emptied): persons, faces, scans and rejections after all face data is erased, to be written over the old ones."""
    return erased(name_pattern, listing), *[t.filter(F.lit(False)) for t in tables]


def scan_proposals(old: DataFrame, new: DataFrame, rejections: DataFrame, protos: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, same_generation: bool = True) -> DataFrame:
    """(photo_id, id, face_index, person, score): what a scan proposes for its new faces, after what the old ones hand on.

    Faces that carry a person or are ignored get no proposal; carried rejections bar their person; a person that is carried in a photo is
    not proposed there again, and of several faces the best gets it.
    """
    carried, barred = carried_over(old, new, rejections, same_generation)
    carried = V.written(carried, "carried")
    return proposals(carried, matches(carried, barred, threshold, margin, protos))


def stray_filtered(filtered: DataFrame, faces: DataFrame, person: int) -> DataFrame:
    """Photos of a person filter that have no face of that person: there should be none."""
    return filtered.join(faces.filter((F.col("person_id") == person) & ~F.col("ignored")).select("photo_id"), "photo_id", "left_anti")


def _left_out(rows: DataFrame, whole: DataFrame, k: int) -> DataFrame:
    """(id, key, cos): each confirmed face against the exemplars of its person's other faces.

    Leaving a face out changes a person's exemplars only if it is one of them, so exemplars
    are made anew for at most k faces a person: each such face gives a group of its own, without it.
    """
    out = whole.select(F.col("id").alias("left_out"), "key").join(rows, "key").filter("id <> left_out")
    anew = V.exemplars(out.select(F.col("left_out").alias("key"), "id", "vector", "score"), k).select(F.col("key").alias("left_out"), F.col("vector").alias("pv"))
    cos = F.max(S.cosine(F.col("vector"), F.col("pv"))).alias("cos")
    stay = rows.join(whole.select("id"), "id", "left_anti").join(whole.select("key", F.col("vector").alias("pv")), "key").groupBy("id", "key").agg(cos)
    moved = rows.withColumnRenamed("id", "left_out").join(anew, "left_out").groupBy(F.col("left_out").alias("id"), "key").agg(cos)
    return stay.union(moved)


def _value_at(binned: Callable[[float, float], DataFrame], p: float, n: int, lo: float, hi: float) -> float | None:
    """The value at index round(p (n - 1)) of n sorted values from lo to hi; binned(lo, hi) gives (bin, n, low, high) of those in between. Each pass counts the values of one bin of the last."""
    if not n:
        return None
    rank = floor(p * (n - 1) + 0.5)
    while lo < hi:
        for r in binned(lo, hi).groupBy("bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("bin").collect():  # V.BINS rows at most
            if rank < r["n"]:
                break
            rank -= r["n"]
        lo, hi = r["low"], r["high"]
    return lo


def calibration(faces: DataFrame, k: int = V.EXEMPLARS) -> DataFrame:
    """One row: how many positives and negatives there are, and percentiles of both.

    A positive is a confirmed face against the exemplars of its person's other faces, a negative one against
    another person's exemplars. Negatives are counted in blocks, never listed.
    """
    rows = V.written(confirmed(faces), "confirmed")
    whole = V.written(V.exemplars(rows, k), "exemplars")
    positives = V.written(_left_out(rows, whole, k).filter("cos is not null"), "positives")
    p = positives.agg(F.count("*"), F.min("cos"), F.max("cos")).first()
    n = V.others_counted(rows, whole).agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("low"), F.max("high")).first()

    def counted(lo: float, hi: float) -> DataFrame:
        at = F.least(F.floor((F.col("cos") - lo) / (hi - lo) * V.BINS), F.lit(V.BINS - 1)).alias("bin")
        return positives.filter(F.col("cos").between(lo, hi)).groupBy(at).agg(F.count("*").alias("n"), F.min("cos").alias("low"), F.max("cos").alias("high"))

    pos = [_value_at(counted, q, *p) for q in (0.05, 0.5)]
    p95 = _value_at(lambda lo, hi: V.others_counted(rows, whole, (lo, hi)), 0.95, *n)
    names = "positives long, pos_min double, pos_p5 double, pos_median double, negatives long, neg_p95 double, neg_max double"
    return faces.sparkSession.createDataFrame([(p[0], p[1], *pos, n[0], p95, n[2])], names)


def calibration_persons(faces: DataFrame, k: int = V.EXEMPLARS) -> DataFrame:
    """(person_id, confirmed, positives, pos_min, pos_max, negatives, neg_max) of every person with a confirmed face."""
    rows = V.written(confirmed(faces), "confirmed")
    whole = V.written(V.exemplars(rows, k), "exemplars")
    own = _left_out(rows, whole, k).groupBy("key").agg(F.count("cos").alias("positives"), F.min("cos").alias("pos_min"), F.max("cos").alias("pos_max"))
    others = V.others_counted(rows, whole).groupBy(F.col("bin").alias("key")).agg(F.sum("n").alias("negatives"), F.max("high").alias("neg_max"))
    out = rows.groupBy("key").agg(F.count("*").alias("confirmed")).join(own, "key", "left").join(others, "key", "left")
    return out.select(F.col("key").alias("person_id"), "confirmed", F.coalesce("positives", F.lit(0)).alias("positives"), "pos_min", "pos_max", F.coalesce("negatives", F.lit(0)).alias("negatives"), "neg_max")


def calibration_unassigned(faces: DataFrame, k: int = V.EXEMPLARS) -> DataFrame:
    """(face_id, best_person, best, margin) of every unnamed face that is not ignored: what assignment would see. The margin is the lead over the next person, or best where there is none."""
    open_ = faces.filter("person_id is null and not ignored and embedding is not null").select(F.col("face_id").alias("id"), F.col("embedding").alias("vector"), F.lit(None).cast("array<long>").alias("barred"))
    best = V.best_keys(open_, prototypes(faces, k).select("key", "vector"))
    return best.select(F.col("id").alias("face_id"), F.col("first").alias("best_person"), "best", (F.col("best") - F.coalesce("second", F.lit(0.0))).alias("margin"))
