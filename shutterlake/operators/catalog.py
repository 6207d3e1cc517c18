"""The catalog: pairing files, reconciling scans, filters, orders, pages, counts, eviction.

folder_id is a key everywhere, so one job serves all folders.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shutterlake.functions import scalars as S
from shutterlake.sources.shared import numbered

FILTER_MODES = ["all", "unstarred", "starred", *[f"star{n}" for n in range(1, 6)], *[f"star{n}plus" for n in range(1, 6)]]
SORTS = ["capture", "name", "rating"]


def pair_files(files: DataFrame) -> DataFrame:
    """One row a photo: files of a folder with the same dir and stem, case apart, one JPEG and one RAF at most; other files are left out."""
    kind = S.kind_of(F.col("name"))
    path = F.concat_ws("/", "dir", "name")
    rows = files.withColumn("kind", kind).filter("kind is not null").withColumn("path", path).dropDuplicates(["dir", "name"])
    half = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    newest = lambda k: F.max(F.when(F.col("kind") == k, F.struct("path", "name", "mtime", "size")))  # noqa: E731  of equal stems the last path
    pairs = rows.groupBy("folder_id", "dir", F.lower(S.stem_of(F.col("name"))).alias("stem_key")).agg(newest("jpeg").alias("jpeg"), newest("raf").alias("raf"), F.count("*").alias("n_files"))
    first = F.coalesce("jpeg", "raf")
    return pairs.select(
        "folder_id", "dir", S.stem_of(first["name"]).alias("stem"), F.col("jpeg.path").alias("jpeg_path"), F.col("raf.path").alias("raf_path"),
        first["path"].alias("primary_path"), S.photo_id(first["path"]).alias("id"), first["mtime"].alias("mtime"), first["size"].alias("size"), "n_files",
    )


def relative_dir(dir_: Column, root: Column) -> Column:
    """dir without its root and slash; dir itself where it lies elsewhere."""
    return F.when(dir_ == root, F.lit("")).when(F.startswith(dir_, F.concat(root, F.lit("/"))), F.substring(dir_, F.length(root) + 2, F.length(dir_))).otherwise(dir_)


def reconcile(scan: DataFrame, catalog: DataFrame, on: list[str]) -> DataFrame:
    """A scan against the stored catalog, both with the columns in on, the catalog with rating, tags and trashed: state is new, seen or missing.

    Seen photos keep their verdict and are missing no more; a trashed photo is never missing.
    """
    seen, stored = scan.select(*on, F.lit(True).alias("_scan")), catalog.select(*on, "rating", "tags", "trashed", F.lit(True).alias("_stored"))
    both = seen.join(stored, on, "full")
    state = F.when(F.col("_stored").isNull(), "new").when(F.col("_scan").isNotNull(), "seen").when(F.col("trashed"), "trashed").otherwise("missing")
    return both.select(*on, state.alias("state"), F.coalesce("rating", F.lit(0)).alias("rating"), "tags", F.coalesce("trashed", F.lit(False)).alias("trashed"), (state == "missing").alias("missing"))


def foreign_owners(scanned: DataFrame, catalog: DataFrame) -> DataFrame:
    """(folder_id, owner, n): photos that a folder's scan (folder_id, id) finds and that another folder of the catalog owns; the busiest owner first, then by name."""
    owned = catalog.select("id", F.col("folder_id").alias("owner"))
    counts = scanned.join(owned, "id").filter(F.col("folder_id") != F.col("owner")).groupBy("folder_id", "owner").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("folder_id").orderBy(F.desc("n"), "owner")))


def star_filter(mode: str) -> Column:
    """The predicate on rating of one of the FILTER_MODES; an unknown mode passes all."""
    rating = F.col("rating")
    if mode == "unstarred":
        return rating == 0
    if mode == "starred":
        return rating > 0
    if found := re.fullmatch(r"star([1-5])(plus)?", mode):
        return rating >= int(found[1]) if found[2] else rating == int(found[1])
    return F.lit(True)


def tag_filter(tag: str | None) -> Column:
    return F.lit(True) if tag is None else F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), tag)


def person_filter(photos: DataFrame, person_map: DataFrame, person: int | None) -> DataFrame:
    """Photos with a visible face of the person; a photo that was never scanned has none."""
    return photos if person is None else photos.join(person_map.filter(F.col("person_id") == person), "id", "left_semi")


def focus_filter(photos: DataFrame, scores: DataFrame, below: float | None) -> DataFrame:
    """Photos whose focus score is below a threshold; those without a score fail. No threshold, no filter."""
    return photos if below is None else photos.join(scores.filter(F.col("score") < below), "id", "left_semi")


def recipe_filter(photos: DataFrame, labels: DataFrame, label: str | None) -> DataFrame:
    """Photos with a recipe label; __unknown__: those with none."""
    if label is None:
        return photos
    return photos.join(labels.filter("label is not null"), "id", "left_anti") if label == "__unknown__" else photos.join(labels.filter(F.col("label") == label), "id", "left_semi")


def sort_keys(sort: str, reverse: bool = False) -> list[Column]:
    """The order of a sort; reverse turns every key, nulls and ties included. An unknown sort is by capture. Stems are collated as people sort them."""
    stem, ts = F.collate(F.col("stem"), "UNICODE"), F.col("capture_ts")
    keys = {"capture": [(ts, 1), (stem, 1)], "name": [(stem, 1), (F.col("dir"), 1)], "rating": [(F.col("rating"), 0), (ts, 1), (stem, 1)]}
    out = [(c, up) for c, up in keys.get(sort, keys["capture"])] + [(F.col("id"), 1)]
    return [(c.asc_nulls_last() if up else c.desc_nulls_first()) if not reverse else (c.desc_nulls_first() if up else c.asc_nulls_last()) for c, up in out]


def ranked(photos: DataFrame, sort: str, reverse: bool = False, name: str = "pos") -> DataFrame:
    """photos with each one's place in its folder, from 0."""
    return photos.withColumn(name, (F.row_number().over(W.partitionBy("folder_id").orderBy(*sort_keys(sort, reverse))) - 1).cast("long"))


def page(rows: DataFrame, first: int, size: int, overscan: int = 8, pos: str = "pos") -> DataFrame:
    """The rows of a page and as many as overscan on both sides."""
    return rows.filter(F.col(pos).between(max(0, first - overscan), first + size - 1 + overscan))


def resumed(rows: DataFrame, saved: DataFrame) -> DataFrame:
    """(folder_id, cursor, n): the place of the saved photo of a folder (folder_id, id, slot), else its old slot within the list."""
    last = rows.groupBy("folder_id").agg(F.count("*").alias("n"))
    found = saved.join(rows.select("folder_id", "id", "pos"), ["folder_id", "id"], "left").join(last, "folder_id")
    return found.select("folder_id", F.coalesce("pos", F.greatest(F.lit(0), F.least(F.col("slot"), F.col("n") - 1))).cast("long").alias("cursor"), "n")


def folder_stats(photos: DataFrame) -> DataFrame:
    live = ~F.col("trashed") & ~F.col("missing")
    return photos.groupBy("folder_id").agg(
        F.count_if(live).alias("total"), F.count_if(live & (F.col("rating") > 0)).alias("starred"), F.count_if(live & (F.col("rating") == 0)).alias("unstarred"),
        F.count_if("trashed").alias("trashed"), F.count_if(F.col("missing") & ~F.col("trashed")).alias("missing"),
    )


def tag_facet(photos: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(folder_id, tag, n, rank): the vocabulary in its order, used or not, then other tags in use by name."""
    uses = photos.select("folder_id", F.explode("tags").alias("tag")).groupBy("folder_id", "tag").agg(F.count("*").alias("n"))
    known = F.transform(F.array(*[F.lit(t) for t in vocabulary]), lambda t, i: F.struct(t.alias("tag"), i.alias("place")))
    every = photos.select("folder_id").distinct().select("folder_id", F.explode(known).alias("k")).select("folder_id", "k.tag", "k.place")
    both = every.join(uses, ["folder_id", "tag"], "full")
    rank = F.row_number().over(W.partitionBy("folder_id").orderBy(F.col("place").asc_nulls_last(), "tag"))
    return both.select("folder_id", "tag", F.coalesce("n", F.lit(0)).cast("long").alias("n"), rank.cast("long").alias("rank"))


def overlaid(rows: DataFrame, order: DataFrame) -> DataFrame:
    """rows (folder_id, id, pos) in a given order (folder_id, id, place): ids of the order first, the rest in their own; ids that are not there are dropped."""
    both = rows.join(order, ["folder_id", "id"], "left")
    return both.withColumn("overlay", (F.row_number().over(W.partitionBy("folder_id").orderBy(F.col("place").asc_nulls_last(), "pos")) - 1).cast("long")).drop("place")


def prioritized(rows: DataFrame, cursors: DataFrame) -> DataFrame:
    """rows with priority: the distance from the folder's cursor, backwards three-fold, and its rank. Ties go to the earlier row."""
    d = F.col("pos") - F.col("cursor")
    score = rows.join(cursors.select("folder_id", "cursor"), "folder_id").withColumn("priority", F.when(d >= 0, d).otherwise(-3 * d))
    return score.withColumn("rank", F.row_number().over(W.partitionBy("folder_id").orderBy("priority", "pos")).cast("long"))


def neighbourhood(rows: DataFrame, cursors: DataFrame, ahead: int = 8, behind: int = 3, forward: bool = True) -> DataFrame:
    low, high = (behind, ahead) if forward else (ahead, behind)
    d = F.col("pos") - F.col("cursor")
    return rows.join(cursors.select("folder_id", "cursor"), "folder_id").filter(d.between(-low, high))


def evictions(groups: DataFrame, budget: int, scope: list[str] | None = None) -> DataFrame:
    """groups (id, bytes, recency, spared) with evict: the least recent go until the rest fits the budget; spared ones stay. scope: columns that part caches.

    One ordered sum replaces the loop: a group goes if what is left after all earlier evictions is above the budget. Without
    a scope the sum runs over sorted ranges.
    """
    if not scope:
        all_bytes = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        loose = numbered(groups.withColumn("_b", F.when(F.col("spared"), 0).otherwise(F.col("bytes"))), [F.col("recency"), F.col("id")], "_nth", "_b", "_gone")
        return loose.withColumn("evict", ~F.col("spared") & (all_bytes - F.col("_gone") > budget)).drop("_b", "_nth", "_gone")
    own = W.partitionBy(*scope)
    order = own.orderBy("recency", "id").rowsBetween(W.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.when(F.col("spared"), 0).otherwise(F.col("bytes"))).over(order), F.lit(0))
    return groups.withColumn("evict", ~F.col("spared") & (F.sum("bytes").over(own) - gone > budget))


def artifact_bytes(files: DataFrame) -> DataFrame:
    """(photo_id, bytes, n): derived files by the 16 hex digits that their names begin with."""
    key = F.regexp_extract("name", r"^([0-9a-f]{16})[-.]", 1)
    return files.withColumn("photo_id", key).filter("photo_id <> ''").groupBy("photo_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def audited(expected: DataFrame, present: DataFrame, key: str = "name") -> DataFrame:
    """(name, state): names expected and not there (missing), there and not expected (stale)."""
    missing = expected.select(key).distinct().join(present, key, "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(present.select(key).distinct().join(expected, key, "left_anti").withColumn("state", F.lit("stale")))


def artifact_state(photos: DataFrame, recorded: DataFrame) -> DataFrame:
    """photos (id, mtime, size) with state of a derived artifact whose input was recorded (id, mtime, size): valid, changed or untrusted."""
    r = recorded.select("id", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    same = (F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s"))
    return photos.join(r, "id", "left").withColumn("state", F.when(F.col("_m").isNull() | F.col("_s").isNull(), "untrusted").when(same, "valid").otherwise("changed")).drop("_m", "_s")


def work_list(photos: DataFrame, done: DataFrame, inputs: DataFrame | None = None, take: int | None = None) -> DataFrame:
    """Photos without a derived row whose inputs exist, in order of pos; take: so many of each folder."""
    todo = photos.join(done.select("id"), "id", "left_anti")
    todo = todo if inputs is None else todo.join(inputs.select("id"), "id", "left_semi")
    return todo if take is None else todo.withColumn("_n", F.row_number().over(W.partitionBy("folder_id").orderBy("pos"))).filter(F.col("_n") <= take).drop("_n")


def merged_facts(photos: DataFrame, facts: DataFrame) -> DataFrame:
    """photos with times, dimensions and adopted ratings that a later pass found (id, capture_ts, width, height, adopted); a rating is taken only where there is none."""
    f = facts.select("id", F.col("capture_ts").alias("_ts"), "width", "height", "adopted")
    both = photos.join(f, "id", "left")
    return both.withColumn("capture_ts", F.coalesce("_ts", "capture_ts")).withColumn("rating", F.when(F.col("rating") == 0, F.coalesce("adopted", "rating")).otherwise(F.col("rating"))).drop("_ts", "adopted")


def owned_actions(actions: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions whose photo lies in their folder, and those to reject."""
    own = photos.select(F.col("id").alias("photo_id"), "folder_id")
    return actions.join(own, ["photo_id", "folder_id"], "left_semi"), actions.join(own, ["photo_id", "folder_id"], "left_anti")


def trash_list(photos: DataFrame) -> DataFrame:
    """(folder_id, id, stem, rating, trashed_at, rank): each folder's trash, newest first; an unknown time is the oldest."""
    rows = photos.filter("trashed").select("folder_id", "id", "stem", F.col("rating").cast("long").alias("rating"), F.coalesce(F.col("trashed_at").cast("long"), F.lit(0)).alias("trashed_at"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("folder_id").orderBy(F.desc("trashed_at"), "id")).cast("long"))


def missing_list(photos: DataFrame) -> DataFrame:
    """The photos of each folder that a scan no longer finds, by stem, with rank."""
    rows = photos.filter("missing and not trashed")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("folder_id").orderBy("stem", "id")).cast("long"))


def combined(photos: DataFrame, person_map: DataFrame, scores: DataFrame, labels: DataFrame, mode: str = "all", tag: str | None = None, person: int | None = None, below: float | None = None, label: str | None = None) -> DataFrame:
    """Visible photos that pass all five filters."""
    rows = photos.filter(~F.col("trashed") & ~F.col("missing")).filter(star_filter(mode) & tag_filter(tag))
    return recipe_filter(focus_filter(person_filter(rows, person_map, person), scores, below), labels, label)


def opened(files: DataFrame, catalog: DataFrame, sort: str = "capture", mode: str = "all", captures: DataFrame | None = None) -> DataFrame:
    """Folder listings in one plan: photos found and missing, with their place in the list, and the folder's counts. captures: (id, capture_ts)."""
    found = pair_files(files).select("folder_id", "dir", "stem", "id")
    times = captures.select("id", "capture_ts") if captures is not None else catalog.select("id", F.lit(None).cast("timestamp_ntz").alias("capture_ts")).limit(0)
    merged = reconcile(found, catalog, ["folder_id", "dir", "stem", "id"]).join(times, "id", "left")
    listed = ranked(merged.filter(~F.col("trashed") & ~F.col("missing")).filter(star_filter(mode)), sort)
    return listed.drop("trashed", "missing").join(folder_stats(merged), "folder_id")


def folder_summaries(found: DataFrame, catalog: DataFrame, states: DataFrame) -> DataFrame:
    """One row a folder that a scan found (folder_id, dir, stem, id) or the catalog has: counts, saved view, other folders that own what was found.

    catalog: (folder_id, dir, stem, id, rating, tags, trashed); states as view_states() gives them. Photos that another
    folder owns do not count here. owners: (owner, n), the busiest first.
    """
    theirs = catalog.select("id", F.col("folder_id").alias("owner"))
    own = found.join(theirs, "id", "left").filter(F.col("owner").isNull() | (F.col("owner") == F.col("folder_id"))).drop("owner")
    counts = folder_stats(reconcile(own, catalog, ["folder_id", "dir", "stem", "id"]))
    owners = foreign_owners(found, catalog).groupBy("folder_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "owner", "n"))), lambda x: F.struct(x["owner"].alias("owner"), x["n"].alias("n"))).alias("owners"))
    return counts.join(owners, "folder_id", "full").join(states, "folder_id", "left")
