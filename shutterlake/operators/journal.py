"""The verdict journal: undo and redo, snapshots, the write-back outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shutterlake.functions import scalars as S
from shutterlake.operators.undo import parallel_fold

MAX_ATTEMPTS = 5


def candidates(actions: DataFrame) -> DataFrame:
    """(folder_id, undo_seq, redo_seq): the newest live and the oldest undone action of each folder."""
    live, undone = F.when(~F.col("undone"), F.col("seq")), F.when(F.col("undone"), F.col("seq"))
    return actions.groupBy("folder_id").agg(F.max(live).alias("undo_seq"), F.min(undone).alias("redo_seq"))


class Lane:
    """A folder's two stacks, as undo and redo are defined: what the folds of batch and stream are held against."""

    def __init__(self, live: list[tuple] | None = None, undone: list[tuple] | None = None):
        self.live, self.undone = live or [], undone or []

    def step(self, command: str, action: tuple) -> None:
        """undo and redo move the top of one stack to the other; any other command is an action and cuts the redo branch."""
        if command == "undo":
            if self.live:
                self.undone.append(self.live.pop())
        elif command == "redo":
            if self.undone:
                self.live.append(self.undone.pop())
        else:
            self.live.append(action)
            self.undone.clear()


def folded(commands: DataFrame, ranges: int | None = None) -> DataFrame:
    """The actions that are left of commands (folder_id, seq, photo_id, cmd, to_rating), with undone. One folder's log may be of any length: see undo."""
    return parallel_fold(commands, ranges)


def latest(value: str, *kinds: str) -> Column:
    return F.max_by(F.when(F.col("kind").isin(*kinds), F.col(value)), F.when(F.col("kind").isin(*kinds), F.col("seq")))


def snapshot(actions: DataFrame) -> DataFrame:
    """(photo_id, rating, tags_seq, trashed): what the newest live action of each kind says; null where there is none."""
    return actions.filter(~F.col("undone")).groupBy("photo_id").agg(
        latest("to_rating", "rate").alias("rating"), latest("seq", "tags").alias("tags_seq"), (latest("kind", "trash", "restore") == "trash").alias("trashed")
    )


def with_base(photos: DataFrame, state: DataFrame) -> DataFrame:
    """photos (id, rating, trashed) as a snapshot leaves them; the stored rating is the base."""
    s = state.select(F.col("photo_id").alias("id"), F.col("rating").alias("_r"), F.col("trashed").alias("_t"))
    return photos.join(s, "id", "left").withColumn("rating", F.coalesce("_r", "rating")).withColumn("trashed", F.coalesce("_t", "trashed")).drop("_r", "_t")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Photos whose rating, tags or trashed state differ between two snapshots, with the new values."""
    columns = ["rating", "tags_seq", "trashed"]
    old = before.select("photo_id", *[F.col(c).alias(f"_{c}") for c in columns])
    changed = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = after.join(old, "photo_id", "full")
    kinds = F.array_compact(F.array(F.when(changed("rating"), "rate"), F.when(changed("tags_seq"), "tags"), F.when(changed("trashed"), "trash")))
    return both.withColumn("kinds", F.array_join(kinds, ",")).filter("kinds <> ''").select("photo_id", "kinds", *columns)


def outbox(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One open job a photo of events (photo_id, seq, kind, rating, tags, token).

    kind: rate and tags replace their field of the open job and keep the other; trash deletes it,
    done too if its token is the job's own, else it is stale and has no effect; error counts an attempt of
    the job that is open; rearm forgets attempts. After max_attempts a job is parked. Where events have a column
    error, the text of the last counted failure that has one is last_error.
    """
    own = W.partitionBy("photo_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    enqueued = F.when(F.col("kind").isin("rate", "tags"), F.col("seq"))
    rows = events.withColumn("_open", F.max(enqueued).over(own))
    ends = (F.col("kind") == "trash") | ((F.col("kind") == "done") & F.col("token").eqNullSafe(F.col("_open")))
    ended = rows.withColumn("_end", F.max(F.when(ends, F.col("seq"))).over(W.partitionBy("photo_id"))).filter(F.col("_end").isNull() | (F.col("seq") > F.col("_end")))
    job, arm = F.max(enqueued).over(W.partitionBy("photo_id")), F.max(F.when(F.col("kind") == "rearm", F.col("seq"))).over(W.partitionBy("photo_id"))
    ended = ended.withColumn("_job", job).withColumn("_from", F.greatest("_job", arm)).filter("_job is not null")
    fails = (F.col("kind") == "error") & (F.col("seq") > F.coalesce("_from", "_job"))
    jobs = ended.groupBy("photo_id").agg(
        F.max_by(F.when(F.col("kind") == "rate", F.col("rating")), F.when(F.col("kind") == "rate", F.col("seq"))).alias("rating"),
        F.max_by(F.when(F.col("kind") == "tags", F.col("tags")), F.when(F.col("kind") == "tags", F.col("seq"))).alias("tags"),
        F.max("_job").alias("job_seq"), F.count_if(fails).alias("attempts"),
        *([F.max_by(F.when(fails, F.col("error")), F.when(fails & F.col("error").isNotNull(), F.col("seq"))).alias("last_error")] if "error" in events.columns else []),
    )
    return jobs.withColumn("status", F.when(F.col("attempts") >= max_attempts, "error").otherwise("pending"))


def queue_status(jobs: DataFrame) -> DataFrame:
    """(pending, failed, last_job): counts, and the newest failed job if there is one; where jobs have last_error also that of the newest failed job that has one."""
    failed = F.col("status") == "error"
    text = [F.max_by("last_error", F.when(failed & F.col("last_error").isNotNull(), F.col("job_seq"))).alias("last_error")] if "last_error" in jobs.columns else []
    return jobs.agg(F.count_if(~failed).alias("pending"), F.count_if(failed).alias("failed"), F.max(F.when(failed, F.col("job_seq"))).alias("last_job"), *text)


def next_batch(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.filter("status = 'pending'").orderBy("job_seq").limit(n)


def adopted(photos: DataFrame, sources: DataFrame, actions: DataFrame) -> DataFrame:
    """(id, rating): ratings that files carry, for photos that have none and that no action touched.

    sources: (id, xattr_jpeg, xattr_raf, sidecar_raf, sidecar_jpeg, embedded), the first known one counts.
    """
    first = F.coalesce("xattr_jpeg", "xattr_raf", "sidecar_raf", "sidecar_jpeg", "embedded")
    free = photos.filter("rating = 0").select("id").join(actions.select(F.col("photo_id").alias("id")), "id", "left_anti")
    return sources.select("id", first.cast("int").alias("rating")).filter("rating > 0").join(free, "id", "left_semi")


def backfill(known: DataFrame, files: DataFrame) -> DataFrame:
    """Ratings (id, rating) that differ from what the photo's files say (id, file_rating): to be queued for writing."""
    return known.join(files, "id", "left").filter(~F.col("rating").eqNullSafe(F.col("file_rating"))).select("id", "rating")


def external_restores(trashed: DataFrame, listing: DataFrame) -> DataFrame:
    """restore actions for trashed photos (photo_id, folder_id, trash_path, original_path) whose trash copy is gone and whose original is there."""
    there = listing.select(F.col("path"))
    back = trashed.join(there.withColumnRenamed("path", "original_path"), "original_path", "left_semi").join(there.withColumnRenamed("path", "trash_path"), "trash_path", "left_anti")
    return back.select("folder_id", "photo_id", F.lit("restore").alias("kind"))


def view_states(events: DataFrame) -> DataFrame:
    """The newest sort, reverse, filter and cursor of each folder, and when it was used."""
    row = F.struct("sort", "reverse", "filter", "cursor_id")
    return events.groupBy("folder_id").agg(F.max_by(row, "ts").alias("v"), F.max("ts").alias("recency")).select("folder_id", "v.*", "recency")


def sources_of(files: DataFrame) -> DataFrame:
    """Rating sources of paired files by folder, dir and stem: the texts beside RAF and JPEG."""
    rated = files.withColumn("kind", S.kind_of(F.col("name"))).withColumn("r", S.xmp_rating(F.col("xmp_text")))
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("r")))
    return rated.groupBy("folder_id", "dir", F.upper(S.stem_of(F.col("name"))).alias("stem")).agg(pick("raf").alias("sidecar_raf"), pick("jpeg").alias("sidecar_jpeg"))
