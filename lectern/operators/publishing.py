"""Snapshots of a work's chapters: difference, validation, publishing; edits of chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.stored import table


def release_diff(current: DataFrame, before: DataFrame) -> DataFrame:
    """``work_id, chapter_id, change``: new, updated, reordered, removed; unchanged ones are left out.

    Rows: work_id, chapter_id, revision_id, position. A chapter has the first
    change that holds.
    """
    key = ["work_id", "chapter_id"]
    c = current.select(*key, F.col("revision_id").alias("cr"), F.col("position").alias("cp"), F.lit(True).alias("now"))
    p = before.select(*key, F.col("revision_id").alias("pr"), F.col("position").alias("pp"), F.lit(True).alias("was"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("cr") != F.col("pr"), "updated").when(F.col("cp") != F.col("pp"), "reordered")
    return c.join(p, key, "full").select(*key, change.alias("change")).where("change IS NOT NULL")


def diff_counts(diff: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("change") == k).alias(k)
    return diff.groupBy("work_id").agg(n("new"), n("updated"), n("reordered"), n("removed"))


WORK_TYPES = ("short_story", "serial")


def problems(works: DataFrame, chapters: DataFrame, categories: DataFrame, images: DataFrame | None = None, types: tuple[str, ...] = WORK_TYPES) -> DataFrame:
    """``id, problems``: what keeps each work from being published; an empty list is ready.

    ``chapters``: work_id, id, head_revision_id, body_key (null if the object is
    missing); merged and deleted ones, where columns tell, don't count.
    ``categories``: work_id of works with an active category. ``images``:
    work_id, content_hash, storage_key (null if missing) of the images in use.
    """
    for gone in ("merged_into_chapter_id", "deleted_at"):
        if gone in chapters.columns:
            chapters = chapters.where(F.col(gone).isNull())
    n = chapters.groupBy(F.col("work_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("head_revision_id").isNull()).alias("no_head"), F.count_if(F.col("head_revision_id").isNotNull() & F.col("body_key").isNull()).alias("no_body"))
    w = works.join(n, "id", "left").join(categories.select(F.col("work_id").alias("id"), F.lit(True).alias("filed")).distinct(), "id", "left")
    if images is not None:
        w = w.join(images.where("storage_key IS NULL").groupBy(F.col("work_id").alias("id")).agg(F.count_distinct("content_hash").alias("no_image")), "id", "left")
    lost = F.col("no_image") if images is not None else F.lit(None).cast("long")
    checks = [
        (F.coalesce(F.btrim("title"), F.lit("")) == "", F.lit("title")),
        (~F.coalesce(F.col("work_type").isin(*types), F.lit(False)), F.lit("work_type")),
        ((F.col("work_type") == "serial") & F.col("serial_status").isNull(), F.lit("serial_status")),
        (F.col("visibility") == "removed", F.lit("removed")),
        (F.coalesce("n", F.lit(0)) == 0, F.lit("no_chapters")),
        (F.col("no_head") > 0, F.concat(F.lit("missing_revisions:"), F.col("no_head").cast("string"))),
        (F.col("no_body") > 0, F.concat(F.lit("missing_objects:"), F.col("no_body").cast("string"))),
        (lost > 0, F.concat(F.lit("missing_resources:"), lost.cast("string"))),
        (F.col("filed").isNull(), F.lit("no_category")),
    ]
    return w.select("id", F.array_compact(F.array(*[F.when(c, name) for c, name in checks])).alias("problems"))


def publish(works: DataFrame, chapters: DataFrame, releases: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New releases, their items and change events for ``works``.

    ``chapters``: work_id, id, head_revision_id, position, label_raw, title;
    ``releases``: work_id, version; ``before``: the items of the active releases.
    """
    last = releases.groupBy("work_id").agg(F.max("version").alias("version"))
    mine = chapters.join(works.select(F.col("id").alias("work_id")), "work_id", "left_semi")
    rel = mine.groupBy("work_id").agg(F.count("*").alias("chapter_count")).join(last, "work_id", "left").select("work_id", (F.coalesce("version", F.lit(0)) + 1).cast("int").alias("version"), F.col("chapter_count").cast("int").alias("chapter_count"))
    items = mine.join(rel.select("work_id", "version"), "work_id").select("work_id", "version", F.col("id").alias("chapter_id"), F.col("head_revision_id").alias("revision_id"), "position", "label_raw", "title")
    diff = release_diff(items, before.join(rel.select("work_id"), "work_id", "left_semi"))
    ids = lambda k: F.array_sort(F.collect_set(F.when(F.col("change") == k, F.col("chapter_id")))).alias(f"{k}_ids")
    events = rel.select("work_id", "version").join(diff.groupBy("work_id").agg(ids("new"), ids("updated")), "work_id", "left")
    return rel, items, events


def edit_chapters(works: DataFrame, chapters: DataFrame, revisions: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(outcomes, works, chapters, revisions)`` after ``edits``, one a chapter at most.

    ``edits``: chapter_id, expected_revision_id, new_revision_id, label_raw,
    title, content_key. An edit of a chapter that isn't there, or without its
    head, or written against another head than the current one, changes
    nothing; nor does one that says what is there. Others make a revision, which
    becomes the chapter's head, and count in the work's edit version.
    """
    live = chapters.where("merged_into_chapter_id IS NULL AND deleted_at IS NULL").select(F.col("id").alias("chapter_id"), "work_id", F.col("head_revision_id").alias("head"), F.col("label_raw").alias("old_label"))
    held = revisions.select(F.col("id").alias("head"), F.col("title").alias("old_title"), F.col("content_key").alias("old_key"))
    met = edits.join(live, "chapter_id", "left").join(held, "head", "left")
    same = F.col("label_raw").eqNullSafe(F.col("old_label")) & F.col("title").eqNullSafe(F.col("old_title")) & F.col("content_key").eqNullSafe(F.col("old_key"))
    outcome = (
        F.when(F.col("work_id").isNull(), "chapter_not_found").when(F.col("old_key").isNull(), "chapter_missing_revision").when(F.col("head") != F.col("expected_revision_id"), "stale_chapter_revision").when(same, "unchanged").otherwise("applied")
    )
    judged = table(met.withColumn("outcome", outcome))
    done = judged.where("outcome = 'applied'")
    new_head = done.select(F.col("chapter_id").alias("id"), F.col("new_revision_id").alias("new_head"), F.col("label_raw").alias("new_label"))
    edited = chapters.join(new_head, "id", "left").withColumns({"head_revision_id": F.coalesce("new_head", "head_revision_id"), "label_raw": F.coalesce("new_label", "label_raw")}).select(*chapters.columns)
    more = done.select(F.col("new_revision_id").alias("id"), "chapter_id", "title", "content_key")
    counts = done.groupBy(F.col("work_id").alias("id")).agg(F.count("*").cast("int").alias("edits"))
    counted = works.join(counts, "id", "left").withColumn("edit_version", F.col("edit_version") + F.coalesce("edits", F.lit(0))).select(*works.columns)
    return judged.select("chapter_id", "outcome"), counted, edited, revisions.unionByName(more, allowMissingColumns=True)


def split_chapter(chapters: DataFrame, bodies: DataFrame, chapter_id, new_id, at: int, separator: str = "\n\n") -> tuple[DataFrame, DataFrame]:
    """Cuts a chapter before paragraph ``at``; later chapters, deleted ones too, move by one."""
    me = chapters.where(F.col("id") == chapter_id).select("work_id", F.col("position").alias("cut"))
    moved = chapters.join(F.broadcast(me), "work_id", "left").withColumn("position", F.when(F.col("position") > F.col("cut"), F.col("position") + 1).otherwise(F.col("position"))).drop("cut")
    extra = chapters.where(F.col("id") == chapter_id).withColumn("id", F.lit(new_id).cast(chapters.schema["id"].dataType)).withColumn("position", F.col("position") + 1)
    ps = F.split("body", separator, -1)
    first = bodies.withColumn("body", F.when(F.col("id") == chapter_id, F.array_join(F.slice(ps, 1, at), separator)).otherwise(F.col("body")))
    second = bodies.where(F.col("id") == chapter_id).select(F.lit(new_id).cast(bodies.schema["id"].dataType).alias("id"), F.array_join(F.slice(ps, F.lit(at + 1), F.greatest(F.size(ps) - at, F.lit(0))), separator).alias("body"))
    return moved.unionByName(extra.select(*moved.columns)), first.unionByName(second.select(*first.columns))


def can_merge(chapters: DataFrame, published: DataFrame, referenced: DataFrame) -> DataFrame:
    """``id, next_id``: neighbours of a volume of which neither is published or referred to by readers."""
    w = Window.partitionBy("work_id").orderBy("position", "id")
    pairs = chapters.where("deleted_at IS NULL AND merged_into_chapter_id IS NULL").select("work_id", "id", "volume_id", F.lead("id").over(w).alias("next_id"), F.lead("volume_id").over(w).alias("next_volume"))
    pairs = pairs.where(F.col("next_id").isNotNull() & F.col("volume_id").eqNullSafe(F.col("next_volume")))
    used = published.select("chapter_id").unionByName(referenced.select("chapter_id")).distinct()
    for c in ("id", "next_id"):
        pairs = pairs.join(used.select(F.col("chapter_id").alias(c)), c, "left_anti")
    return pairs.select("id", "next_id")


def merge_chapters(chapters: DataFrame, bodies: DataFrame, allowed: DataFrame, separator: str = "\n\n") -> tuple[DataFrame, DataFrame]:
    """Joins each pair of ``allowed`` (id, next_id; see :func:`can_merge`): the first takes the second's paragraphs, the second points to it.

    Pairs must not share a chapter. Positions stay: a merged chapter keeps its slot.
    """
    into = allowed.select(F.col("next_id").alias("id"), F.col("id").alias("into"))
    merged = chapters.join(into, "id", "left").withColumn("merged_into_chapter_id", F.coalesce("into", "merged_into_chapter_id")).select(*chapters.columns)
    more = bodies.join(into, "id").select(F.col("into").alias("id"), F.col("body").alias("more"))
    joined = F.concat_ws(separator, *[F.when(F.col(c) != "", F.col(c)) for c in ("body", "more")])
    texts = bodies.join(more, "id", "left").withColumn("body", F.when(F.col("more").isNull(), F.col("body")).otherwise(joined)).select(*bodies.columns)
    return merged, texts


def soft_delete(chapters: DataFrame, chapter_id, at: Column) -> DataFrame:
    """Marks a chapter deleted, unless it is its work's last."""
    live = F.count_if(F.col("deleted_at").isNull()).over(Window.partitionBy("work_id"))
    return chapters.withColumn("live", live).withColumn("deleted_at", F.when((F.col("id") == chapter_id) & F.col("deleted_at").isNull() & (F.col("live") > 1), at).otherwise(F.col("deleted_at"))).drop("live")


def set_removed(works: DataFrame, work_id, removed: bool) -> DataFrame:
    """Takes a work away or brings it back as a draft; either is an edit."""
    hit = (F.col("id") == work_id) & ((F.col("visibility") != "removed") if removed else (F.col("visibility") == "removed"))
    return works.withColumn("edit_version", F.when(hit, F.col("edit_version") + 1).otherwise(F.col("edit_version"))).withColumn("visibility", F.when(hit, "removed" if removed else "draft").otherwise(F.col("visibility")))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest wins: the changed rows replace those with their keys."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_turn"), F.desc(order))
    both = table.withColumn("_turn", F.lit(0)).unionByName(changes.withColumn("_turn", F.lit(1)))
    return both.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth", "_turn")


def resource_digest(links: DataFrame, key: str) -> DataFrame:
    """A hash of the images of each ``key``: content hashes with alternative texts, sorted."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "content_hash", F.coalesce("alt", F.lit(""))))), "\n")
    return links.groupBy(key).agg(F.sha2(lines, 256).alias("resource_digest"))
