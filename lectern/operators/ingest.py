"""Quality of an import, and matching its chapters with those that are there."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # sha256 of nothing
MOST_NUMBER = 1_000_000
#: Rows of a task of the matcher, on average: what its sorts hold stays the same however many rows there are.
ROWS_A_TASK = 100_000


def repeated(items: DataFrame, key: Column, where: Column, kind: str) -> DataFrame:
    """Items that share a key with others of their job, a row each; ``items``: job_id, position, label_raw and what the key needs."""
    keyed = items.where(where).select("job_id", "position", key.alias("key"))
    groups = keyed.groupBy("job_id", "key").agg(F.count("*").alias("n"), F.min("position").alias("finding")).where("n > 1").drop("n")
    # two plain exchanges: adaptive execution splits a key that very many items share
    return keyed.join(groups, ["job_id", "key"]).select("job_id", F.lit(kind).alias("type"), "finding", "position")


def gaps(items: DataFrame) -> DataFrame:
    """Neighbouring single-number labels of a volume and key family between which numbers are missing, both as rows."""
    usable = items.where(F.col("number").isNotNull() & F.col("number").between(1, MOST_NUMBER))
    w = Window.partitionBy("job_id").orderBy("position")
    both = usable.select("job_id", "position", "volume", "family", "number", *[F.lag(c).over(w).alias(f"last_{c}") for c in ("position", "volume", "family", "number")])
    jump = F.col("volume").eqNullSafe(F.col("last_volume")) & (F.col("family") == F.col("last_family")) & (F.col("number") > F.col("last_number") + 1)
    return both.where(jump).select("job_id", F.lit("gap").alias("type"), F.col("last_position").alias("finding"), F.explode(F.array("last_position", "position")).alias("position"))


def quality(items: DataFrame) -> DataFrame:
    """``job_id, type, finding, position``: empty bodies, repeated labels and bodies, gaps, a row for each item concerned.

    Rows of one finding have its first position as ``finding``; no finding is
    an array, however many items it concerns. ``items``: job_id, position,
    volume, label_key, family, number, body_hash.
    """
    empty = items.where(F.col("body_hash") == EMPTY_HASH).select("job_id", F.lit("empty").alias("type"), F.col("position").alias("finding"), "position")
    labels = repeated(items, F.struct(F.coalesce("volume", F.lit("")), "label_key"), F.col("label_key").isNotNull(), "duplicate_label")
    bodies = repeated(items, F.struct("body_hash"), F.col("body_hash") != EMPTY_HASH, "duplicate_body")
    return reduce(DataFrame.unionByName, [empty, labels, bodies, gaps(items)])


def match(existing: DataFrame, source: DataFrame) -> DataFrame:
    """Classes the chapters of an import against those of its work.

    ``existing``: work_id, id, label_key, position, body_hash, resource_digest.
    ``source``: work_id, item_id, label_key, position, body_hash, resource_digest.
    Gives each source item its class (unchanged, modified, new, ambiguous,
    structural_conflict), the chapter it matches, the anchors between which a new
    one goes, and whether that place is certain. A key that the source repeats is
    ambiguous even where no chapter has it. A new item is in conflict where
    chapters that nothing matches lie between its anchors, or after its only one.

    Both sides are dealt out by work once; every window below is within a work.
    The tasks are as many as the rows, which are counted first, demand.
    """
    side = lambda df, **more: df.select("work_id", "label_key", F.col("position").cast("long").alias("position"), "body_hash", F.coalesce("resource_digest", F.lit("")).alias("digest"), *[v.alias(k) for k, v in more.items()])
    chapters = side(existing, old=F.lit(True), id=F.col("id"))
    items = side(source, old=F.lit(False), item_id=F.col("item_id"))
    tasks = max(existing.sparkSession.sparkContext.defaultParallelism, math.ceil((existing.count() + source.count()) / ROWS_A_TASK))
    rows = chapters.unionByName(items, allowMissingColumns=True).repartition(tasks, "work_id")

    old, keyed = F.col("old"), F.col("label_key").isNotNull()
    key, body, work = Window.partitionBy("work_id", "label_key"), Window.partitionBy("work_id", "body_hash"), Window.partitionBy("work_id")
    rows = rows.withColumns({"e_uses": F.count_if(old).over(key), "s_uses": F.count_if(~old).over(key)})
    paired = keyed & (F.col("e_uses") == 1) & (F.col("s_uses") == 1)
    rows = rows.withColumn("paired", paired).withColumn("loose", old & ~paired)
    # loose chapters before each chapter's place, and in all
    upto = work.orderBy("position").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"below": F.coalesce(F.count_if("loose").over(upto), F.lit(0)), "loose_all": F.count_if("loose").over(work)})
    mine = F.struct("id", "position", "body_hash", "digest", "below")
    rows = rows.withColumn("m", F.when(F.col("paired"), F.max(F.when(old, mine)).over(key)))
    has_body = old & F.col("body_hash").isNotNull()
    owner = F.when(has_body, F.col("id"))
    rows = rows.withColumns({"free_bodies": F.count_if(has_body & F.col("loose")).over(body), "owner": F.min(owner).over(body), "owner2": F.max(owner).over(body)})

    same = F.col("body_hash").eqNullSafe(F.col("m.body_hash"))
    elsewhere = (F.col("owner") != F.col("m.id")) | (F.col("owner2") != F.col("m.id"))
    first = (
        F.when(F.col("paired"), F.when(same & (F.col("digest") == F.col("m.digest")), "unchanged").when(same, "modified").when(F.coalesce(elsewhere, F.lit(False)), "structural_conflict").otherwise("modified"))
        .when(keyed & ((F.col("e_uses") > 1) | (F.col("s_uses") > 1)), "ambiguous")
        .when(F.col("free_bodies") == 1, "ambiguous")
        .otherwise("new")
    )
    order = work.orderBy("position", "item_id")
    so_far, to_come = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    placed = rows.where(~old).withColumn("first", first).withColumn("before", F.last("m", ignorenulls=True).over(so_far)).withColumn("after", F.first("m", ignorenulls=True).over(to_come))
    is_new, left, right = F.col("first") == "new", F.col("before").isNotNull(), F.col("after").isNotNull()
    between = F.when(right, F.col("after.below")).otherwise(F.col("loose_all")) - F.col("before.below")
    crossed = is_new & left & (between > 0)
    inverted = F.col("m").isNotNull() & (F.col("before.position") > F.col("m.position"))
    final = F.when(F.coalesce(crossed | inverted, F.lit(False)), "structural_conflict").otherwise(F.col("first"))
    return placed.select(
        "work_id", "item_id", F.col("position").cast(source.schema["position"].dataType).alias("position"), final.alias("class"), F.col("m.id").alias("matched_chapter_id"),
        F.when(is_new & (right | ~F.coalesce(crossed, F.lit(False))), F.col("before.id")).alias("insert_after_id"), F.when(is_new, F.col("after.id")).alias("insert_before_id"),
        (is_new & (left | right) & ~F.coalesce(crossed, F.lit(False))).alias("position_confident"),
    )


def missing(existing: DataFrame, matched: DataFrame) -> DataFrame:
    """Chapters that no source item matches."""
    return existing.join(matched.where("matched_chapter_id IS NOT NULL").select("work_id", F.col("matched_chapter_id").alias("id")), ["work_id", "id"], "left_anti")


def needs_review(matched: DataFrame) -> DataFrame:
    """``work_id, needs_review``: something is unsure, in conflict, or new without a certain place."""
    odd = F.col("class").isin("ambiguous", "structural_conflict") | ((F.col("class") == "new") & ~F.col("position_confident"))
    return matched.groupBy("work_id").agg(F.bool_or(odd).alias("needs_review"))


CLASSES = ("unchanged", "modified", "new", "ambiguous", "structural_conflict")


def histogram(matched: DataFrame) -> DataFrame:
    """Counts of every class, zeros included."""
    spark = matched.sparkSession
    every = spark.createDataFrame([(c,) for c in CLASSES], "class string")
    return every.join(matched.groupBy("class").agg(F.count("*").alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def decide(matched: DataFrame, decisions: DataFrame, mode: str = "incremental") -> DataFrame:
    """What to do with each item: add, update, keep, skip, or unresolved.

    ``decisions``: work_id, item_id, choice (new, exclude, match), target. A
    chapter that two items are matched to leaves both unresolved. Modified
    chapters are updated in overwrite mode and kept in incremental mode.
    """
    if mode not in ("incremental", "overwrite"):
        raise ValueError("invalid_mode")
    d = matched.join(decisions, ["work_id", "item_id"], "left")
    target = F.when(F.col("choice") == "match", F.col("target")).when(F.col("choice").isNull() & F.col("class").isin("unchanged", "modified"), F.col("matched_chapter_id"))
    d = d.withColumn("chapter_id", target)
    twice = F.count("chapter_id").over(Window.partitionBy("work_id", "chapter_id")) > 1
    action = (
        F.when(F.col("choice") == "exclude", "skip")
        .when(F.col("chapter_id").isNotNull() & twice, "unresolved")
        .when(F.col("choice") == "new", "add")
        .when(F.col("chapter_id").isNotNull(), F.when(F.col("choice").isNull() & (F.col("class") == "unchanged"), "keep").otherwise("update" if mode == "overwrite" else "keep"))
        .when((F.col("class") == "new") & F.col("position_confident"), "add")
        .otherwise("unresolved")
    )
    return d.withColumn("action", action).select("work_id", "item_id", "position", "class", "chapter_id", "insert_after_id", "action")


def summary(decided: DataFrame, missing_chapters: DataFrame) -> DataFrame:
    """``work_id`` with the counts of an applied plan."""
    a = lambda *c: F.count_if(reduce(lambda x, y: x & y, c))
    act, cls = F.col("action"), F.col("class")
    n = decided.groupBy("work_id").agg(a(act == "add").alias("added"), a(act == "update").alias("updated"), a(act == "keep", cls == "unchanged").alias("unchanged"), a(act == "keep", cls != "unchanged").alias("modified_kept"), a(act == "skip").alias("skipped"))
    return n.join(missing_chapters.groupBy("work_id").agg(F.count("*").alias("missing_kept")), "work_id", "left").fillna(0, ["missing_kept"])


def merge_order(existing: DataFrame, added: DataFrame) -> DataFrame:
    """``work_id, chapter_id, item_id, position``: chapters in place, additions after their anchors in source order.

    Additions without an anchor before them go to the end. ``existing``:
    work_id, id, position; ``added``: work_id, item_id, position, insert_after_id.
    """
    anchors = existing.select("work_id", F.col("id").alias("insert_after_id"), F.col("position").alias("anchor"))
    old = existing.select("work_id", F.col("id").alias("chapter_id"), F.lit(None).cast("string").alias("item_id"), F.col("position").cast("long").alias("anchor"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("nth"))
    new = added.join(anchors, ["work_id", "insert_after_id"], "left").select("work_id", F.lit(None).cast(existing.schema["id"].dataType).alias("chapter_id"), F.col("item_id").cast("string").alias("item_id"), F.coalesce("anchor", F.lit(1 << 31)).cast("long").alias("anchor"), F.lit(1).alias("rank"), F.col("position").cast("long").alias("nth"))
    w = Window.partitionBy("work_id").orderBy("anchor", "rank", "nth")
    return old.unionByName(new).withColumn("position", F.row_number().over(w)).select("work_id", "chapter_id", "item_id", "position")


def renumber(rows: DataFrame, reserved: DataFrame) -> DataFrame:
    """The k-th row of a work takes its k-th position that isn't reserved.

    ``rows``: work_id, id, position; ``reserved``: work_id, position. Instead of
    listing free slots: the k-th free position is k plus the reserved ones
    before it, and a reserved p with j reserved up to it precedes it when p - j < k.
    """
    k = rows.select("work_id", "id", F.row_number().over(Window.partitionBy("work_id").orderBy("position", "id")).alias("k"))
    w = Window.partitionBy("work_id").orderBy("position")
    r = reserved.select("work_id", "position").distinct().select("work_id", (F.col("position") - F.row_number().over(w)).alias("k"), F.lit(1).alias("one"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"))
    # reserved slots with p - j < k come before the k-th row
    both = k.select("work_id", "id", F.col("k"), F.lit(0).alias("one")).unionByName(r.select("work_id", "id", (F.col("k") + 1).alias("k"), "one"))
    before = F.sum("one").over(Window.partitionBy("work_id").orderBy("k").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("position", (F.col("k") + before).cast("int")).where("one = 0").select("work_id", "id", "position")


def revert(chapters: DataFrame, applied: DataFrame, released: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Undoes an applied import unless a release uses what it made, or the work was edited since.

    ``chapters``: work_id, id, position, head_revision_id. ``applied``: work_id,
    chapter_id, previous_revision_id (null for additions), new_revision_id.
    ``released``: work_id, revision_id. ``versions``: work_id, applied_version,
    edit_version. Works with a released new revision, or with another version
    than the import left, stay as they are; elsewhere heads go back, additions
    go, positions close up.
    """
    locked = applied.join(released.select("work_id", F.col("revision_id").alias("new_revision_id")), ["work_id", "new_revision_id"], "left_semi").select("work_id").distinct()
    if versions is not None:
        locked = locked.unionByName(versions.where("applied_version <> edit_version").select("work_id")).distinct()
    todo = applied.join(locked, "work_id", "left_anti").select("work_id", F.col("chapter_id").alias("id"), "previous_revision_id", F.lit(True).alias("touched"))
    back = chapters.join(todo, ["work_id", "id"], "left").where("touched IS NULL OR previous_revision_id IS NOT NULL")
    back = back.withColumn("head_revision_id", F.coalesce("previous_revision_id", "head_revision_id"))
    return back.withColumn("position", F.row_number().over(Window.partitionBy("work_id").orderBy("position", "id"))).select("work_id", "id", "position", "head_revision_id")


def review_targets(chapters: DataFrame, work_id, q: str = "", limit: int = 40) -> DataFrame:
    """Chapters an import's item may be matched with by hand, in order, one more than ``limit`` if there are more.

    ``q`` is a pattern as it stands: % and _ in it are wild.
    """
    mine = chapters.where((F.col("work_id") == work_id) & F.col("merged_into_chapter_id").isNull() & F.col("deleted_at").isNull())
    q = q.strip()[:100]
    return (mine.where(F.col("label_raw").ilike(f"%{q}%")) if q else mine).orderBy("position", "id").limit(limit + 1).select("id", "label_raw", "position")
