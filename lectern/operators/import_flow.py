"""The way of a book from its file to chapters: staging, first commit, overwrites, reanalysis.

Tables in, tables out: a caller writes them. Jobs go side by side, each with its
id on every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.encoding import decode_files
from lectern.functions.scalars import revision_hash
from lectern.operators import ingest
from lectern.sources import text_files
from lectern.sources.objects import object_key

# Versions of the parsers and of the matcher, which revision hashes hold.
PARSERS = {"txt": "txt-3", "epub": "epub-2"}
MATCHER = "match-2"


def processor_version(form: str) -> str:
    return f"m3:{PARSERS[form]}+{MATCHER}"


def stage(files: DataFrame, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Items and jobs of plain-text files from ``spark.read.format("binaryFile")``; a job is a path.

    Items: job_id, position, volume_label, label_raw, label_key, family, number,
    title, body, body_hash, content_key, warnings, needs_review. Jobs: job_id,
    status (ready, review_required, failed), encoding, chapter_count, error_code,
    findings, how many of each type :func:`ingest.quality` lists.
    """
    books = decode_files(files)
    found = text_files.chapters(books, pattern)
    label, parts = F.col("label"), F.col("label.parts")
    items = found.select(
        F.col("path").alias("job_id"), "position", "volume_label", "label_raw", label["key"].alias("label_key"), F.split_part(label["key"], F.lit(":"), F.lit(1)).alias("family"),
        F.when(F.size(parts) == 1, F.get(parts, F.lit(0)).cast("long")).alias("number"), "title", "body", F.sha2("body", 256).alias("body_hash"), object_key(F.col("body"), "txt").alias("content_key"), "warnings", "needs_review",
    )
    # the rows of the report are ingest.quality's; a job has their number by type
    found = ingest.quality(items.withColumn("volume", F.col("volume_label"))).select("job_id", "type", "finding").distinct().groupBy("job_id", "type").agg(F.count("*").alias("n"))
    report = found.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("findings"))
    counted = items.groupBy("job_id").agg(F.count("*").cast("int").alias("chapter_count"), F.bool_or("needs_review").alias("review"))
    jobs = books.select(F.col("path").alias("job_id"), "encoding").join(counted, "job_id", "left").join(report, "job_id", "left")
    empty = F.col("chapter_count").isNull()
    status = F.when(empty, "failed").when(F.col("review"), "review_required").otherwise("ready")
    return items, jobs.select("job_id", status.alias("status"), "encoding", F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"), F.when(empty, "empty_source").alias("error_code"), "findings")


def _revised(rows: DataFrame, version: Column) -> DataFrame:
    """``rows`` with ``revision_hash, revision_id``; the id is the chapter's with the hash, so a repeated run makes no other."""
    digest = revision_hash(F.col("title"), F.col("body_hash"), version, F.col("resource_digest"))
    return rows.withColumn("revision_hash", digest).withColumn("revision_id", F.sha2(F.concat_ws("/", F.col("chapter_id").cast("string"), "revision_hash", F.col("job_id").cast("string")), 256))


def _revisions(rows: DataFrame, version: Column) -> DataFrame:
    """New revisions of ``chapter_id, title, content_key, body_hash``."""
    return _revised(rows, version).select(F.col("revision_id").alias("id"), "chapter_id", "title", "content_key", "body_hash", "revision_hash", "job_id")


def first_commit(jobs: DataFrame, items: DataFrame, chapters: DataFrame, version: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chapters, revisions and the jobs as they are afterwards.

    ``jobs``: job_id, work_id, status. A ready or reviewed job whose work has no
    chapter gets chapters 1 to n, each with one revision that is its head. A
    committed job is replayed and gives nothing new; others say why not.
    """
    taken = chapters.select("work_id", F.lit(True).alias("taken")).distinct()
    outcome = F.when(F.col("status") == "committed", "already_committed").when(~F.col("status").isin("ready", "review_required"), "not_committable").when(F.col("taken"), "work_not_empty").otherwise("committed")
    judged = jobs.join(taken, "work_id", "left").withColumn("outcome", outcome).drop("taken")
    order = Window.partitionBy("job_id").orderBy("position")
    rows = items.join(judged.where("outcome = 'committed'").select("job_id", "work_id"), "job_id").withColumn("at", F.row_number().over(order))
    if "resource_digest" not in rows.columns:
        rows = rows.withColumn("resource_digest", F.lit(""))
    rows = rows.withColumn("chapter_id", F.sha2(F.concat_ws("/", F.col("work_id").cast("string"), F.col("at").cast("string")), 256))
    revisions = _revisions(rows, F.lit(version))
    # a head is its own row's revision, and needs no join
    new = _revised(rows, F.lit(version)).select(F.col("chapter_id").alias("id"), "work_id", "label_raw", F.col("at").alias("position"), F.col("revision_id").alias("head_revision_id"))
    after = judged.withColumn("status", F.when(F.col("outcome") == "committed", "committed").otherwise(F.col("status")))
    return new, revisions, after


def overwrite(decided: DataFrame, items: DataFrame, chapters: DataFrame, version: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Revisions for the chapters that ``decided`` (work_id, item_id, action, chapter_id) updates, the chapters with their heads moved, and the changes.

    Chapters keep their ids, and old revisions stay; merged and deleted chapters
    keep their heads. Changes: chapter_id, previous_revision_id, revision_id.
    """
    rows = decided.where("action = 'update'").select("item_id", "chapter_id").join(items, "item_id")
    if "resource_digest" not in rows.columns:
        rows = rows.withColumn("resource_digest", F.lit(""))
    live = chapters.where("merged_into_chapter_id IS NULL AND deleted_at IS NULL").select(F.col("id").alias("chapter_id"), F.col("head_revision_id").alias("previous_revision_id"))
    revisions = _revisions(rows.join(live, "chapter_id", "left_semi"), F.lit(version))
    changes = revisions.select("chapter_id", F.col("id").alias("revision_id")).join(live, "chapter_id").select("chapter_id", "previous_revision_id", "revision_id")
    moved = chapters.join(changes.select(F.col("chapter_id").alias("id"), "revision_id"), "id", "left")
    return revisions, moved.withColumn("head_revision_id", F.coalesce(F.col("revision_id"), F.col("head_revision_id").cast("string"))).drop("revision_id"), changes


def reanalyze(jobs: DataFrame, items: DataFrame, again: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, items and the bodies to delete once the jobs in ``again (job_id)`` are queued anew.

    Only ready, reviewed and failed jobs go back; their items go, and of these
    the bodies that neither another item nor ``references (content_key)`` needs.
    """
    back = jobs.join(again, "job_id", "left_semi").where(F.col("status").isin("ready", "review_required", "failed")).select("job_id", F.lit(True).alias("back"))
    queued = jobs.join(back, "job_id", "left").withColumn("status", F.when(F.col("back"), "queued").otherwise(F.col("status"))).drop("back")
    kept = items.join(back, "job_id", "left_anti")
    gone = items.join(back, "job_id", "left_semi").select("content_key").distinct()
    return queued, kept, gone.join(kept.select("content_key"), "content_key", "left_anti").join(references.select("content_key"), "content_key", "left_anti")
