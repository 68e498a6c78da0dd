"""Tables of contents: windows, neighbours, ends and version tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.scan import running
from lectern.stored import table


def ordinals(chapters: DataFrame, descending: bool = False) -> DataFrame:
    """``ordinal`` from 0 within each work; merged and deleted chapters must be gone."""
    first = F.desc("position") if descending else F.asc("position")
    return chapters.withColumn("ordinal", F.row_number().over(Window.partitionBy("work_id").orderBy(first, "id")) - 1)


def active(chapters: DataFrame) -> DataFrame:
    return chapters.where("merged_into_chapter_id IS NULL AND deleted_at IS NULL")


def titled(chapters: DataFrame, variants: list[str], columns=("label_raw", "title")) -> DataFrame:
    """Chapters whose label or title holds a variant literally."""
    return chapters.where(reduce(lambda a, b: a | b, [F.lower(c).contains(v.lower()) for c in columns for v in variants]))


def window(chapters: DataFrame, limit: int = 200, offset: int = 0, around=None, latest: bool = False, descending: bool = False) -> DataFrame:
    """Of each work, ``limit`` rows: around a chapter, the last ones, or from an offset, all clamped to what there is.

    ``anchor_missing`` tells that ``around`` isn't among them.
    """
    rows = ordinals(chapters, descending)
    w = Window.partitionBy("work_id")
    rows = rows.withColumn("total", F.count("*").over(w))
    anchor = F.max(F.when(F.col("id") == around, F.col("ordinal"))).over(w) if around is not None else F.lit(None).cast("int")
    most = F.greatest(F.lit(0), F.col("total") - limit)
    start = F.when(F.col("anchor").isNotNull(), F.greatest(F.lit(0), F.least(most, F.col("anchor") - limit // 2)))
    start = start.otherwise(most if latest else F.lit(max(0, offset)))
    rows = rows.withColumn("anchor", anchor).withColumn("start", start).withColumn("anchor_missing", F.lit(around is not None) & F.col("anchor").isNull())
    return rows.where((F.col("ordinal") >= F.col("start")) & (F.col("ordinal") < F.col("start") + limit)).drop("anchor", "start")


def neighbours(chapters: DataFrame) -> DataFrame:
    w = Window.partitionBy("work_id").orderBy("position", "id")
    return chapters.select("work_id", "id", F.lag("id").over(w).alias("previous_id"), F.lead("id").over(w).alias("next_id"))


def ends(chapters: DataFrame) -> DataFrame:
    at = F.struct("position", "id")
    return chapters.groupBy("work_id").agg(F.min_by("id", at).alias("first_id"), F.max_by("id", at).alias("last_id"), F.count("*").alias("chapters"))


def page_json(page: DataFrame, columns: list[str]) -> DataFrame:
    """``work_id, chapters``: the rows of a :func:`window` as one JSON array a work, in order; a window bounds its length."""
    row = F.struct("ordinal", F.struct(*columns).alias("row"))
    return page.groupBy("work_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"])).alias("chapters"))


#: Chapters, or digests of the level below, in one digest.
CHUNK = 4_096


def version_token(chapters: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``work_id, toc_version``: a hash of the ordered chapters that changes if and only if the table of contents does.

    A tree of digests: each covers ``chunk`` neighbouring chapters, or digests of
    the level below, and a work's last one is its token. So a task holds a chunk,
    not a work; a work of one chunk is hashed at once. Rows that tie are in the
    order of their labels. A work without chapters has no token.
    """
    line = F.concat_ws(":", F.col("position").cast("string"), F.col("id").cast("string"), "label_raw").alias("line")
    placed = running(chapters.select("work_id", "position", "id", "label_raw", line, F.lit(1).cast("long").alias("one")), ["work_id"], ["position", "id", "label_raw"], {"nth": "one"})
    return _tokens(placed.select("work_id", (F.col("nth") - 1).alias("at"), "line"), chunk)


def _tokens(rows: DataFrame, chunk: int) -> DataFrame:
    """A level of the tree, and those above it for the works that need them: one for each factor of ``chunk`` in the largest work."""
    lines = F.array_sort(F.collect_list(F.struct("at", "line")))["line"]
    rows = table(rows.groupBy("work_id", F.floor(F.col("at") / chunk).alias("at")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("line")))
    large = rows.where("at > 0").select("work_id").distinct()
    if large.isEmpty():
        return rows.select("work_id", F.col("line").alias("toc_version"))
    done = rows.join(large, "work_id", "left_anti").select("work_id", F.col("line").alias("toc_version"))
    return done.unionByName(_tokens(rows.join(large, "work_id", "left_semi"), chunk))
