"""Clicks, rankings, shelves and reading statistics.

Every window takes its day as a parameter, so that a rerun gives the same rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.operators.catalog import listed

PERIOD_DAYS = {"week": 7, "month": 30, "year": 365, "all": None}
DAY_SECONDS = 86_400
CLICK_ZONE = "Asia/Taipei"


def day_in(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def click_rows(clicks: DataFrame) -> DataFrame:
    """One row a work, visitor and day in Taipei; visitors only as a hash with the work."""
    visitor = F.sha2(F.concat_ws(":", F.col("work_id").cast("string"), F.col("visitor").cast("string")), 256)
    return clicks.select("work_id", visitor.alias("visitor_hash"), day_in(F.col("ts"), CLICK_ZONE).alias("day")).dropDuplicates(["work_id", "visitor_hash", "day"])


def since(day: Column, as_of, period: str) -> Column:
    """Whether ``day`` is in the period that ends with, and includes, ``as_of``."""
    n = PERIOD_DAYS[period]
    today = F.lit(as_of).cast("date")
    return F.lit(True) if n is None else day >= F.date_sub(today, n - 1)


def ranking(scored: DataFrame, works: DataFrame, limit: int = 50) -> DataFrame:
    """``scored``: one row a point, with work_id. Listed works by points, title, id."""
    points = scored.groupBy(F.col("work_id").alias("id")).agg(F.count("*").alias("score"))
    return listed(works).join(points, "id").orderBy(F.desc("score"), "title", "id").limit(limit)


def click_ranking(clicks: DataFrame, works: DataFrame, as_of, period: str = "week") -> DataFrame:
    return ranking(click_rows(clicks).where(since(F.col("day"), as_of, period)), works)


def favourite_ranking(library: DataFrame, works: DataFrame, as_of, period: str = "week") -> DataFrame:
    """Counts when a work was put on a shelf, never when the shelf was changed."""
    return ranking(library.where(since(day_in(F.col("created_at"), CLICK_ZONE), as_of, period)), works)


def in_category(works: DataFrame, work_categories: DataFrame, categories: DataFrame, category_id) -> DataFrame:
    """Works of an active category."""
    live = work_categories.where(F.col("category_id") == category_id).join(categories.where("is_active").select(F.col("id").alias("category_id")), "category_id", "left_semi")
    return works.join(live.select(F.col("work_id").alias("id")), "id", "left_semi")


def capped_seconds(heartbeats: DataFrame) -> DataFrame:
    """Seconds a user and UTC day, a day at most; reports are positive, so the cap may wait for the end."""
    return heartbeats.groupBy("user_id", F.to_date("ts").alias("activity_date")).agg(F.least(F.lit(DAY_SECONDS).cast("long"), F.sum("seconds")).alias("active_seconds"))


def visible_reads(reads: DataFrame, works: DataFrame, role: str = "") -> DataFrame:
    """Reads of works that still are there for the reader: removed ones never, drafts for an editor."""
    hidden = ("removed",) if role == "admin" else ("removed", "draft")
    return reads.join(works.where(~F.col("visibility").isin(*hidden)).select(F.col("id").alias("work_id")), "work_id", "left_semi")


def reading_totals(reads: DataFrame, activity: DataFrame, user_id) -> DataFrame:
    """One row: distinct chapters and works, and seconds, which don't depend on them."""
    mine = reads.where(F.col("user_id") == user_id).agg(F.count_distinct("chapter_id").alias("chapters"), F.count_distinct("work_id").alias("works"))
    seconds = activity.where(F.col("user_id") == user_id).agg(F.coalesce(F.sum("active_seconds"), F.lit(0)).cast("long").alias("seconds"))
    return mine.crossJoin(F.broadcast(seconds))  # one row each


def recent_works(reads: DataFrame, user_id, limit: int = 20) -> DataFrame:
    """The last chapter read of each work, with the number read; latest first, then work."""
    work = Window.partitionBy("work_id")
    latest = work.orderBy(F.desc("last_read_at"), "chapter_id")
    mine = reads.where(F.col("user_id") == user_id).withColumn("chapters", F.count("*").over(work)).withColumn("nth", F.row_number().over(latest))
    return mine.where("nth = 1").select("work_id", "chapter_id", "chapters", "last_read_at").orderBy(F.desc("last_read_at"), "work_id").limit(limit)


def calendar(reads: DataFrame, activity: DataFrame, user_id, as_of, days: int = 365) -> DataFrame:
    """Chapters first read and seconds by UTC day, for the days up to ``as_of``."""
    first = F.date_sub(F.lit(as_of).cast("date"), days - 1)
    new = reads.where(F.col("user_id") == user_id).select(F.to_date("first_read_at").alias("day"), F.lit(1).cast("long").alias("chapters"), F.lit(0).cast("long").alias("seconds"))
    spent = activity.where(F.col("user_id") == user_id).select(F.col("activity_date").alias("day"), F.lit(0).cast("long").alias("chapters"), F.col("active_seconds").cast("long").alias("seconds"))
    return new.unionByName(spent).where(F.col("day").between(first, F.lit(as_of).cast("date"))).groupBy("day").agg(F.sum("chapters").alias("chapters"), F.sum("seconds").alias("seconds"))


def heat(reads: Column, seconds: Column) -> Column:
    """0 to 4: reads and ten minutes of reading weigh the same."""
    w = reads + F.floor(seconds / 600)
    return F.when(w <= 0, 0).when(w <= 2, 1).when(w <= 5, 2).when(w <= 9, 3).otherwise(4)


def read_marks(events: DataFrame) -> DataFrame:
    """First and last time that a user read a chapter."""
    return events.groupBy("user_id", "chapter_id").agg(F.min("ts").alias("first_read_at"), F.max("ts").alias("last_read_at"))


def sessions(heartbeats: DataFrame, gap: str = "90 seconds") -> DataFrame:
    """Runs of activity without a pause of ``gap`` or more."""
    w = F.session_window("ts", gap)
    return heartbeats.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("beats"), F.min("ts").alias("began"), F.max("ts").alias("ended")).drop("w")


def shelf(library: DataFrame, user_id, status: str | None = None, group: str | None = None, limit: int = 20, after=None) -> DataFrame:
    """A user's shelf, last changed first; ``group`` '' is the ungrouped part. One row more than ``limit`` tells of a next page."""
    mine = library.where(F.col("user_id") == user_id)
    if status:
        mine = mine.where(F.col("reading_status") == status)
    if group is not None:
        mine = mine.where(F.col("group_name").isNull() if group == "" else F.col("group_name") == group)
    if after:
        ts, work = F.lit(after[0]).cast("timestamp"), after[1]
        mine = mine.where((F.col("updated_at") < ts) | ((F.col("updated_at") == ts) & (F.col("work_id") > work)))
    return mine.orderBy(F.col("updated_at").desc(), "work_id").limit(limit + 1)


def shelf_groups(library: DataFrame, user_id) -> DataFrame:
    return library.where((F.col("user_id") == user_id) & F.col("group_name").isNotNull()).select("group_name").distinct()


def unseen(follows: DataFrame, releases: DataFrame) -> DataFrame:
    """For each follow the latest version and the chapters added since the one last seen."""
    from lectern.operators.projections import newer_than

    rows = newer_than(follows.select("user_id", "work_id", "last_seen"), releases, "last_seen")
    latest = F.greatest(F.coalesce("latest_version", F.lit(0)), F.col("last_seen"))
    return rows.withColumn("latest_version", latest).withColumn("has_update", F.col("latest_version") > F.col("last_seen"))


def mark_seen(requested: Column, latest: Column) -> Column:
    return F.least(requested, latest)


def merge_progress(writes: DataFrame) -> DataFrame:
    """Optimistic writes of a user and work, folded in order.

    ``writes``: user_id, work_id, seq, base_version, position. A write applies
    where its base is the current version (0 makes the first); others conflict.
    Versions depend only on how many applied, so each write needs the state
    before it: a fold over the ordered writes of one user and work.
    """

    def fold(batches):
        key, state = None, None
        for b in batches:
            done = []
            for *now, base, position in zip(*[b.column(c).to_pylist() for c in ("user_id", "work_id", "base_version", "position")]):
                if now != key:
                    if key is not None:
                        done.append((*key, *state))
                    key, state = now, [0, None, 0]
                if base == state[0]:
                    state[0], state[1] = state[0] + 1, position
                else:
                    state[2] += 1
            yield _batch(done, kinds)
        if key is not None:
            yield _batch([(*key, *state)], kinds)

    of = lambda c: writes.schema[c].dataType.simpleString()
    schema = f"user_id {of('user_id')}, work_id {of('work_id')}, version int, position int, conflicts int"
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    # a key's writes come in order, and only their state is held
    ordered = writes.select("user_id", "work_id", "seq", "base_version", "position").repartition("user_id", "work_id").sortWithinPartitions("user_id", "work_id", "seq")
    return ordered.mapInArrow(fold, schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
