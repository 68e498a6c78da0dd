"""Queue states, sweeps, operational counts, backup manifests."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lectern.operators.selection import at_ranks
from lectern.stored import table

# Which import state may follow which; nothing follows cancelled, committed and reverted.
TRANSITIONS = {
    "queued": ("processing", "cancelled"),
    "processing": ("queued", "review_required", "ready", "failed", "cancelled"),
    "review_required": ("ready", "queued", "cancelled"),
    "ready": ("queued", "committed", "applied", "cancelled"),
    "failed": ("queued", "cancelled"),
    "cancelled": (),
    "committed": (),
    "applied": ("reverted",),
    "reverted": (),
}
MOST_ATTEMPTS = 3
LEASE_SECONDS = 300


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """The job a worker takes next: the oldest queued one, or one whose lease ran out with attempts left."""
    expired = (F.col("status") == "processing") & (F.col("lease_expires_at") < now) & (F.col("attempt_count") < MOST_ATTEMPTS)
    return jobs.where((F.col("status") == "queued") | expired).orderBy("created_at", "id").limit(1)


def reap(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs whose lease ran out at the last attempt have failed."""
    dead = (F.col("status") == "processing") & (F.col("lease_expires_at") < now) & (F.col("attempt_count") >= MOST_ATTEMPTS)
    return jobs.withColumn("status", F.when(dead, "failed").otherwise(F.col("status")))


def fenced(jobs: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, jobs)`` after workers' ``writes``, one a job at most: only who owns a job's lease may write.

    ``writes``: job_id, owner, action, at. ``renew`` moves the lease on by
    ``LEASE_SECONDS`` from ``at``; ``retry`` puts the job back and ``fail`` ends
    it, both without a lease. A write of another owner, or of a job that isn't
    processing or isn't there, is ``lease_lost`` and changes nothing; an action
    that isn't known is ``invalid``.
    """
    held = jobs.select(F.col("id").alias("job_id"), "status", "lease_owner")
    mine = (F.col("status") == "processing") & (F.col("lease_owner") == F.col("owner"))
    outcome = F.when(~F.col("action").isin("renew", "retry", "fail"), "invalid").when(F.coalesce(mine, F.lit(False)), "applied").otherwise("lease_lost")
    judged = writes.join(held, "job_id", "left").select("job_id", "owner", "action", "at", outcome.alias("outcome"))
    done = judged.where("outcome = 'applied'").select(F.col("job_id").alias("id"), "action", "at")
    action, renewed = F.col("action"), F.col("at") + F.make_dt_interval(secs=F.lit(LEASE_SECONDS))
    new = {
        "status": F.when(action == "retry", "queued").when(action == "fail", "failed").otherwise(F.col("status")),
        "lease_owner": F.when(action.isNull() | (action == "renew"), F.col("lease_owner")),
        "lease_expires_at": F.when(action == "renew", renewed).when(action.isNull(), F.col("lease_expires_at")),
        "error_code": F.when(action == "retry", "processing_retry").when(action == "fail", "processing_failed").otherwise(F.col("error_code")),
    }
    return judged.drop("at"), jobs.join(done, "id", "left").withColumns(new).select(*jobs.columns)


def illegal(steps: DataFrame) -> DataFrame:
    """Steps (before, after) that the state table does not list."""
    allowed = steps.sparkSession.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "before string, after string")
    return steps.join(F.broadcast(allowed), ["before", "after"], "left_anti")


def replay(requests: DataFrame) -> DataFrame:
    """Idempotency: of the requests with a key the first counts, equal ones replay it, others conflict."""
    w = Window.partitionBy("key").orderBy("seq")
    first = F.first("payload_hash").over(w)
    return requests.withColumn("outcome", F.when(F.row_number().over(w) == 1, "applied").when(F.col("payload_hash") == first, "replayed").otherwise("conflict"))


def orphans(objects: DataFrame, references: list[DataFrame], now: Column, min_age_hours: int = 24, limit: int = 5000) -> DataFrame:
    """Objects (key, modified_at) no table refers to and old enough to go."""
    used = reduce(DataFrame.union, [r.select("key") for r in references]).distinct()
    return objects.where(F.col("modified_at") < now - F.make_dt_interval(hours=F.lit(min_age_hours))).join(used, "key", "left_anti").orderBy("key").limit(limit)


def missing_objects(objects: DataFrame, references: DataFrame) -> DataFrame:
    """References (key, published) whose object is gone, counted by whether a release uses it."""
    return references.distinct().join(objects.select("key"), "key", "left_anti").groupBy("published").agg(F.count("*").alias("n"))


def expired_sessions(sessions: DataFrame, now: Column, grace_days: int = 30, limit: int = 5000) -> DataFrame:
    edge = now - F.make_dt_interval(days=F.lit(grace_days))
    return sessions.where((F.col("expires_at") < edge) | (F.col("revoked_at") < edge)).orderBy("id").limit(limit)


def spent_resets(resets: DataFrame, now: Column, grace_days: int = 30) -> DataFrame:
    """Password resets used or expired longer ago than the grace."""
    edge = now - F.make_dt_interval(days=F.lit(grace_days))
    return resets.where((F.col("expires_at") < edge) | (F.col("used_at") < edge))


def ops_counts(jobs: DataFrame, now: Column) -> DataFrame:
    """One row of queue health."""
    queued, busy = F.col("status") == "queued", F.col("status") == "processing"
    age = F.unix_timestamp(now) - F.unix_timestamp(F.min(F.when(queued, F.col("created_at"))))
    return jobs.agg(F.count_if(queued).alias("queued"), F.count_if(busy).alias("processing"), F.count_if(busy & (F.col("lease_expires_at") < now)).alias("stale"), F.count_if(F.col("status") == "failed").alias("failed"), age.alias("oldest_queued_seconds"))


def ops_warnings(counts: DataFrame) -> DataFrame:
    each = [("stale_leases", F.col("stale") > 0), ("failed_jobs", F.col("failed") > 0), ("queue_delay", F.col("oldest_queued_seconds") > 900)]
    return counts.withColumn("warnings", F.array_compact(F.array(*[F.when(c, k) for k, c in each])))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n`` of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def reachable_objects(items: DataFrame, revisions: DataFrame, links: DataFrame, resources: DataFrame) -> DataFrame:
    """``kind, key`` of the distinct bodies and images that releases use."""
    used = items.select(F.col("revision_id").alias("id")).distinct()
    bodies = revisions.join(used, "id", "left_semi").select(F.lit("body").alias("kind"), F.col("content_key").cast("string").alias("key"))
    shown = links.join(used.withColumnRenamed("id", "revision_id"), "revision_id", "left_semi").select("content_hash").distinct()
    images = resources.join(shown, "content_hash", "left_semi").select(F.lit("image").alias("kind"), F.col("content_hash").cast("string").alias("key"))
    return bodies.unionByName(images).distinct()


def object_manifest(reachable: DataFrame, objects: DataFrame) -> DataFrame:
    """``kind, key, sha256, size`` of every reachable object (key, content); nulls where one is gone, which a restore must not have."""
    held = objects.select("key", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.octet_length("content").alias("size"))
    return reachable.join(held, "key", "left").select("kind", "key", "sha256", "size")


def verify_objects(manifest_rows: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects of a manifest that a restored store lacks or holds with other bytes."""
    held = objects.select("key", F.sha2(F.col("content").cast("binary"), 256).alias("found"))
    return manifest_rows.join(held, "key", "left").where(~F.col("found").eqNullSafe(F.col("sha256")) | F.col("found").isNull()).select("kind", "key", F.when(F.col("found").isNull(), "missing").otherwise("changed").alias("problem"))


def verify_restore(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables whose counts differ, or that only one side has."""
    both = expected.withColumnRenamed("n", "expected").join(actual.withColumnRenamed("n", "actual"), "table_name", "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def rate_limit(hits: DataFrame, most: int, seconds: int) -> DataFrame:
    """Sliding-window admission: a hit passes if fewer than ``most`` admitted ones lie in the window before it.

    Refused hits don't count, so each decision needs those before it: a fold
    over a key's hits that holds the admitted times still in the window.
    """

    def fold(batches):
        key, recent = None, deque()
        for b in batches:
            admitted = []
            for now, at in zip(b.column("key").to_pylist(), b.column("at").to_pylist()):
                if now != key:
                    key, recent = now, deque()
                while recent and recent[0] <= at - seconds:
                    recent.popleft()
                admitted.append(len(recent) < most)
                if admitted[-1]:
                    recent.append(at)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("hit_id"), pa.array(admitted, pa.bool_())], names=["key", "hit_id", "admitted"])

    # a key's hits come in order; at most ``most`` times are held
    rows = hits.select("key", F.col("at").cast("double").alias("at"), "hit_id").repartition("key").sortWithinPartitions("key", "at", "hit_id")
    return rows.mapInArrow(fold, StructType([hits.schema["key"], hits.schema["hit_id"], StructField("admitted", BooleanType())]))


def percentiles(samples: DataFrame, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Nearest-rank percentiles (``p50``, ``p95``) and maximum of ms by name, exact whatever a name's share of the samples."""
    values = samples.select(F.col("name").alias("g"), F.col("ms").alias("value"))
    sizes = table(values.where("value IS NOT NULL").groupBy("g").agg(F.count("*").alias("n"), F.max("value").alias("max")))
    ranks = [F.floor((F.col("n") * p + 99) / 100).alias(f"p{p}") for p in percents]
    asked = sizes.select("g", F.explode(F.array_distinct(F.array(*ranks))).alias("rank"))
    found = at_ranks(values, asked).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    out = sizes.select("*", *ranks).join(found.withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of")))
    return out.select(F.col("g").alias("name"), *[F.element_at("at", F.col(f"p{p}")).alias(f"p{p}") for p in percents], "max")


def replace_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The edges of the works in ``new`` are replaced by it; those of others stay."""
    return edges.join(new.select("work_id").distinct(), "work_id", "left_anti").unionByName(new)


def invalid_assignments(new: DataFrame, terms: DataFrame, old: DataFrame, column: str, most: int) -> DataFrame:
    """``work_id, problem``: too many, repeated, unknown, or newly inactive terms."""
    t = new.join(terms.select(F.col("id").alias(column), "is_active"), column, "left").join(old.select("work_id", column, F.lit(True).alias("had")).distinct(), ["work_id", column], "left")
    n = t.groupBy("work_id").agg(F.count("*").alias("n"), F.count_distinct(column).alias("d"), F.count_if(F.col("is_active").isNull()).alias("unknown"), F.count_if(~F.col("is_active") & F.col("had").isNull()).alias("inactive"))
    problem = F.when(F.col("n") > most, "too_many").when(F.col("n") > F.col("d"), "repeated").when(F.col("unknown") > 0, "unknown").when(F.col("inactive") > 0, "inactive")
    return n.select("work_id", problem.alias("problem")).where("problem IS NOT NULL")


def suggest(words: DataFrame, categories: DataFrame, tags: DataFrame) -> DataFrame:
    """Keywords with the active category, or else tag, of the same normalised name; the first by sort order."""
    from lectern.functions.scalars import term_key

    def first(terms: DataFrame, name: str) -> DataFrame:
        return terms.where("is_active").groupBy(term_key(F.col("display_name")).alias("k")).agg(F.min_by("id", F.struct("sort_order", "id")).alias(name))

    k = words.withColumn("k", term_key(F.col("word")))
    return k.join(first(categories, "category_id"), "k", "left").join(first(tags, "tag_id"), "k", "left").select("word", "category_id", F.when(F.col("category_id").isNull(), F.col("tag_id")).alias("tag_id"))
