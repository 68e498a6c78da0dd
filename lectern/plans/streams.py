"""Rules with state over the events, in batch and as streams of several runs, and sinks that write each batch once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators import activity as A
from lectern.operators import maintenance as M
from lectern.plans.analog import frame
from lectern.plans.registry import query
from lectern.stored import shared_folder
from lectern.streaming import state
from lectern.streaming.ledger import Ledger

RUNS = 3

# each row is decided by its key's state after the row before
RATE = """WITH RECURSIVE hits AS (SELECT user_id AS key, event_id AS hit_id, floor(epoch(ts))::BIGINT AS sec, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS nr FROM events),
run AS (
  SELECT key, nr, hit_id, true AS admitted, [sec] AS recent FROM hits WHERE nr = 1
  UNION ALL
  SELECT h.key, h.nr, h.hit_id, len(list_filter(r.recent, lambda t: t > h.sec - 86400)) < 3,
         CASE WHEN len(list_filter(r.recent, lambda t: t > h.sec - 86400)) < 3 THEN list_append(list_filter(r.recent, lambda t: t > h.sec - 86400), h.sec) ELSE list_filter(r.recent, lambda t: t > h.sec - 86400) END
  FROM run r JOIN hits h ON h.key = r.key AND h.nr = r.nr + 1
)
SELECT key, hit_id, admitted FROM run"""
PROGRESS = """WITH RECURSIVE writes AS (SELECT user_id, event_id % 5 AS work_id, (event_id % 7)::INT AS base, (event_id % 100)::INT AS place, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) AS nr FROM events),
run AS (
  SELECT user_id, work_id, nr, CASE WHEN base = 0 THEN 1 ELSE 0 END AS version, CASE WHEN base = 0 THEN place END AS position, CASE WHEN base = 0 THEN 0 ELSE 1 END AS conflicts FROM writes WHERE nr = 1
  UNION ALL
  SELECT w.user_id, w.work_id, w.nr, CASE WHEN w.base = r.version THEN r.version + 1 ELSE r.version END, CASE WHEN w.base = r.version THEN w.place ELSE r.position END, CASE WHEN w.base = r.version THEN r.conflicts ELSE r.conflicts + 1 END
  FROM run r JOIN writes w ON w.user_id = r.user_id AND w.work_id = r.work_id AND w.nr = r.nr + 1
)
SELECT user_id, work_id, version, position, conflicts FROM run QUALIFY row_number() OVER (PARTITION BY user_id, work_id ORDER BY nr DESC) = 1"""


def writes(events):
    e = F.col("event_id")
    return events.select("user_id", (e % 5).alias("work_id"), e.alias("seq"), (e % 7).cast("int").alias("base_version"), (e % 100).cast("int").alias("position"))


@query("optimistic_progress", PROGRESS)
def optimistic_progress(spark, d):
    return A.merge_progress(writes(frame(spark, d, "events")))


@query("rate_limited", RATE)
def rate_limited(spark, d):
    hits = frame(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("hit_id"))
    return M.rate_limit(hits, 3, 86_400)


def in_runs(spark, rows, order, made, mode):
    """What the stream that ``made`` makes of ``rows`` gives, as the ranges of ``order`` arrive: a run each, which goes on from the checkpoint of the last."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STORE)
    home = f"{shared_folder(spark)}/lectern/stream-{uuid.uuid4().hex}"
    # two values
    edges = rows.agg(F.percentile_approx(order, [k / RUNS for k in range(1, RUNS)], 1000)).first()[0] or []
    ledger = Ledger(spark, f"{home}/out")
    for a, b in zip([None, *edges], [*edges, None]):
        part = rows if a is None else rows.where(F.col(order) > F.lit(a))
        part = part if b is None else part.where(F.col(order) <= F.lit(b))
        part.write.mode("append").parquet(f"{home}/in")
        stream = made(spark.readStream.schema(rows.schema).parquet(f"{home}/in"))
        ledger.sink(stream, f"{home}/check", mode=mode).awaitTermination()
    return ledger.rows(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields))


@query("rate_limited_stream", RATE)
def rate_limited_stream(spark, d):
    """The same decisions with keyed state, the events arriving in three runs."""
    hits = frame(spark, d, "events").select(F.col("user_id").alias("key"), F.date_trunc("second", "ts").alias("ts"), F.col("event_id").alias("hit_id"))
    return in_runs(spark, hits, "ts", lambda s: state.rate_limit_stream(s, 3, 86_400), "append").select("key", "hit_id", "admitted")


@query("progress_stream", PROGRESS)
def progress_stream(spark, d):
    """The same versions with keyed state, the events arriving in three runs."""
    return state.newest(in_runs(spark, writes(frame(spark, d, "events")), "seq", state.progress_stream, "update"))


@query("activity_ledger", "SELECT user_id, ts::DATE AS activity_date, least(86400, sum(floor(value)::BIGINT % 60 + 1))::BIGINT AS active_seconds FROM events GROUP BY ALL")
def activity_ledger(spark, d):
    """Seconds a day from batches that a ledger holds, one of them delivered twice."""
    beats = frame(spark, d, "heartbeats")
    ledger = Ledger(spark, f"{shared_folder(spark)}/lectern/ledger-{uuid.uuid4().hex}")
    daily = lambda rows: rows.groupBy("user_id", F.to_date("ts").alias("activity_date")).agg(F.sum("seconds").alias("seconds"))
    for batch in (0, 1, 0, 2, 1):
        ledger.apply(daily(beats.where(F.pmod(F.xxhash64("user_id", "ts"), F.lit(3)) == batch)), batch)
    total = ledger.rows().groupBy("user_id", "activity_date").agg(F.sum("seconds").alias("s"))
    return total.select("user_id", "activity_date", F.least(F.lit(A.DAY_SECONDS).cast("long"), "s").alias("active_seconds"))


@query("reads_ledger", "SELECT user_id, event_id % 3000 AS chapter_id, min(ts) AS first_read_at, max(ts) AS last_read_at FROM events GROUP BY user_id, event_id % 3000")
def reads_ledger(spark, d):
    """First and last reads as a stream in three runs, each batch once in the ledger."""
    reads = frame(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 3000).alias("chapter_id"), "ts")
    rows = in_runs(spark, reads, "event_id", lambda s: s.select("user_id", "chapter_id", "ts"), "append")
    return A.read_marks(rows)
