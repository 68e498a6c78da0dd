"""Streams with state against their batch forms, and sinks that write each batch once."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import activity, maintenance
from lectern.streaming import events, state
from lectern.streaming.ledger import Conflict, Ledger

HIT = "key long, ts timestamp, hit_id long"
WRITE = "user_id long, work_id long, seq long, base_version int, position int"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def in_batches(spark, rows, schema, folder, n):
    """A stream of ``n`` micro-batches, in the order of the rows."""
    step = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{folder}/p{k}")
    # a file a batch, the oldest first
    import os
    import pathlib
    import time

    flat = pathlib.Path(folder, "all")
    flat.mkdir()
    for k in range(n):
        for f in pathlib.Path(folder, f"p{k}").glob("*.parquet"):
            to = flat / f"{k:03d}.parquet"
            f.rename(to)
            os.utime(to, (time.time() - 1000 + k, time.time() - 1000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))


def gathered(stream, mode, tmp_path, name):
    """Rows of all micro-batches, and how many there were."""
    out, seen = f"{tmp_path}/{name}", []

    def keep(rows, batch):
        rows.write.mode("append").parquet(out)
        seen.append(batch)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None
    return stream.sparkSession.read.parquet(out), len(seen)


def test_rate_limit_as_a_stream(rocks, tmp_path):
    rng, at = random.Random(1), 1_700_000_000
    rows = []
    for i in range(400):
        at += rng.choice([0, 1, 5, 40])
        rows.append((rng.choice([1, 1, 1, 2, 3, None]), at, i))
    schema = "key long, at long, hit_id long"
    hits = in_batches(rocks, rows, schema, str(tmp_path / "in"), 4).select("key", F.timestamp_seconds("at").alias("ts"), "hit_id")
    got, batches = gathered(state.rate_limit_stream(hits, 3, 60), "append", tmp_path, "hits")
    want = maintenance.rate_limit(rocks.createDataFrame(rows, schema), 3, 60)
    assert batches >= 4 and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert 50 < got.where("admitted").count() < 350


def test_progress_as_a_stream(rocks, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(4), rng.randrange(3), i, rng.randrange(6), rng.randrange(100)) for i in range(300)]
    writes = in_batches(rocks, rows, WRITE, str(tmp_path / "in"), 3)
    got, batches = gathered(state.progress_stream(writes), "update", tmp_path, "progress")
    want = activity.merge_progress(rocks.createDataFrame(rows, WRITE))
    assert batches >= 3 and {tuple(r) for r in state.newest(got).collect()} == {tuple(r) for r in want.collect()}


def test_ledger_writes_a_batch_once(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/table")
    assert ledger.rows("a int").count() == 0
    one, other = spark.createDataFrame([(1,), (2,), (2,)], "a int"), spark.createDataFrame([(1,), (2,)], "a int")
    assert ledger.apply(one, 0) == "applied" and ledger.apply(one.repartition(3), 0) == "replayed"
    with pytest.raises(Conflict):
        ledger.apply(other, 0)
    assert ledger.apply(other, 0, "second") == "applied" and ledger.apply(one.limit(0), 1) == "applied"
    assert sorted((r.a, r.stream, r.batch) for r in ledger.rows().collect()) == [(1, "main", 0), (1, "second", 0), (2, "main", 0), (2, "main", 0), (2, "second", 0)]


@pytest.mark.parametrize("when", ["before", "between", "after"])
def test_a_killed_stream_gives_the_rows_of_one_run(spark, tmp_path, when):
    """Killed in its second batch before the rows are staged, before they take their place, or before the checkpoint knows: sums count once."""
    rng = random.Random(3)
    rows = [(rng.randrange(5), 1_700_000_000 + rng.randrange(200_000), rng.randrange(1, 60)) for _ in range(300)]
    schema = "user_id long, at long, seconds long"
    source = in_batches(spark, rows, schema, str(tmp_path / "in"), 3).select("user_id", F.timestamp_seconds("at").alias("ts"), "seconds")
    ledger, calls = Ledger(spark, f"file://{tmp_path}/table"), []

    class Killed(Ledger):
        def apply(self, part, batch, stream="main"):
            calls.append(batch)
            if len(calls) != 2:
                return super().apply(part, batch, stream)
            if when == "between":
                part.write.parquet(f"{self.path}/_staged/{stream}-{batch}")
            elif when == "after":
                super().apply(part, batch, stream)
            raise RuntimeError("killed")

    parts = lambda b: b.groupBy("user_id", F.to_date("ts").alias("activity_date")).agg(F.sum("seconds").alias("seconds"))
    for kind in (Killed, Killed):
        sink = kind(spark, f"file://{tmp_path}/table")
        query = events.ingest_stream(source, lambda b, i, sink=sink: sink.apply(parts(b), i) and None, f"{tmp_path}/check")
        try:
            query.awaitTermination(120)
        except Exception as e:
            assert "killed" in str(e)
    assert calls == [0, 1, 1, 2]
    got = ledger.rows().groupBy("user_id", "activity_date").agg(F.sum("seconds").alias("n"))
    want = parts(spark.createDataFrame(rows, schema).select("user_id", F.timestamp_seconds("at").alias("ts"), "seconds"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
