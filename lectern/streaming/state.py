"""The rules whose decisions need those before them, as streams with keyed state.

The batch forms are ``maintenance.rate_limit`` and ``activity.merge_progress``. A
key's rows of one micro-batch are taken in their order; state goes on from batch to
batch, and keys that have gone quiet are dropped by timers as the watermark passes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed lists and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission(StatefulProcessor):
    """Sliding-window admission: state is a list of the admitted times still in the window, ``most`` at most."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        recent = [t[0] for t in self.times.get()] if self.times.exists() else []
        for r in sorted(rows, key=lambda r: (r.at, r.hit_id)):
            recent = [t for t in recent if t > r.at - self.seconds]
            admitted = len(recent) < self.most
            if admitted:
                recent.append(r.at)
            yield Row(key=key[0], hit_id=r.hit_id, admitted=admitted)
        self.times.put([(t,) for t in recent])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        # when the last admitted time leaves the window, there is nothing to remember
        self.handle.registerTimer(int((recent[-1] + self.seconds) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


class Progress(StatefulProcessor):
    """Optimistic writes: state is version, position and conflicts so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", "version int, position int, conflicts int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, position, conflicts = self.state.get() if self.state.exists() else (0, None, 0)
        for r in sorted(rows, key=lambda r: r.seq):
            if r.base_version == version:
                version, position = version + 1, r.position
            else:
                conflicts += 1
        self.state.update((version, position, conflicts))
        yield Row(user_id=key[0], work_id=key[1], version=version, position=position, conflicts=conflicts)

    def close(self) -> None:
        pass


def rate_limit_stream(hits: DataFrame, most: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """``key, hit_id, admitted`` per hit; ``hits``: key, ts, hit_id. Append mode.

    A hit later than the watermark is dropped by Spark, as any late row; others
    are judged with those of their key that came before. Null keys are a key.
    """
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema.fields}
    rows = hits.withWatermark("ts", late).select("key", "ts", F.col("ts").cast("double").alias("at"), "hit_id")
    out = f"key {kinds['key']}, hit_id {kinds['hit_id']}, admitted boolean"
    return rows.groupBy("key").transformWithState(Admission(most, seconds), out, "append", "EventTime")


def progress_stream(writes: DataFrame) -> DataFrame:
    """``user_id, work_id, version, position, conflicts`` of the keys that a batch changes; update mode. ``writes`` as for the batch form."""
    kinds = {f.name: f.dataType.simpleString() for f in writes.schema.fields}
    out = f"user_id {kinds['user_id']}, work_id {kinds['work_id']}, version int, position int, conflicts int"
    return writes.groupBy("user_id", "work_id").transformWithState(Progress(), out, "update", "None")


def newest(updates: DataFrame) -> DataFrame:
    """Each key's last row of a progress stream's updates: version and conflicts only grow."""
    last = F.max_by(F.struct("version", "position", "conflicts"), F.col("version") + F.col("conflicts")).alias("s")
    return updates.groupBy("user_id", "work_id").agg(last).select("user_id", "work_id", "s.*")
