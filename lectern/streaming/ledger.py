"""Exactly-once sinks: a ledger of batches, written with their rows.

A batch's rows and its entry (stream, batch, digest of the rows) are written to a
folder of their own beside the table, which takes its place in the table in one
rename. A batch that is there already changes nothing if its rows are the same, and
is refused if they aren't. What is left of a run that was killed is no part of the
table, and goes when its batch is written again. The rename has to be atomic, as on
HDFS and on shared disks.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.stored import table

ENTRY = "_entry.json"


class Conflict(ValueError):
    """Another payload under a key that the ledger holds."""


def digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and an order-free digest of them: 128 bits from sums of two hashes in 32-bit lanes."""
    lanes = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *rows.columns)
        lanes += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))]
    n, *sums = rows.agg(F.count("*"), *[F.coalesce(x, F.lit(0)) for x in lanes]).first()
    return n, "-".join(f"{x:x}" for x in sums)


class Ledger:
    """A table of batches in the folder ``path``; several streams may share it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, stream: str, batch: int) -> str:
        return f"{self.path}/stream={stream}/batch={batch}"

    def entry(self, stream: str, batch: int) -> dict | None:
        at = self._path(f"{self._place(stream, batch)}/{ENTRY}")
        if not self.fs.exists(at):
            return None
        data = self.fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8"))
        finally:
            data.close()

    def apply(self, rows: DataFrame, batch: int, stream: str = "main") -> str:
        """Write a batch: 'applied', or 'replayed' if it is there; :class:`Conflict` if it is there with other rows."""
        rows = table(rows)
        n, hashed = digest(rows)
        known = self.entry(stream, batch)
        if known is not None:
            if (known["rows"], known["digest"]) != (n, hashed):
                raise Conflict(f"batch {batch} of {stream} is in the ledger with other rows")
            return "replayed"
        staged = f"{self.path}/_staged/{stream}-{batch}"
        rows.write.mode("overwrite").parquet(staged)
        out = self.fs.create(self._path(f"{staged}/{ENTRY}"), True)
        out.write(bytearray(json.dumps({"stream": stream, "batch": batch, "rows": n, "digest": hashed}).encode()))
        out.close()
        self.fs.mkdirs(self._path(f"{self.path}/stream={stream}"))
        if not self.fs.rename(self._path(staged), self._path(self._place(stream, batch))):
            raise OSError(f"batch {batch} of {stream} could not take its place")
        return "applied"

    def rows(self, schema: str | None = None) -> DataFrame:
        """All rows with their stream and batch; before the first batch an empty table of ``schema``."""
        if not self.fs.exists(self._path(self.path)) or self.fs.globStatus(self._path(f"{self.path}/stream=*/batch=*")).__len__() == 0:
            return self.spark.createDataFrame([], f"{schema}, stream string, batch long")
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/stream=*")

    def sink(self, df: DataFrame, checkpoint: str, stream: str = "main", mode: str = "update", **trigger):
        """A running query that writes each batch of ``df`` once, whatever is killed and begun again."""
        writer = df.writeStream.foreachBatch(lambda rows, batch: self.apply(rows, batch, stream) and None)
        return writer.option("checkpointLocation", checkpoint).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()
