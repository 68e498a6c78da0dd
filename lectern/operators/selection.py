"""Exact ranks in groups of any size, by refining histograms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.stored import table

#: Bits of the key that each round tells apart, from the highest on.
BITS = 16


def order_keys(batches):
    """Doubles as longs of the same order; NaN last, both zeros equal."""
    for b in batches:
        bits = (b.column(1).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))], names=["g", "key"])


def key_values(batches):
    for b in batches:
        key = b.column("key").to_numpy(zero_copy_only=False)
        value = np.where(key < 0, key ^ np.int64(0x7FFFFFFFFFFFFFFF), key).view(np.float64)
        yield pa.RecordBatch.from_arrays([b.column("g"), b.column("rank"), pa.array(value)], names=["g", "rank", "value"])


def at_ranks(values: DataFrame, asked: DataFrame) -> DataFrame:
    """``g, rank, value``: the value (double) at each rank from 1 of its group; ``values``: g, value; ``asked``: g, rank, once each.

    Each round counts the values of a group by the next 16 bits of their
    order-preserving key, finds the bucket that holds the rank, and goes on in
    that one: a group is 65,536 counts at most in a task, never its values, and
    the second round on reads only buckets that hold a rank. Null values have no
    rank, ranks beyond a group's size no value; a null group is a group.
    """
    group = values.schema["g"].dataType.simpleString()
    keys = values.where("value IS NOT NULL").select("g", F.col("value").cast("double")).mapInArrow(order_keys, f"g {group}, key long")
    edges = asked.select("g", "rank", F.col("rank").alias("rest"), F.lit(None).cast("long").alias("prefix"))
    upto = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for shift in range(64 - BITS, -1, -BITS):
        if shift < 64 - BITS:
            held = edges.select(F.col("g").alias("of"), "prefix").distinct()
            keys = table(keys.join(held, F.col("g").eqNullSafe(F.col("of")) & (F.shiftright("key", shift + BITS) == F.col("prefix"))).select("g", "key"))
        counts = keys.groupBy("g", F.shiftright("key", shift).alias("bucket")).agg(F.count("*").alias("n"))
        if shift < 64 - BITS:  # sums begin anew in each bucket of the round before
            upto = Window.partitionBy("g", F.shiftright("bucket", BITS)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("n").over(upto)).withColumnRenamed("g", "of")
        inside = F.col("g").eqNullSafe(F.col("of")) & (F.col("rest") <= F.col("upto")) & (F.col("rest") > F.col("upto") - F.col("n"))
        if shift < 64 - BITS:
            inside = inside & (F.shiftright("bucket", BITS) == F.col("prefix"))
        edges = table(edges.join(counts, inside).select("g", "rank", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"), F.col("bucket").alias("prefix")))
    return edges.select("g", "rank", F.col("prefix").alias("key")).mapInArrow(key_values, f"g {group}, rank long, value double")
