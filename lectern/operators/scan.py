"""Running sums over groups of any size: one group may hold most of the rows and still spread over tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.stored import table


def running(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, str], within: list[str] | None = None) -> DataFrame:
    """``rows`` with, for each ``new: value`` of ``sums``, the sum of ``value`` from the first row of the group to this one.

    A segmented prefix scan. Rows are dealt out by ranges of (key, order), so
    that a large group becomes several stretches; sums run within a stretch, and
    what the stretches of the same group before it add up to is carried in. Only
    a group that goes on from the range before it needs a carry, so there are no
    more carries than ranges.

    Groups and orders take nulls first. Rows equal in key and order are one
    stretch, in no given order: give a tie-break where that matters, or columns
    that they are sorted by ``within`` it, for what is too long to deal by.
    ``key`` may be empty: all rows are one group. An empty table gives an empty one.
    """
    dealt = table(rows.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy("_part", *key).orderBy(*order, *(within or [])).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = dealt.groupBy("_part", *key).agg(*[F.sum(v).alias(f"_{n}") for n, v in sums.items()])
    carries = stretches.withColumns({"_at": F.row_number().over(Window.partitionBy(*key).orderBy("_part")), **{f"_{n}": F.sum(f"_{n}").over(before) for n in sums}}).where("_at > 1")
    carries = carries.select("_part", *[F.col(c).alias(f"_key_{c}") for c in key], *[f"_{n}" for n in sums])
    local = dealt.withColumns({n: F.sum(v).over(upto) for n, v in sums.items()})
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_key_{c}")), key, local["_part"] == carries["_part"])
    out = local.join(F.broadcast(carries), same, "left")
    kept = [c for c in rows.columns if c not in sums]
    return out.select(*[local[c] for c in kept], *[(F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in sums])
