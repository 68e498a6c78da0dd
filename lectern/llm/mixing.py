"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket; the bucket in which a source's
budget ends is refined, and it alone; the thresholds found are applied with a
filter. Rows are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import table
from lectern.operators.scan import running

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Hex digits of the hash that each refinement looks at.
LEVELS = (2, 5, 8, 32)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``; one small row per source.

    Sources in code-point order, null last, take the weights in turn. A target
    is the weight's share of all sizes, at most ``repeats`` times the source's
    size; what is over goes to the rest by weight until nothing is. That fixed
    point fills sources in the order of size over weight, so prefix sums give it.
    """
    nth = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * repeats
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(nth) - 1) % len(weights) + 1).cast("long"))
        .withColumn("cap", cap)
        .withColumn("left_size", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # the first source in this order that its share doesn't fill ends the filling
        .withColumn("full", F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left_size"))
        .withColumn("open_size", F.first(F.when(~F.col("full"), F.col("left_size")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("open_weight", F.first(F.when(~F.col("full"), F.col("left_weight")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    share = (F.col("weight") * F.col("open_size")).cast("double") / F.col("open_weight").cast("double")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)
    return filled.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, edge, below, rest, tied``: the hash at which a source's running sum reaches the rest of its budget.

    ``sized``: source, size, h (32 hex digits). ``rest`` is the budget after whole
    passes, ``below`` the sum before the edge, ``tied`` the rows that have its hash.
    """
    size, target = F.col("source_size"), F.col("target")
    passes = F.when(size == 0, 0).otherwise(F.floor(target / size)).cast("long")
    edge = budgets.select("source", (target - passes * size).alias("rest"), F.lit(0).cast("long").alias("below"), F.lit("").alias("prefix"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for digits in LEVELS:
        bounds = edge.withColumnRenamed("source", "of")
        inside = sized.join(bounds, F.col("of").eqNullSafe(F.col("source")) & F.col("h").startswith(F.col("prefix"))).drop("of")
        if digits == LEVELS[1]:  # from here on only the edges' first buckets are read
            sized = table(inside.select("source", "size", "h"))
            inside = sized.join(bounds, F.col("of").eqNullSafe(F.col("source"))).drop("of")
        histogram = inside.groupBy("source", "rest", "below", F.substring("h", 1, digits).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("tied"))
        summed = histogram.withColumn("upto", F.col("below") + F.sum("size").over(upto))
        # the first bucket whose sum reaches the rest
        found = summed.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest")))
        edge = found.groupBy("source", "rest").agg(F.min(F.struct(F.col("bucket").alias("prefix"), (F.col("upto") - F.col("size")).alias("below"), "tied")).alias("e"))
        edge = table(edge.select("source", "rest", "e.*"))
    return edge.withColumnRenamed("prefix", "edge")


def order_key(ident: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(ident.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def planned(sized: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """``s, source_size, target, edge, below, rest, tied``: a small row a source; ``s`` is the source."""
    budgets = table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats))
    edges = thresholds(sized.select("source", "h", "size"), budgets)
    return table(budgets.withColumnRenamed("source", "s").join(edges, F.col("s").eqNullSafe(F.col("source")), "left").drop("source"))


def times_taken(nth: Column) -> Column:
    """How often the mix takes a row that has size, h and its source's plan; at the edge the row is the ``nth`` of its hash."""
    passes = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size")))
    nearer = F.col("below") + nth * F.col("size") - F.col("rest") <= F.col("rest") - (F.col("below") + (nth - 1) * F.col("size"))
    extra = F.when(F.col("h") < F.col("edge"), 1).when((F.col("h") == F.col("edge")) & nearer, 1).otherwise(0)
    return (passes + extra).cast("long")


def with_times(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, h, size) with their source's plan and ``times``, how often the mix takes each.

    Equal rows have one hash. Where an edge falls among them, they are numbered:
    which of them is taken makes no difference, how many does.
    """
    out = rows.join(plan, F.col("s").eqNullSafe(F.col("source")), "left")
    one = F.lit(1).cast("long")
    # a row a source
    if plan.where("tied > 1").isEmpty():
        return out.withColumn("times", times_taken(one))
    among = F.coalesce((F.col("h") == F.col("edge")) & (F.col("tied") > 1), F.lit(False))
    tied = table(out.where(among).withColumns({"nr": F.monotonically_increasing_id(), "one": one}))
    tied = running(tied, ["source"], ["nr"], {"nth": "one"}).withColumn("times", times_taken(F.col("nth"))).drop("nr", "one", "nth")
    return out.where(~among).withColumn("times", times_taken(one)).unionByName(tied)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row ``doc_id, source, h, size, source_size, target, taken`` per row of ``docs``.

    ``taken`` is the words the mix takes from the document: its size times the
    passes it is in. Sizes count words (null text: 0). The order of a source is
    the md5 of id and text, so reruns agree; of rows equal in both as many are
    taken as come nearest to the target. A source without words has target 0.
    Null ids and null sources are values like others; an empty table gives an
    empty one.
    """
    sized = table(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), order_key(F.col(id_col), F.col(text_col)).alias("h"), n_words(F.col(text_col)).alias("size")))
    out = with_times(sized, planned(sized, weights, repeats))
    return out.select("doc_id", "source", "h", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``src, repeats``: the rows of ``docs`` that :func:`mix` takes, and how often; ``src`` holds their columns."""
    rows = docs.select(F.struct("*").alias("src"), F.col(source_col).cast("string").alias("source"), order_key(F.col(id_col), F.col(text_col)).alias("h"), n_words(F.col(text_col)).alias("size"))
    plan = planned(table(rows.select("source", "h", "size")), weights, repeats)
    return with_times(rows.where("size > 0"), plan).select("src", F.col("times").alias("repeats")).where("repeats > 0")


def op1_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))) AS h
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
  FROM sized GROUP BY source
), filling AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::BIGINT AS left_size,
         (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS left_weight
  FROM sums
  WINDOW o AS (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, cap * left_weight <= weight * left_size AS is_full FROM filling
), open AS (
  SELECT arg_min(left_size, cap / weight::DOUBLE) AS open_size, arg_min(left_weight, cap / weight::DOUBLE) AS open_weight
  FROM marked WHERE NOT is_full
), targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap::DOUBLE ELSE (weight * open_size)::DOUBLE / open_weight::DOUBLE END AS target
  FROM marked LEFT JOIN open ON true
), planned AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size)::BIGINT END AS passes,
         sum(size) OVER (PARTITION BY s.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN upto < target - passes * source_size THEN 1
                              WHEN upto - size < target - passes * source_size
                               AND upto - (target - passes * source_size) <= (target - passes * source_size) - (upto - size) THEN 1
                              ELSE 0 END))::BIGINT AS taken
FROM planned
"""
