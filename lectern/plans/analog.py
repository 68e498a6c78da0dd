"""A catalog built from the star-schema tables, for queries that both engines can answer.

The statements run unchanged in Spark and in DuckDB: customers are works,
nations categories, order priorities tags, orders chapters, events clicks and
reading, documents bodies.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.tables import load

RAW = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

VIEWS = {
    "works": """SELECT c_custkey AS id, c_name AS title, n_name AS author, c_mktsegment AS work_type,
  CASE c_custkey % 4 WHEN 0 THEN 'ongoing' WHEN 1 THEN 'completed' WHEN 2 THEN 'paused' END AS serial_status,
  CASE WHEN c_custkey % 20 = 0 THEN 'draft' WHEN c_custkey % 33 = 0 THEN 'unlisted' WHEN c_custkey % 41 = 0 THEN 'removed' ELSE 'public' END AS visibility,
  CASE WHEN c_custkey % 7 <> 3 THEN c_custkey END AS active_release_id,
  DATE '2024-01-01' + CAST(c_custkey * 7919 % 700 AS INT) AS published_at,
  CAST(1 + c_custkey % 5 AS INT) AS edit_version
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "categories": "SELECT n_nationkey AS id, n_name AS display_name, n_nationkey % 5 <> 0 AS is_active, n_nationkey AS sort_order FROM nation",
    "work_categories": "SELECT c_custkey AS work_id, c_nationkey AS category_id FROM customer UNION SELECT c_custkey, CAST(c_custkey % 25 AS INT) FROM customer",
    "tags": "SELECT DISTINCT o_orderpriority AS id, o_orderpriority AS display_name, o_orderpriority <> '4-NOT SPECIFIED' AS is_active FROM orders",
    "work_tags": "SELECT DISTINCT o_custkey AS work_id, o_orderpriority AS tag_id FROM orders",
    "library": """SELECT user_id, event_id % 1500 AS work_id, min(ts) AS created_at, max(ts) AS updated_at,
  max(CASE WHEN event_id % 3 = 0 THEN 'finished' WHEN event_id % 3 = 1 THEN 'reading' ELSE 'paused' END) AS reading_status,
  max(CASE WHEN event_id % 4 = 0 THEN 'g' || CAST(event_id % 6 AS VARCHAR(3)) END) AS group_name
FROM events GROUP BY user_id, event_id % 1500""",
    "clicks": "SELECT event_id % 300 AS work_id, user_id AS visitor, ts FROM events WHERE event_type <> 'purchase'",
    "reads": "SELECT user_id, event_id % 3000 AS chapter_id, event_id % 300 AS work_id, min(ts) AS first_read_at, max(ts) AS last_read_at FROM events GROUP BY user_id, event_id % 3000, event_id % 300",
    "heartbeats": "SELECT user_id, ts, CAST(floor(value) AS BIGINT) % 60 + 1 AS seconds FROM events",
    "chapters": """SELECT o_orderkey AS id, o_custkey AS work_id, o_orderpriority AS volume, o_orderstatus AS status,
  'Ch ' || CAST(o_orderkey % 1000 AS VARCHAR(5)) AS label_raw,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS position
FROM orders""",
    "release_now": "SELECT o_custkey AS work_id, o_orderkey AS chapter_id, o_orderkey % 13 AS revision_id, CAST(o_orderkey % 17 AS INT) AS position FROM orders WHERE o_orderkey % 5 <> 0",
    "release_before": "SELECT o_custkey AS work_id, o_orderkey AS chapter_id, CASE WHEN o_orderkey % 11 = 0 THEN 99 ELSE o_orderkey % 13 END AS revision_id, CAST(CASE WHEN o_orderkey % 19 = 0 THEN 50 ELSE o_orderkey % 17 END AS INT) AS position FROM orders WHERE o_orderkey % 7 <> 0",
    "events_of_release": "SELECT o_custkey AS work_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS release_version, o_orderkey % 4 AS n_new FROM orders",
    "follows": "SELECT user_id, event_id % 1500 AS work_id, CAST(max(event_id % 9) AS INT) AS last_seen FROM events GROUP BY user_id, event_id % 1500",
}


#: Where views of a folder were written, by folder and name.
WRITTEN: dict[tuple[str, str], str] = {}


def write_once(spark: SparkSession, folder: str, names: list[str], to: str) -> None:
    """Write views as Parquet to ``to``, from where :func:`frame` reads them afterwards."""
    for name in names:
        frame(spark, folder, name).write.parquet(f"{to}/{name}")
        WRITTEN[folder, name] = f"{to}/{name}"


def frame(spark: SparkSession, folder: str, name: str, **given: DataFrame) -> DataFrame:
    """The view as a DataFrame; tables that are ``given`` stand for the folder's."""
    if name in given:
        return given[name]
    if (folder, name) in WRITTEN:
        return spark.read.parquet(WRITTEN[folder, name])
    if name in RAW:
        return load(spark, folder, name)
    text = VIEWS[name]
    used = [t for t in [*RAW, *VIEWS] if re.search(rf"(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: frame(spark, folder, t, **given) for t in used})


def over(sql: str) -> str:
    """``sql`` with the views it uses before it, for DuckDB."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if v not in need and re.search(rf"\b(FROM|JOIN|,)\s+{v}\b", text):
                add(VIEWS[v])
                need.append(v)

    add(sql)
    if not need:
        return sql
    own = ", ".join(f"{v} AS ({VIEWS[v]})" for v in need)
    body = sql.strip()
    return f"WITH {own}, {body[4:]}" if body[:5].upper() == "WITH " else f"WITH {own} {body}"
