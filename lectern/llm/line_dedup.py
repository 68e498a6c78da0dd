"""Line deduplication over a whole corpus, in DataFrame operations only.

Lines are exploded, keyed and hashed; distinct documents are counted per hash;
lines over the threshold go and the rest is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import ascii_lower, table

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """ASCII blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``src, n_lines, n_dropped, kept`` per row of ``docs``; ``src`` holds its columns, whatever their names.

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    documents loses its lines everywhere but in the largest id that holds it.
    A null or empty text is one empty line. A null id is an id of its own,
    below all others; rows that repeat an id are one document for the counts,
    and each gets its own result. Texts are whole, whatever their length. An
    empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a text travels once, within src
    rows = docs.select(F.struct("*").alias("src"), F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"))
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    keyed = lines.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    # two seeds make a 128-bit hash: no two keys of a corpus meet by chance
    keyed = table(keyed.select("id", "mark", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")))
    # dealt out by line and document, then a row a line and task: a line of very many documents is no load of one task
    once = keyed.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    common = table(once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max(F.struct("id")).alias("last")).where(F.col("n") >= min_docs).select("h1", "h2", F.col("last.id").alias("last")))
    # two tables meet in plain exchanges: adaptive execution splits a line of very many documents, or broadcasts the common lines if they are few
    gone = (
        keyed.join(common, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy("id", "mark")
        .agg(F.collect_set("at").alias("gone"))
        .select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark"), "gone")
    )
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left")
    out = out.withColumn("text", F.coalesce(F.col("src").getField(text_col), F.lit("")))
    split = F.split("text", "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return (
        out.withColumn("lines", split)
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("n_dropped", F.coalesce(F.array_size("gone"), F.lit(0)).cast("long"))
        .withColumn("kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(rest, lambda i: F.get("lines", i)), "\n")))
        .select("src", "n_lines", "n_dropped", "kept")
    )


def op10_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select(F.col("src.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       unnest(ls) WITH ORDINALITY AS u(line, pos)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.pos, (c.key IS NOT NULL AND k.doc_id <> c.last) AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
