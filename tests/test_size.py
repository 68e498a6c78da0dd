"""What a query writes, shuffles and holds grows no faster than its input."""

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions import phrases
from lectern.operators import gram_index, import_flow, ingest, search
from lectern.plans import texts_in
from lectern.sources import text_files


def test_index_lists_bodies_of_a_gram_together(spark, tmp_path):
    """F8, F9: a row a list, not a row for each gram and body; no list is longer than its bound."""
    texts = spark.range(0, 400, 1, 2).select(F.col("id").alias("key"), F.concat(F.lit("the same words in all of them "), F.col("id").cast("string")).alias("body"))
    index = gram_index.GramIndex(spark, f"{tmp_path}/index", 4).add(texts)
    pairs = gram_index.grams_of(texts, "key", "body")
    lists = index.read("postings")
    assert lists.count() < pairs.count() / 5 and lists.agg(F.max(F.size("keys"))).first()[0] <= 1_024
    assert lists.select("gram", F.explode("keys").alias("key")).exceptAll(pairs).count() == 0 == pairs.exceptAll(lists.select("gram", F.explode("keys").alias("key"))).count()
    assert {r.gram: r.n for r in index.read("counts").collect()}["the"] == 400


def test_indexes_of_bodies_come_a_few_at_a_time():
    """a task holds the indexes of AT_A_TIME bodies, not of a batch of ten thousand."""
    pieces = list(search.body_index.func(iter([pa.array([*["some text"] * 199, None])])))
    assert [len(p) for p in pieces] == [64, 64, 64, 8] and len(pieces[0][0].as_py()) == search.BLOOM_BITS // 8 + 8


def test_texts_are_converted_a_few_at_a_time():
    """as strings, AT_A_TIME texts are held, not a batch."""
    pieces = list(phrases.converter("simplified").func(iter([pa.array([*["頭髮"] * 99, None]), pa.array([], pa.string())])))
    assert [len(p) for p in pieces] == [64, 36] and pieces[0][0].as_py() == "头发" and pieces[1][-1].as_py() is None


def test_a_chapter_takes_its_head_from_its_own_row(spark):
    """no join of the rows with themselves, which for two jobs of one work gave every chapter four times."""
    jobs = spark.createDataFrame([("a", 1, "ready"), ("b", 1, "ready")], "job_id string, work_id int, status string")
    items = spark.createDataFrame([(j, p, "L", "T", "k", f"{j}{p}") for j in "ab" for p in (1, 2)], "job_id string, position int, label_raw string, title string, content_key string, body_hash string")
    new, revisions, _ = import_flow.first_commit(jobs, items, spark.createDataFrame([], "work_id int"), "v")
    heads = [r.head_revision_id for r in new.collect()]
    assert len(heads) == 4 and sorted(heads) == sorted(r.id for r in revisions.collect())


def test_the_matcher_has_tasks_as_many_as_its_rows_demand(spark, monkeypatch):
    """what a task sorts doesn't grow with the tables."""
    monkeypatch.setattr(ingest, "ROWS_A_TASK", 100)
    existing = spark.range(600).selectExpr("id % 50 AS work_id", "id", "'k' || id AS label_key", "CAST(id AS INT) AS position", "'b' AS body_hash", "'' AS resource_digest")
    matched = ingest.match(existing, existing.withColumnRenamed("id", "item_id"))
    assert matched.rdd.getNumPartitions() == 12 and matched.where("class = 'unchanged'").count() == 600


def test_books_are_cut_in_tasks_as_many_as_their_lines_demand(spark, monkeypatch):
    """F16: what a task sorts doesn't grow with the books, which are dealt out once and joined with nothing."""
    monkeypatch.setattr(text_files, "LINES_A_TASK", 100)
    books = spark.range(50).selectExpr("CAST(id AS STRING) AS path", "'（一）甲\na\n（二）\n' || repeat('b。\n', 20) || '（一）' AS text")
    found = text_files.chapters(books)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() == 13 and plan.count("Exchange") == 1 and "Join" not in plan
    assert {(r.position, r.label_raw, r.title, r.n) for r in found.groupBy("position", "label_raw", "title").agg(F.count("*").alias("n")).collect()} == {(0, "（一）", "甲", 50), (1, "（二）", "", 50)}
    assert text_files.chapters(books.limit(0)).count() == 0


def test_chapters_are_numbered_in_tasks_as_many_as_they_demand(spark, monkeypatch, tmp_path):
    """F16: so are the chapters that the books are made of, before they are put together."""
    monkeypatch.setattr(texts_in, "CHAPTERS_A_TASK", 100)
    orders = spark.range(950).selectExpr("id AS o_orderkey", "id % 50 AS o_custkey", "'F' AS o_orderstatus", "'1-URGENT' AS o_orderpriority", "timestamp_seconds(id) AS o_orderdate")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines = texts_in.book_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == 10 and texts_in.headings(spark, str(tmp_path)).where("position < 19 AND body LIKE 'Text of%F ends.'").count() == 950
