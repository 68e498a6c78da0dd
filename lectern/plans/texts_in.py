"""What imports make of files: encodings, labels, headings, front matter, markers, tidying, script conversion."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import labels as L
from lectern.functions import scalars as S
from lectern.functions.encoding import decode_files
from lectern.functions.phrases import converter
from lectern.plans.analog import VIEWS, frame, over
from lectern.plans.registry import query
from lectern.sources import objects, text_files


@query("decoded_texts", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-16-le' WHEN 1 THEN 'utf-16-be' ELSE 'utf-8' END AS encoding, sha256(coalesce(text, '')) AS body FROM documents")
def decoded_texts(spark, d):
    """Texts in four encodings, with and without a mark, told apart and read back."""
    docs = frame(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id") % 4
    marked = lambda mark, name: F.concat(F.unhex(F.lit(mark)), F.encode("text", name))
    raw = F.when(k == 0, marked("FFFE", "UTF-16LE")).when(k == 1, marked("FEFF", "UTF-16BE")).when(k == 2, marked("EFBBBF", "UTF-8")).otherwise(F.encode("text", "UTF-8"))
    out = decode_files(docs.select(F.col("doc_id").cast("string").alias("path"), raw.alias("content")))
    return out.select(F.col("path").cast("long").alias("doc_id"), "encoding", F.sha2("text", 256).alias("body"))


# Labels of every form from known numbers: digits, numerals with units, brackets, extras, parts.
NUMERAL = "CASE WHEN n = 10 THEN '十' WHEN n < 10 THEN substr('一二三四五六七八九', CAST(n AS INT), 1) WHEN n < 20 THEN '十' || substr('一二三四五六七八九', CAST(n - 10 AS INT), 1) WHEN n % 10 = 0 THEN substr('一二三四五六七八九', CAST(floor(n / 10) AS INT), 1) || '十' ELSE substr('一二三四五六七八九', CAST(floor(n / 10) AS INT), 1) || '十' || substr('一二三四五六七八九', CAST(n % 10 AS INT), 1) END"
VIEWS["numbers"] = "SELECT o_orderkey AS id, o_custkey AS book, o_orderkey % 7 AS form, 1 + o_orderkey % 99 AS n, o_orderkey % 3 AS sub FROM orders"
VIEWS["labels_raw"] = f"""SELECT id, book, form, n, sub, CASE form WHEN 0 THEN '第' || CAST(n AS VARCHAR(3)) || '章' WHEN 1 THEN '第' || {NUMERAL} || '回' WHEN 2 THEN '（' || CAST(n AS VARCHAR(3)) || '）' WHEN 3 THEN '番外' || {NUMERAL} WHEN 4 THEN CAST(n AS VARCHAR(3)) || '.0' || CAST(sub AS VARCHAR(3))
  WHEN 5 THEN '第' || CAST(n AS VARCHAR(3)) || '章（' || substr('上中下', CAST(sub + 1 AS INT), 1) || '）' ELSE CASE sub WHEN 0 THEN '楔子' WHEN 1 THEN '後記' ELSE 'no number' END END AS raw FROM numbers"""
KEYED = """CASE form WHEN 3 THEN 'extra:' || n WHEN 4 THEN 'ch:' || n || '.' || sub WHEN 5 THEN 'ch:' || n || '#' || substring('上中下', (sub + 1)::INT, 1) WHEN 6 THEN NULL ELSE 'ch:' || n END"""


@query("label_keys", over(f"SELECT id, CASE WHEN form = 3 THEN 'extra' WHEN form < 6 THEN 'numbered' WHEN sub = 0 THEN 'front' WHEN sub = 1 THEN 'end' ELSE 'unnumbered' END AS kind, {KEYED} AS key FROM labels_raw"))
def label_keys(spark, d):
    label = L.parse_label(F.col("raw"))
    return frame(spark, d, "labels_raw").withColumn("label", label).select("id", "label.kind", "label.key")


@query("label_order", over("SELECT id, row_number() OVER (PARTITION BY book ORDER BY CASE WHEN form < 6 THEN 1 WHEN sub = 0 THEN 0 WHEN sub = 1 THEN 2 ELSE 3 END, CASE WHEN form < 6 THEN n END, CASE WHEN form = 4 THEN sub ELSE -1 END, CASE WHEN form = 5 THEN ascii(substring('上中下', (sub + 1)::INT, 1)) ELSE 0 END, id)::INT AS nth FROM labels_raw"))
def label_order(spark, d):
    """Labels of a book in their order: front matter, numbers part by part, endings, the rest."""
    rows = frame(spark, d, "labels_raw").withColumn("at", L.order_key(L.parse_label(F.col("raw"))))
    return rows.select("id", F.row_number().over(Window.partitionBy("book").orderBy("at", "id")).alias("nth"))


@query("same_numbers", over(f"SELECT a.id AS id, b.id AS other FROM (SELECT *, {KEYED} AS key FROM labels_raw) a JOIN (SELECT *, {KEYED} AS key FROM labels_raw) b ON a.book = b.book AND a.key = b.key AND a.id < b.id"))
def same_numbers(spark, d):
    """Labels of a book that are candidates for one number, however it is written."""
    rows = frame(spark, d, "labels_raw").select("id", "book", L.parse_label(F.col("raw"))["key"].alias("key"))
    # both sides are one shuffle; a table that its file's size makes small is as large as any here, and isn't broadcast
    return rows.alias("a").join(rows.alias("b").hint("merge"), ["book", "key"]).where("a.id < b.id").select("a.id", F.col("b.id").alias("other"))


# A work's chapters as one plain-text book.
VIEWS["book_lines"] = "SELECT work_id, position, '第' || CAST(position AS VARCHAR(5)) || '章 ' || volume AS head, 'Text of ' || label_raw || '.' AS first, status || ' ends.' AS second FROM chapters"
#: Chapters of a task, on average, where they are numbered and put together.
CHAPTERS_A_TASK = 500_000


def book_lines(spark, d):
    """The view, its chapters dealt out by work to as many tasks as they demand."""
    orders = frame(spark, d, "orders")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(orders.count() / CHAPTERS_A_TASK))
    return frame(spark, d, "book_lines", orders=orders.repartition(tasks, "o_custkey"))


@query("headings", over("SELECT work_id, position - 1 AS position, '第' || position || '章' AS label_raw, substring(head, length('第' || position || '章') + 2) AS title, first || chr(10) || chr(10) || second AS body, 'ch:' || position AS key FROM book_lines"))
def headings(spark, d):
    """Books cut at their headings."""
    lines = book_lines(spark, d).withColumn("text", F.concat_ws("\n", "head", "first", F.lit(""), "second"))
    books = lines.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\r\n").alias("text"))
    found = text_files.chapters(books.select(F.col("work_id").cast("string").alias("path"), "text"))
    return found.select(F.col("path").cast("long").alias("work_id"), "position", "label_raw", "title", "body", F.col("label.key").alias("key"))


@query("heading_warnings", over("SELECT work_id, CASE WHEN count(*) = 1 THEN 'single_heading' ELSE '' END AS warning FROM book_lines GROUP BY work_id"))
def heading_warnings(spark, d):
    lines = book_lines(spark, d)
    books = lines.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "head"))), lambda x: x["head"]), "\n\n").alias("text")).select(F.col("work_id").cast("string").alias("path"), "text")
    return text_files.book_warnings(books, text_files.chapters(books)).select(F.col("path").cast("long").alias("work_id"), F.array_join("warnings", ",").alias("warning"))


# A work's front matter, its status in one of many wordings.
SAID = "CASE id % 8 WHEN 0 THEN '本書已完結' WHEN 1 THEN '未完結' WHEN 2 THEN '未完成' WHEN 3 THEN '連載中 (Ongoing)' WHEN 4 THEN '全本' WHEN 5 THEN 'Completed at last' WHEN 6 THEN '未定' ELSE 'finis' END"
VIEWS["heads"] = f"SELECT id, title, author, work_type, {SAID} AS said FROM works"
STATUS = "CASE WHEN id % 8 IN (1, 2, 3) THEN 'ongoing' WHEN id % 8 IN (0, 4, 5) THEN 'completed' END"


@query("front_matter", over(f"SELECT id, CASE WHEN id % 3 = 0 THEN title ELSE 'Q' || title END AS title, author, 'First ' || work_type || chr(10) || 'second line' AS description, {STATUS} AS status, work_type || '|k' || id % 5 AS keywords FROM heads"))
def front_matter(spark, d):
    """Fields, a quoted title, a description that goes on, keywords; nothing after the first chapter counts."""
    named = F.when(F.col("id") % 3 == 0, F.concat(F.lit("書名："), "title")).otherwise(F.concat(F.lit("《Q"), "title", F.lit("》")))
    head = F.concat_ws("\n", named, F.concat(F.lit("作者: "), "author"), F.concat(F.lit("狀態："), "said"), F.concat(F.lit("標籤："), "work_type", F.lit("、k"), (F.col("id") % 5).cast("string"), F.lit("，"), "work_type"), F.concat(F.lit("簡介：First "), "work_type"), F.lit("second line"), F.lit("第一章 x"), F.lit("作者：nobody"))
    m = text_files.front_matter(head)
    return frame(spark, d, "heads").withColumn("m", m).select("id", "m.title", "m.author", "m.description", F.col("m.serial_status").alias("status"), F.array_join("m.keywords", "|").alias("keywords"))


@query("completion_words", over(f"SELECT id, {STATUS} AS status FROM heads"))
def completion_words(spark, d):
    """Statuses out of the wordings that works have."""
    return frame(spark, d, "heads").select("id", S.completion_status(F.concat("title", F.lit(" "), "said")).alias("status"))


@query("image_blocks", "SELECT doc_id, sum(CASE WHEN p LIKE '[[img:%' AND length(p) > 40 THEN 1 ELSE 0 END)::BIGINT AS images, count(*)::BIGINT AS blocks, min(CASE WHEN p LIKE '[[img:%' THEN substring(p, 7, 64) END) AS first_hash, count(DISTINCT CASE WHEN p LIKE '[[img:%' THEN substring(p, 7, 64) END)::BIGINT AS distinct_images FROM (SELECT doc_id, unnest([source, '[[img:' || sha256(lang) || '|cat]]', 'tail', '[[img:' || sha256(source) || '|]]', '[[img:' || sha256(lang) || '|again]]', 'see [[img:x|y]]']) AS p FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND source <> '') t GROUP BY doc_id")
def image_blocks(spark, d):
    """Markers, made of any alternative text, among paragraphs that only mention one."""
    docs = frame(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL AND source <> ''")
    of = lambda c, alt: S.image_marker(F.sha2(c, 256), F.lit(alt))
    body = F.concat_ws("\n\n", "source", of("lang", " [cat] "), F.lit("tail"), of("source", None), of("lang", "again"), F.lit("see [[img:x|y]]"))
    rows = docs.withColumn("b", S.blocks(body)).withColumn("used", S.referenced_images(body))
    images = F.filter("b", lambda x: x["kind"] == "image")
    return rows.select("doc_id", F.size(images).cast("long").alias("images"), F.size("b").cast("long").alias("blocks"), F.array_min("used").alias("first_hash"), F.size("used").cast("long").alias("distinct_images"))


@query("file_names", over("SELECT id, left(replace(replace(title, '#', '_'), ':', '_'), 100) || CASE WHEN id % 2 = 0 THEN '_' ELSE '' END AS name FROM works"))
def file_names(spark, d):
    """Characters that file systems refuse, one for one."""
    title = F.concat(F.lit("  "), F.replace("title", F.lit("#"), F.lit(":")), F.when(F.col("id") % 2 == 0, "?").otherwise("　"))
    return frame(spark, d, "works").select("id", S.filename(title).alias("name"))


@query("composed_names", over("SELECT id, author || 'é가ﬁ' AS composed, lower(author) || '-é가fix1' AS plain FROM works"))
def composed_names(spark, d):
    """Decomposed letters and syllables put together; compatibility forms folded where a slug is made, and only there."""
    loose = "é가"
    works = frame(spark, d, "works")
    folded = S.normalised(F.concat(F.lower("author"), F.lit(f"-{loose}ﬁｘ1")), "NFKC")
    return works.select("id", S.normalised(F.concat("author", F.lit(f"{loose}ﬁ"))).alias("composed"), folded.alias("plain"))


TIDY = r"""WITH lines AS (SELECT doc_id, u.pos AS nr, u.line AS line, trim(u.line, ' ' || chr(9) || chr(13)) AS t FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents) d, unnest(ls) WITH ORDINALITY AS u(line, pos)),
marked AS (SELECT *, t = '' AND lag(t) OVER w = '' AS again FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY nr)),
spaced AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY nr) AS before FROM marked WHERE again IS NOT TRUE),
joined AS (SELECT *, coalesce(length(before) BETWEEN 1 AND 60 AND length(t) BETWEEN 1 AND 60 AND NOT regexp_matches(before, '[。！？!?；;…」』）》】]$') AND NOT regexp_matches(t, '^[「『（(《【]') AND NOT regexp_matches(t, '^\s*(?:[-*•]|\d+[.、])')
   AND NOT regexp_matches(before, '(?i)^\s*(title|author|description|status)\s*[:：]') AND NOT regexp_matches(t, '(?i)^\s*(title|author|description|status)\s*[:：]'), false) AS joins FROM spaced),
whole AS (SELECT doc_id, trim(string_agg(CASE WHEN before IS NULL THEN '' WHEN joins THEN CASE WHEN ascii(t) < 128 AND ascii(right(before, 1)) < 128 THEN ' ' ELSE '' END ELSE chr(10) END || t, '' ORDER BY nr), chr(10)) AS text, sum(joins::INT)::INT AS joined FROM joined GROUP BY doc_id)
SELECT doc_id, sha256(w.text) AS body, joined, (SELECT count(*) FROM lines l WHERE l.doc_id = w.doc_id AND l.t <> l.line)::INT AS trimmed, (SELECT count(*) FROM marked m WHERE m.doc_id = w.doc_id AND m.again)::INT AS collapsed FROM whole w"""


@query("tidied", TIDY)
def tidied(spark, d):
    """Texts tidied up, and what was done to each."""
    t = text_files.tidy(F.coalesce("text", F.lit("")), join=True)
    return frame(spark, d, "documents").withColumn("t", t).select("doc_id", F.sha2("t.text", 256).alias("body"), "t.joined", "t.trimmed", "t.collapsed")


@query("phrases_converted", "SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, 'tion', chr(1)), 'the and', chr(2)), 'the', 'THE'), chr(1), 'STATION'), chr(2), 'BOTH')) AS body FROM documents")
def phrases_converted(spark, d):
    """The longest phrase of a given table at each place."""
    table = spark.createDataFrame([("the and", "BOTH"), ("the", "THE"), ("tion", "STATION")], "traditional string, simplified string")
    return frame(spark, d, "documents").select("doc_id", F.sha2(converter("simplified", table)(F.col("text")), 256).alias("body"))


@query("upload_errors", "SELECT doc_id, sha256(coalesce(text, '')) AS file_hash, CASE WHEN doc_id % 3 = 2 THEN 'unsupported_format' WHEN coalesce(text, '') = '' THEN 'empty_file' END AS error, CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'epub' ELSE 'pdf' END AS ending FROM documents")
def upload_errors(spark, d):
    """Source files that an import takes or refuses."""
    ending = F.when(F.col("doc_id") % 3 == 0, "TXT").when(F.col("doc_id") % 3 == 1, "epub").otherwise("pdf")
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    files = frame(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("path"), content.alias("content"), F.length(content).alias("length"))
    return objects.uploads(files).select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("doc_id"), "file_hash", "error", "ending")


@query("object_listing", "SELECT doc_id, left(h, 2) || '/' || h || '.txt' AS key, octet_length(encode(text))::BIGINT AS size FROM (SELECT doc_id, text, sha256(text) AS h FROM documents WHERE text IS NOT NULL) t")
def object_listing(spark, d):
    """The store's well-formed keys, made from the content."""
    held = frame(spark, d, "documents").where("text IS NOT NULL").select("doc_id", objects.object_key(F.col("text"), "txt").alias("content_key"), F.octet_length("text").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified_at"))
    strays = held.withColumn("content_key", F.concat(F.lit("../"), "content_key"))
    listed = objects.listing(held.unionByName(strays))
    return listed.distinct().join(held.select("doc_id", F.col("content_key").alias("key")), "key").select("doc_id", "key", "size")
