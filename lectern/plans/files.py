"""Books and sitemaps written as files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import import_flow
from lectern.plans.analog import frame, over
from lectern.plans.operations import books
from lectern.plans.registry import ORACLE, query
from lectern.sources import epub_files, objects
from lectern.sources import exports as E
from lectern.sources.book_files import book_name, read_files, write_files
from lectern.stored import shared_folder


def own_folder(spark, what):
    return f"{shared_folder(spark)}/lectern/{what}-{uuid.uuid4().hex}"


@query("export_files", ORACLE["export_txt"].replace("SELECT id, file, sha256(content) AS content", "SELECT id || '-' || file AS file, octet_length(encode(content))::BIGINT AS size, sha256(content) AS content"))
def export_files(spark, d):
    """Every book written as a file, and the files read back."""
    folder = own_folder(spark, "books")
    out = E.txt(*books(spark, d))
    write_files(out, folder, book_name(F.col("id"), F.col("file")), F.col("content"))
    return read_files(spark, folder, ".txt").select("file", "size", F.sha2("content", 256).alias("content"))


@query("export_epub_files", over("SELECT w.id AS work_id, c.position::INT AS position, c.label_raw AS label_raw, c.label_raw || chr(10) || chr(10) || c.volume AS body FROM works w JOIN chapters c ON c.work_id = w.id"))
def export_epub_files(spark, d):
    """Every book written as an EPUB file, and its chapters read back by the EPUB source."""
    folder = own_folder(spark, "epubs")
    works, chapters = books(spark, d)
    out = E.epub(works, chapters.withColumn("body_key", F.sha2("body", 256)))
    write_files(out, folder, F.concat(F.col("id").cast("string"), F.lit(".epub")), F.col("content"))
    pages = epub_files.chapters(read_files(spark, folder, ".epub"))
    work = F.regexp_extract("path", r"([0-9]+)\.epub$", 1).cast("long")
    return pages.where("error IS NULL").select(work.alias("work_id"), F.dense_rank().over(Window.partitionBy("path").orderBy("position")).alias("position"), "label_raw", "body")


@query("sitemap_files", over("SELECT file, sha256(content) AS content FROM (SELECT 'sitemap-works-' || page || '.xml' AS file, '<?xml version=\"1.0\" encoding=\"UTF-8\"?><urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">' || string_agg(xml, '' ORDER BY nr) || '</urlset>' AS content FROM (SELECT nr, (nr - 1) // 400 + 1 AS page, '<url><loc>https://x.example/' || lower(replace(title, '#', '-')) || '-' || left(u, 8) || '</loc><lastmod>' || strftime(published_at, '%Y-%m-%d') || '</lastmod></url>' AS xml FROM (SELECT *, row_number() OVER (ORDER BY published_at, u) AS nr FROM (SELECT *, md5(id::VARCHAR) AS u FROM works) a) b) c GROUP BY page) e"))
def sitemap_files(spark, d):
    """All pages as files, of works with UUID-like ids in the order they were made, written and read back."""
    works = frame(spark, d, "works").select(F.md5(F.col("id").cast("string")).alias("id"), "title", F.col("published_at").alias("lastmod"), F.col("published_at").alias("created_at"))
    folder = own_folder(spark, "sitemap")
    out = E.sitemap_files(works, "https://x.example", "works", 400)
    write_files(out, folder, F.col("file"), F.col("content"))
    return read_files(spark, folder, ".xml").select("file", F.sha2("content", 256).alias("content"))


@query("stored_bodies", "SELECT doc_id, sha256(text) AS body, octet_length(encode(text))::BIGINT AS size FROM documents WHERE text IS NOT NULL")
def stored_bodies(spark, d):
    """Bodies put twice into a store by their content, and got back by key."""
    folder = own_folder(spark, "objects")
    docs = frame(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("body"))
    keyed = objects.put_bodies(docs, folder).select("doc_id", "content_key")
    objects.put_bodies(docs, folder)
    held = objects.get(objects.stored(spark, folder), keyed)
    return held.select("doc_id", F.sha2("body", 256).alias("body"), F.col("size").cast("long").alias("size"))


@query("staged_jobs", over("SELECT work_id, CASE WHEN count(*) = 0 THEN 'failed' ELSE 'ready' END AS status, 'utf-8' AS encoding, count(*)::INT AS chapter_count, coalesce(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) FILTER (nth = 1), 0)::BIGINT AS repeats FROM (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY work_id, status ORDER BY position) AS nth FROM chapters WINDOW w AS (PARTITION BY work_id, status)) t GROUP BY work_id"))
def staged_jobs(spark, d):
    """Works' texts written as files and imported: a job a file, with how many bodies it has more than once."""
    folder = own_folder(spark, "sources")
    lines = frame(spark, d, "chapters").select("work_id", "position", F.concat(F.lit("第"), F.col("position").cast("string"), F.lit("章\n"), "status", F.lit(" body text")).alias("text"))
    books = lines.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("text"))
    write_files(books, folder, F.concat(F.col("work_id").cast("string"), F.lit(".txt")), F.col("text"))
    _, jobs = import_flow.stage(read_files(spark, folder, ".txt"))
    work = F.regexp_extract("job_id", r"([0-9]+)\.txt$", 1).cast("long")
    return jobs.select(work.alias("work_id"), "status", "encoding", "chapter_count", F.coalesce(F.element_at("findings", "duplicate_body"), F.lit(0)).cast("long").alias("repeats"))


@query("epub_images", over("SELECT id AS work_id, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS shown, 1::BIGINT AS images, sha256('picture ' || author) AS content_hash FROM works"))
def epub_images(spark, d):
    """Books with pictures written as EPUB files and read back: every place keeps its marker, every picture is there once."""
    folder = own_folder(spark, "pictures")
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.concat(F.lit("picture "), "author").cast("binary"))
    works = frame(spark, d, "works").select("id", "title", "author", png.alias("bytes")).withColumn("hash", F.sha2("bytes", 256))
    marker = F.concat(F.lit("[[img:"), "hash", F.lit("|seen]]"))
    body = F.concat(F.lit("before\n\n"), marker, F.when(F.col("id") % 3 == 0, F.concat(F.lit("\n\n"), marker)).otherwise(""), F.lit("\n\nafter"))
    chapters = works.select(F.col("id").alias("work_id"), F.lit(1).alias("position"), F.lit("One").alias("label_raw"), F.lit("One").alias("title"), body.alias("body"), F.sha2(body, 256).alias("body_key"))
    images = works.select(F.col("id").alias("work_id"), F.col("hash").alias("content_hash"), F.lit("image/png").alias("media_type"), "bytes")
    write_files(E.epub(works.select("id", "title", "author"), chapters, images), folder, F.concat(F.col("id").cast("string"), F.lit(".epub")), F.col("content"))
    files = read_files(spark, folder, ".epub")
    work = F.regexp_extract("path", r"([0-9]+)\.epub$", 1).cast("long").alias("work_id")
    pages = epub_files.chapters(files).where("error IS NULL").select(work, F.regexp_count("body", F.lit(r"\[\[img:[0-9a-f]{64}\|seen\]\]")).cast("long").alias("shown"))
    held = epub_files.images(files).select(work, F.sha2(F.substr(F.col("bytes"), F.lit(9)), 256).alias("content_hash"))
    return pages.join(held.groupBy("work_id").agg(F.count("*").alias("images"), F.min("content_hash").alias("content_hash")), "work_id")
