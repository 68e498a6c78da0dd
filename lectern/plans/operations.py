"""Queue, sweeps, manifests and exports over the analog tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import maintenance as M
from lectern.plans import projections as _views  # noqa: F401  # the views of releases and revisions
from lectern.plans.analog import VIEWS, frame, over
from lectern.plans.registry import query
from lectern.sources import exports as E

VIEWS["jobs"] = """SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderdate AS lease_expires_at, CAST(o_orderkey % 4 AS INT) AS attempt_count,
  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'processing' ELSE 'failed' END AS status FROM orders"""
NOW = "TIMESTAMP '1996-01-01 00:00:00'"


def now():
    return F.lit("1996-01-01 00:00:00").cast("timestamp")


@query("claim_next", over(f"SELECT id FROM jobs WHERE status = 'queued' OR (status = 'processing' AND lease_expires_at < {NOW} AND attempt_count < 3) ORDER BY created_at, id LIMIT 1"))
def claim_next(spark, d):
    return M.claimable(frame(spark, d, "jobs"), now()).select("id")


@query("reap_jobs", over(f"SELECT id, CASE WHEN status = 'processing' AND lease_expires_at < {NOW} AND attempt_count >= 3 THEN 'failed' ELSE status END AS status FROM jobs"))
def reap_jobs(spark, d):
    return M.reap(frame(spark, d, "jobs"), now()).select("id", "status")


@query("ops_counts", over(f"""SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'processing' AND lease_expires_at < {NOW}) AS stale, count(*) FILTER (status = 'failed') AS failed, date_diff('second', min(created_at) FILTER (status = 'queued'), {NOW}) AS oldest_queued_seconds,
  concat_ws(',', CASE WHEN count(*) FILTER (status = 'processing' AND lease_expires_at < {NOW}) > 0 THEN 'stale_leases' END, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed_jobs' END, CASE WHEN date_diff('second', min(created_at) FILTER (status = 'queued'), {NOW}) > 900 THEN 'queue_delay' END) AS warnings FROM jobs"""))
def ops_counts(spark, d):
    return M.ops_warnings(M.ops_counts(frame(spark, d, "jobs"), now())).withColumn("warnings", F.array_join("warnings", ","))


@query("orphan_sweep", f"SELECT doc_id AS key FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id) AND {NOW} - INTERVAL (doc_id % 60) HOUR < {NOW} - INTERVAL 24 HOUR ORDER BY key LIMIT 5000")
def orphan_sweep(spark, d):
    age = F.make_dt_interval(hours=(F.col("doc_id") % 60).cast("int"))
    objects = frame(spark, d, "documents").select(F.col("doc_id").alias("key"), (now() - age).alias("modified_at"))
    used = [frame(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("key")), frame(spark, d, "benchmark").select(F.col("item_id").alias("key"))]
    return M.orphans(objects, used, now()).select("key")


@query("missing_objects", "SELECT quality = 1 AS published, count(DISTINCT doc_id) AS n FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.doc_id % 7 <> 0) GROUP BY 1")
def missing_objects(spark, d):
    held = frame(spark, d, "documents").where("doc_id % 7 <> 0").select(F.col("doc_id").alias("key"))
    return M.missing_objects(held, frame(spark, d, "labels").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("published")))


@query("reachable_union", "SELECT l_partkey AS key FROM lineitem UNION SELECT ps FROM (SELECT l_suppkey + 1000000 AS ps FROM lineitem) t")
def reachable_union(spark, d):
    li = frame(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("key")).union(li.select(F.col("l_suppkey") + 1000000)).distinct()


@query("backup_manifest", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "documents")))
def backup_manifest(spark, d):
    return M.manifest({t: frame(spark, d, t) for t in ("customer", "orders", "lineitem", "documents")})


@query("restore_verify", "SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS expected, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS actual UNION ALL SELECT 'part', NULL, (SELECT count(*) FROM part)")
def restore_verify(spark, d):
    t = {k: frame(spark, d, k) for k in ("customer", "orders", "part")}
    return M.verify_restore(M.manifest({k: t[k] for k in ("customer", "orders")}), M.manifest({"customer": t["customer"], "orders": t["orders"].where("o_orderkey % 2 = 0"), "part": t["part"]}))


@query("taxonomy_suggest", over("""WITH w AS (SELECT DISTINCT upper(n_name) || ' ' AS word FROM nation UNION SELECT DISTINCT o_orderpriority FROM orders UNION SELECT 'nothing'), k AS (SELECT word, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS k FROM w)
SELECT word, (SELECT arg_min(id, sort_order) FROM categories c WHERE is_active AND regexp_replace(lower(display_name), '[^a-z0-9]', '', 'g') = k.k) AS category_id,
  (SELECT min(id) FROM tags t WHERE is_active AND regexp_replace(lower(display_name), '[^a-z0-9]', '', 'g') = k.k) AS tag_id FROM k"""))
def taxonomy_suggest(spark, d):
    words = frame(spark, d, "nation").select(F.concat(F.upper("n_name"), F.lit(" ")).alias("word")).union(frame(spark, d, "orders").select("o_orderpriority")).union(spark.range(1).select(F.lit("nothing"))).distinct()
    return M.suggest(words, frame(spark, d, "categories"), frame(spark, d, "tags").withColumn("sort_order", F.lit(0)))


@query(
    "object_manifest",
    over("""WITH u AS (SELECT DISTINCT revision_id FROM release_items), k AS (SELECT DISTINCT 'body' AS kind, content_key::VARCHAR AS key FROM revisions WHERE id IN (SELECT revision_id FROM u)
  UNION SELECT 'image', content_hash FROM resources WHERE content_hash IN (SELECT content_hash FROM links WHERE revision_id IN (SELECT revision_id FROM u)))
SELECT k.kind, k.key, sha256(b.body) AS sha256, octet_length(encode(b.body))::INT AS size FROM k LEFT JOIN bodies b ON b.content_key::VARCHAR = k.key"""),
)
def object_manifest(spark, d):
    items, revisions, links, resources, bodies = (frame(spark, d, t) for t in ("release_items", "revisions", "links", "resources", "bodies"))
    return M.object_manifest(M.reachable_objects(items, revisions, links, resources), bodies.select(F.col("content_key").cast("string").alias("key"), F.col("body").alias("content")))


@query(
    "restore_objects",
    "SELECT 'body' AS kind, doc_id::VARCHAR AS key, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE text IS NOT NULL AND (doc_id % 5 = 0 OR doc_id % 7 = 0)",
)
def restore_objects(spark, d):
    docs = frame(spark, d, "documents").where("text IS NOT NULL").select(F.lit("body").alias("kind"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("content"), "doc_id")
    restored = docs.where("doc_id % 5 <> 0").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return M.verify_objects(M.object_manifest(docs.select("kind", "key"), docs), restored)


@query("latency_percentiles", "SELECT event_type AS name, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return M.percentiles(frame(spark, d, "events").select(F.col("event_type").alias("name"), F.col("value").alias("ms")))


STATES = ("queued", "processing", "review_required", "ready", "failed", "cancelled", "committed", "applied", "reverted")


# every pair of states occurs
@query(
    "illegal_transitions",
    f"""WITH s AS (SELECT event_id, {list(STATES)}[event_id % 9 + 1] AS before, {list(STATES)}[event_id // 9 % 9 + 1] AS after FROM events)
SELECT event_id, before, after FROM s WHERE NOT (after = 'cancelled' AND before IN ('queued', 'processing', 'review_required', 'ready', 'failed')
  OR after = 'queued' AND before IN ('processing', 'review_required', 'ready', 'failed') OR after = 'processing' AND before = 'queued' OR after = 'ready' AND before IN ('processing', 'review_required')
  OR after IN ('review_required', 'failed') AND before = 'processing' OR after IN ('committed', 'applied') AND before = 'ready' OR after = 'reverted' AND before = 'applied')""",
)
def illegal_transitions(spark, d):
    e, states = F.col("event_id"), F.array(*map(F.lit, STATES))
    steps = frame(spark, d, "events").select("event_id", F.get(states, (e % 9).cast("int")).alias("before"), F.get(states, (F.floor(e / 9) % 9).cast("int")).alias("after"))
    return M.illegal(steps).select("event_id", "before", "after")


@query("idempotent_replay", "SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'applied' WHEN event_type = first_value(event_type) OVER w THEN 'replayed' ELSE 'conflict' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def idempotent_replay(spark, d):
    r = frame(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload_hash"))
    return M.replay(r).select("event_id", "outcome")


@query("taxonomy_assign", over("SELECT work_id, tag_id FROM work_tags WHERE work_id % 10 <> 0 UNION ALL SELECT DISTINCT work_id, '5-LOW' FROM work_tags WHERE work_id % 10 = 0"))
def taxonomy_assign(spark, d):
    edges = frame(spark, d, "work_tags")
    return M.replace_edges(edges, edges.where("work_id % 10 = 0").select("work_id").distinct().withColumn("tag_id", F.lit("5-LOW")))


@query("taxonomy_invalid", over("SELECT work_id, CASE WHEN count(*) > 4 THEN 'too_many' WHEN count(*) FILTER (tag_id = '4-NOT SPECIFIED' AND work_id % 2 = 0) > 0 THEN 'inactive' END AS problem FROM work_tags GROUP BY work_id HAVING count(*) > 4 OR count(*) FILTER (tag_id = '4-NOT SPECIFIED' AND work_id % 2 = 0) > 0"))
def taxonomy_invalid(spark, d):
    edges = frame(spark, d, "work_tags")
    return M.invalid_assignments(edges, frame(spark, d, "tags"), edges.where("work_id % 2 <> 0"), "tag_id", 4)


def books(spark, d):
    works = frame(spark, d, "works").select("id", F.replace("title", F.lit("#"), F.lit("_")).alias("title"), "author", F.concat(F.lit("v"), F.col("edit_version").cast("string")).alias("version_label"))
    chapters = frame(spark, d, "chapters").select("work_id", "position", "label_raw", F.lit(None).cast("string").alias("title"), F.col("volume").alias("body"))
    return works, chapters


@query(
    "export_txt",
    over("""SELECT id, file, sha256(content) AS content FROM (SELECT w.id, w.title || '.txt' AS file, chr(65279) || '作品名：' || w.title || chr(10) || '作者：' || w.author || chr(10) || '版本：v' || w.edit_version || chr(10)
  || string_agg(chr(10) || chr(10) || c.label_raw || chr(10) || chr(10) || c.volume, chr(10) || chr(10) ORDER BY c.position) || chr(10) AS content
FROM (SELECT id, replace(title, '#', '_') AS title, author, edit_version FROM works) w JOIN chapters c ON c.work_id = w.id GROUP BY w.id, w.title, w.author, w.edit_version) t"""),
)
def export_txt(spark, d):
    return E.txt(*books(spark, d)).select("id", "file", F.sha2("content", 256).alias("content"))


@query("export_budget", "SELECT work_id, sum(bytes)::BIGINT AS bytes FROM (SELECT DISTINCT source AS work_id, doc_id % 50 AS k, octet_length(encode(source)) * (doc_id % 50) AS bytes FROM documents) t GROUP BY work_id HAVING sum(bytes) > 500")
def export_budget(spark, d):
    docs = frame(spark, d, "documents").select(F.col("source").alias("work_id"), (F.col("doc_id") % 50).alias("body_key"), F.expr("repeat(source, CAST(doc_id % 50 AS INT))").alias("body"))
    return E.over_budget(docs, 500).select("work_id", "bytes")


@query("sitemap_page", over("SELECT id, '<url><loc>https://x.example/' || lower(replace(title, '#', '-')) || '-' || left(id::VARCHAR, 8) || '</loc><lastmod>' || strftime(published_at, '%Y-%m-%d') || '</lastmod></url>' AS xml FROM works ORDER BY id LIMIT 500 OFFSET 500"))
def sitemap_page(spark, d):
    return E.sitemap_page(frame(spark, d, "works").withColumnRenamed("published_at", "lastmod"), "https://x.example", 2, 500)


@query(
    "sitemap_chapters",
    over("""SELECT w.id, c.id AS chapter_id, '<url><loc>https://x.example/' || lower(replace(w.title, '#', '-')) || '-' || left(w.id::VARCHAR, 8) || '/' || c.id || '</loc><lastmod>' || strftime(r.created_at, '%Y-%m-%d') || '</lastmod></url>' AS xml
FROM works w JOIN release_items i ON i.release_id = w.active_release_id JOIN revisions r ON r.id = i.revision_id JOIN chapters c ON c.id = i.chapter_id WHERE w.visibility = 'public' ORDER BY w.id, c.id LIMIT 300 OFFSET 600"""),
)
def sitemap_chapters(spark, d):
    """Chapter pages, each with the time of its published revision."""
    works = frame(spark, d, "works").where("visibility = 'public'").select("id", "title", F.col("active_release_id").alias("release_id"))
    items = frame(spark, d, "release_items").join(works, "release_id").join(frame(spark, d, "revisions").select(F.col("id").alias("revision_id"), F.col("created_at").alias("lastmod")), "revision_id")
    return E.sitemap_page(items.select("id", "title", "lastmod", "chapter_id"), "https://x.example", 3, 300)


@query("sitemap_index", "SELECT kind, u.page::INT AS page FROM (SELECT 'works' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'chapters', count(*) FROM orders) t, unnest(range(1, ((n + 999) // 1000 + 1)::BIGINT)) u(page)")
def sitemap_index(spark, d):
    counts = M.manifest({"works": frame(spark, d, "customer"), "chapters": frame(spark, d, "orders")}).withColumnRenamed("table_name", "kind")
    return E.sitemap_index(counts, 1000)
