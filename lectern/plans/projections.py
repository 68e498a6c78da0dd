"""Reader and editor projections, objects and the import flow over the analog tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import import_flow as flow
from lectern.operators import ingest as I
from lectern.operators import projections as J
from lectern.plans.analog import VIEWS, frame, over
from lectern.plans.imports import MATCH
from lectern.plans.registry import query

VIEWS["releases"] = """SELECT id, id AS work_id, CAST(2 AS INT) AS version, published_at, CAST(id % 9 AS INT) AS chapter_count FROM works WHERE active_release_id IS NOT NULL
UNION ALL SELECT id + 1000000, id, CAST(1 AS INT), published_at, CAST(id % 7 AS INT) FROM works
UNION ALL SELECT id + 2000000, id, CAST(3 AS INT), published_at, CAST(id % 5 AS INT) FROM works WHERE id % 5 = 0"""
VIEWS["release_items"] = "SELECT o_custkey AS release_id, o_orderkey AS chapter_id, o_orderkey * 10 + o_orderkey % 3 AS revision_id, 'Ch ' || CAST(o_orderkey % 1000 AS VARCHAR(5)) AS label_raw, CAST(o_orderkey AS INT) AS position FROM orders WHERE o_orderkey % 5 <> 0"
VIEWS["revisions"] = " UNION ALL ".join(f"SELECT o_orderkey * 10 + {k} AS id, o_orderkey AS chapter_id, 'T{k}-' || o_orderpriority AS title, (o_orderkey + {k}) % 1500 AS content_key, o_orderdate AS created_at FROM orders" for k in range(3))
VIEWS["all_chapters"] = """SELECT id, work_id, label_raw, position, CASE WHEN id % 13 <> 0 THEN id * 10 + id % 3 END AS head_revision_id,
  CASE WHEN id % 29 = 0 THEN id - 1 END AS merged_into_chapter_id, CASE WHEN id % 31 = 0 THEN DATE '2024-02-03' END AS deleted_at FROM chapters"""
VIEWS["bodies"] = "SELECT doc_id AS content_key, coalesce(text, '') AS body FROM documents"
VIEWS["links"] = """SELECT o_orderkey * 10 + o_orderkey % 3 AS revision_id, 'h' || CAST(o_orderkey % 50 AS VARCHAR(3)) AS content_hash, 'a' || o_orderstatus AS alt FROM orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT o_orderkey * 10 + o_orderkey % 3, 'h' || CAST((o_orderkey + 1) % 50 AS VARCHAR(3)), '' FROM orders WHERE o_orderkey % 12 = 0"""
VIEWS["resources"] = "SELECT DISTINCT 'h' || CAST(p_partkey % 48 AS VARCHAR(3)) AS content_hash, 'image/png' AS media_type, CAST(p_partkey % 48 * 10 AS INT) AS size_bytes FROM part"
VIEWS["progress"] = "SELECT user_id, event_id % 1500 AS work_id, max(event_id) AS chapter_id, CAST(max(event_id % 40) AS INT) AS paragraph_index FROM events WHERE event_id % 4 <> 0 GROUP BY user_id, event_id % 1500"

GATE = """SELECT *, CASE WHEN access = 'ok' THEN CASE WHEN visibility = 'draft' THEN 'head' WHEN active_release_id IS NOT NULL THEN 'release' ELSE 'none' END END AS source
FROM (SELECT *, CASE WHEN visibility = 'removed' THEN 'work_not_found' WHEN visibility = 'draft' AND '{role}' <> 'admin' THEN 'forbidden' ELSE 'ok' END AS access FROM works) t"""


def frames(spark, d, *names):
    return [frame(spark, d, n) for n in names]


@query("reader_gate", over(f"SELECT id, access, source FROM ({GATE.format(role='')}) g"))
def reader_gate(spark, d):
    return J.gate(frame(spark, d, "works")).select("id", "access", "source")


@query(
    "work_detail",
    over("""SELECT w.id, w.title, w.author, w.work_type, w.serial_status, w.visibility, r.id AS release_id, r.version AS release_version, r.published_at AS released_at, r.chapter_count,
  (SELECT arg_min(chapter_id, position) FROM release_items i WHERE i.release_id = r.id) AS first_chapter_id,
  coalesce((SELECT string_agg(DISTINCT c.display_name, ',' ORDER BY c.display_name) FROM work_categories e JOIN categories c ON c.id = e.category_id WHERE e.work_id = w.id AND c.is_active), '') AS category_names,
  coalesce((SELECT string_agg(DISTINCT t.display_name, ',' ORDER BY t.display_name) FROM work_tags e JOIN tags t ON t.id = e.tag_id WHERE e.work_id = w.id AND t.is_active), '') AS tag_names
FROM works w JOIN releases r ON r.id = w.active_release_id WHERE w.visibility IN ('public', 'unlisted')"""),
)
def work_detail(spark, d):
    out = J.work_detail(*frames(spark, d, "works", "releases", "release_items", "categories", "work_categories", "tags", "work_tags"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("category_names", "tag_names")})


@query(
    "reader_metadata",
    over(f"""WITH g AS ({GATE.format(role="admin")}), c AS (SELECT work_id, arg_min(id, position) AS f, arg_max(id, position) AS l, count(*) AS n FROM all_chapters WHERE merged_into_chapter_id IS NULL AND deleted_at IS NULL GROUP BY work_id),
i AS (SELECT release_id, arg_min(chapter_id, position) AS f, arg_max(chapter_id, position) AS l FROM release_items GROUP BY release_id)
SELECT g.id, g.source, CASE WHEN source = 'head' THEN coalesce(c.n, 0) WHEN source = 'release' THEN r.chapter_count ELSE 0 END::INT AS chapter_count,
  CASE WHEN source = 'head' THEN c.f WHEN source = 'release' THEN i.f END AS first_chapter_id, CASE WHEN source = 'head' THEN c.l WHEN source = 'release' THEN i.l END AS latest_chapter_id,
  CASE WHEN source = 'release' THEN r.id END AS release_id, CASE WHEN source = 'release' THEN r.version END AS release_version
FROM g LEFT JOIN releases r ON r.id = g.active_release_id LEFT JOIN i ON i.release_id = g.active_release_id LEFT JOIN c ON c.work_id = g.id WHERE access = 'ok'"""),
)
def reader_metadata(spark, d):
    out = J.reader_metadata(*frames(spark, d, "works", "releases", "release_items", "all_chapters"), role="admin")
    return out.select("id", "source", "chapter_count", "first_chapter_id", "latest_chapter_id", "release_id", "release_version")


@query(
    "chapter_view",
    over(f"""WITH g AS ({GATE.format(role="admin")}), c AS (SELECT g.id AS work_id, i.chapter_id, i.revision_id, i.label_raw, i.position FROM g JOIN release_items i ON i.release_id = g.active_release_id WHERE source = 'release'
  UNION ALL SELECT g.id, c.id, c.head_revision_id, c.label_raw, c.position FROM g JOIN all_chapters c ON c.work_id = g.id WHERE source = 'head' AND merged_into_chapter_id IS NULL AND deleted_at IS NULL),
n AS (SELECT *, lag(chapter_id) OVER w AS previous_chapter_id, lead(chapter_id) OVER w AS next_chapter_id FROM c WINDOW w AS (PARTITION BY work_id ORDER BY position)),
l AS (SELECT k.revision_id, string_agg(k.content_hash || ':' || s.size_bytes || ':' || k.alt, ',' ORDER BY k.content_hash) AS resources FROM links k JOIN resources s ON s.content_hash = k.content_hash GROUP BY k.revision_id)
SELECT n.chapter_id, n.work_id, n.revision_id, n.label_raw, v.title, sha256(b.body) AS body, n.previous_chapter_id, n.next_chapter_id, CASE WHEN coalesce(b.body, '') = '' THEN 0 ELSE len(string_split(b.body, chr(10) || chr(10))) END::INT AS paragraph_count,
  v.created_at AS updated_at, l.resources, CASE WHEN b.body IS NULL THEN 'content_unavailable' END AS error
FROM n LEFT JOIN revisions v ON v.id = n.revision_id LEFT JOIN bodies b ON b.content_key = v.content_key LEFT JOIN l ON l.revision_id = n.revision_id"""),
)
def chapter_view(spark, d):
    out = J.chapter_view(*frames(spark, d, "works", "release_items", "all_chapters", "revisions", "bodies", "links", "resources"), role="admin")
    shown = F.transform("resources", lambda r: F.concat_ws(":", r["content_hash"], r["size_bytes"].cast("string"), r["alt"]))
    return out.withColumn("body", F.sha2("body", 256)).withColumn("resources", F.when(F.col("resources").isNotNull(), F.array_join(shown, ",")))


@query("head_chapters", over("SELECT c.work_id, c.id, c.label_raw, r.title, c.position, c.head_revision_id AS revision_id FROM all_chapters c LEFT JOIN revisions r ON r.id = c.head_revision_id WHERE merged_into_chapter_id IS NULL AND deleted_at IS NULL"))
def head_chapters(spark, d):
    return J.head_chapters(*frames(spark, d, "all_chapters", "revisions"))


@query(
    "head_chapter",
    over("""SELECT c.id AS chapter_id, c.work_id, c.head_revision_id AS revision_id, c.label_raw, r.title, sha256(b.body) AS body, CASE WHEN b.body = '' THEN 0 ELSE len(string_split(b.body, chr(10) || chr(10))) END::INT AS paragraph_count, r.created_at AS updated_at
FROM all_chapters c JOIN revisions r ON r.id = c.head_revision_id LEFT JOIN bodies b ON b.content_key = r.content_key WHERE merged_into_chapter_id IS NULL AND deleted_at IS NULL"""),
)
def head_chapter(spark, d):
    out = J.head_chapter(*frames(spark, d, "all_chapters", "revisions", "bodies"))
    return out.withColumn("body", F.sha2("body", 256)).withColumn("paragraph_count", F.when(F.col("body").isNotNull(), F.col("paragraph_count")))


@query(
    "publish_preview",
    over("""WITH h AS (SELECT work_id, arg_max(id, version) AS release_id FROM releases GROUP BY work_id), base AS (SELECT h.work_id, i.chapter_id, i.revision_id FROM h JOIN release_items i ON i.release_id = h.release_id),
now AS (SELECT work_id, id AS chapter_id, head_revision_id AS revision_id FROM all_chapters WHERE merged_into_chapter_id IS NULL AND deleted_at IS NULL AND head_revision_id IS NOT NULL)
SELECT work_id, chapter_id, CASE WHEN b.revision_id IS NULL THEN 'new' WHEN n.revision_id IS NULL THEN 'removed' ELSE 'updated' END AS change FROM now n FULL JOIN base b USING (work_id, chapter_id) WHERE n.revision_id IS DISTINCT FROM b.revision_id"""),
)
def publish_preview(spark, d):
    """What a publish would change against the newest release, whether or not it is the active one."""
    releases, items, chapters = frames(spark, d, "releases", "release_items", "all_chapters")
    base = J.newest_release(releases).join(items, "release_id").select("work_id", "chapter_id", F.col("revision_id").alias("was"))
    now = J.active(chapters).where("head_revision_id IS NOT NULL").select("work_id", F.col("id").alias("chapter_id"), F.col("head_revision_id").alias("now"))
    both = now.join(base, ["work_id", "chapter_id"], "full").where("NOT now <=> was")
    return both.select("work_id", "chapter_id", F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").otherwise("updated").alias("change"))


@query(
    "export_versions",
    over("""SELECT id AS work_id, 0 AS nth, 'head' AS version_id, '草稿目前版本' AS label, 'head' AS kind, NULL::INT AS version, false AS active FROM works
UNION ALL SELECT r.work_id, row_number() OVER (PARTITION BY r.work_id ORDER BY version DESC)::INT, r.id::VARCHAR, 'v' || r.version || CASE WHEN r.id = w.active_release_id THEN '（目前發布）' ELSE '' END, 'release', r.version, coalesce(r.id = w.active_release_id, false)
FROM releases r JOIN works w ON w.id = r.work_id"""),
)
def export_versions(spark, d):
    return J.export_versions(*frames(spark, d, "works", "releases"))


@query(
    "import_job",
    "SELECT o_orderkey AS id, o_orderstatus AS status, p_name AS file_hash, p_size AS size_bytes, count(l_orderkey)::INT AS staged_chapters, (count(*) FILTER (l_returnflag = 'R'))::INT AS staged_needs_review, 3 AS max_attempts FROM orders LEFT JOIN (SELECT p_partkey, p_name, p_size FROM part) p ON p_partkey = o_orderkey % 3000 LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
)
def import_job(spark, d):
    jobs = frame(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3000).alias("source_file_id"))
    files = frame(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("file_hash"), F.col("p_size").alias("size_bytes"), F.lit("text/plain").alias("mime_type"))
    items = frame(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_returnflag") == "R").alias("needs_review"))
    return J.import_job(jobs, files, items).drop("source_file_id", "mime_type")


@query(
    "shelf_rows",
    over("""SELECT l.user_id, l.work_id, w.title, w.visibility, l.reading_status, l.group_name, p.chapter_id, p.paragraph_index, f.last_seen,
  (SELECT max(release_version) FROM events_of_release e WHERE e.work_id = l.work_id) AS latest_version, coalesce((SELECT sum(n_new) FROM events_of_release e WHERE e.work_id = l.work_id AND e.release_version > coalesce(f.last_seen, 0)), 0)::BIGINT AS new_chapters
FROM library l JOIN works w ON w.id = l.work_id LEFT JOIN progress p ON p.user_id = l.user_id AND p.work_id = l.work_id LEFT JOIN follows f ON f.user_id = l.user_id AND f.work_id = l.work_id"""),
)
def shelf_rows(spark, d):
    return J.shelf_rows(*frames(spark, d, "library", "works", "progress", "follows", "events_of_release")).drop("created_at", "updated_at")


CLAIMS = "SELECT o_custkey + CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS work_id, o_orderkey AS chapter_id, o_orderkey * 10 + CASE WHEN o_orderkey % 7 = 0 THEN 25 ELSE o_orderkey % 3 END AS revision_id FROM orders"
VIEWS["claims"] = CLAIMS


@query(
    "chapter_belongs",
    over("""SELECT k.work_id, k.chapter_id, k.revision_id FROM claims k JOIN revisions r ON r.id = k.revision_id AND r.chapter_id = k.chapter_id JOIN all_chapters c ON c.id = k.chapter_id AND c.work_id = k.work_id
WHERE c.merged_into_chapter_id IS NULL AND (c.deleted_at IS NULL OR EXISTS (SELECT 1 FROM release_items i JOIN works w ON w.active_release_id = i.release_id WHERE w.id = c.work_id AND i.chapter_id = c.id AND i.revision_id = k.revision_id))"""),
)
def chapter_belongs(spark, d):
    return J.belongs(*frames(spark, d, "claims", "revisions", "all_chapters", "works", "release_items"))


@query("resource_reachability", over("SELECT content_hash, EXISTS (SELECT 1 FROM links l JOIN release_items i ON i.revision_id = l.revision_id JOIN works w ON w.active_release_id = i.release_id WHERE l.content_hash = s.content_hash AND w.visibility IN ('public', 'unlisted') AND w.id % 10 = 1) AS publicly_reachable FROM resources s"))
def resource_reachability(spark, d):
    resources, links, items, works = frames(spark, d, "resources", "links", "release_items", "works")
    return J.reachability(resources, links, items, works.where("id % 10 = 1")).select("content_hash", "publicly_reachable")


REVIEW = f"""WITH r AS ({MATCH}), rows AS (SELECT r.work_id, r.class, s.position, r.item_id, NULL::BIGINT AS chapter_id, m.label_raw AS matched_chapter_label, class IN ('ambiguous', 'structural_conflict') OR (class = 'new' AND NOT position_confident) AS pending, 0 AS last
  FROM r JOIN source s USING (work_id, item_id) LEFT JOIN chapters m ON m.id = r.matched_chapter_id
  UNION ALL SELECT work_id, 'missing', position, NULL, id, NULL, false, 1 FROM existing e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.work_id = e.work_id AND r.matched_chapter_id = e.id)),
n AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY last, position, coalesce(item_id::VARCHAR, chapter_id::VARCHAR)) - 1 AS nth FROM rows),
p AS (SELECT *, count(*) OVER (PARTITION BY work_id) AS total, row_number() OVER (PARTITION BY work_id ORDER BY nth) - 1 AS place FROM n WHERE pending)
SELECT work_id, class, item_id, chapter_id, matched_chapter_label, nth::INT AS nth, total FROM p WHERE place BETWEEN 3 AND 5"""


@query("review_page", over(REVIEW))
def review_page(spark, d):
    existing, source, chapters = frames(spark, d, "existing", "source", "chapters")
    matched = I.match(existing, source)
    rows = J.review_rows(matched, I.missing(existing, matched), chapters)
    return J.review_page(rows, "pending", 2, 3).select("work_id", "class", "item_id", "chapter_id", "matched_chapter_label", "nth", "total")


@query("offset_next", "SELECT n_nationkey, n_name, CASE WHEN 25 > 17 THEN 17 END AS next_offset FROM nation ORDER BY n_name, n_nationkey LIMIT 10 OFFSET 7")
def offset_next(spark, d):
    return J.offset_page(frame(spark, d, "nation").select("n_nationkey", "n_name"), ["n_name", "n_nationkey"], 7, 10)


@query("taxonomy_count", over("SELECT 'categories' AS vocabulary, count(*) AS n, count(*) FILTER (is_active) AS active FROM categories UNION ALL SELECT 'tags', count(*), count(*) FILTER (is_active) FROM tags"))
def taxonomy_count(spark, d):
    each = [frame(spark, d, t).agg(F.count("*").alias("n"), F.count_if("is_active").alias("active")).select(F.lit(t).alias("vocabulary"), "n", "active") for t in ("categories", "tags")]
    return each[0].unionByName(each[1])


VERSION = flow.processor_version("txt")
VIEWS["staged"] = """SELECT l_orderkey AS job_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS position, 'Ch ' || CAST(l_linenumber AS VARCHAR(3)) AS label_raw,
  'T' || CAST(l_partkey AS VARCHAR(9)) AS title, 'k' || CAST(l_orderkey % 50 AS VARCHAR(9)) || '-' || CAST(l_partkey AS VARCHAR(9)) AS content_key, 'b' || CAST(l_suppkey AS VARCHAR(9)) AS body_hash FROM lineitem"""
VIEWS["commit_jobs"] = "SELECT o_orderkey AS job_id, o_orderkey + 7000000 - CASE WHEN o_orderkey % 10 = 0 THEN 7000000 ELSE 0 END AS work_id, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'ready' WHEN 1 THEN 'review_required' WHEN 2 THEN 'committed' ELSE 'processing' END AS status FROM orders"
TAKEN = "SELECT id AS work_id FROM works"
HASH = f"sha256(s.title || chr(10) || s.body_hash || chr(10) || '{VERSION}' || chr(10))"


@query(
    "first_commit",
    over(f"""WITH j AS (SELECT * FROM commit_jobs WHERE status IN ('ready', 'review_required') AND NOT EXISTS (SELECT 1 FROM works w WHERE w.id = work_id)),
s AS (SELECT j.work_id, st.*, sha256(j.work_id || '/' || st.position) AS chapter_id FROM staged st JOIN j ON j.job_id = st.job_id)
SELECT chapter_id AS id, work_id, label_raw, position, sha256(chapter_id || '/' || {HASH} || '/' || job_id) AS head_revision_id FROM s"""),
)
def first_commit(spark, d):
    jobs, staged, works = frames(spark, d, "commit_jobs", "staged", "works")
    return flow.first_commit(jobs, staged, works.select(F.col("id").alias("work_id")), VERSION)[0]


@query(
    "commit_outcome",
    over("""SELECT job_id, CASE WHEN outcome = 'committed' THEN 'committed' ELSE status END AS status, outcome FROM (SELECT *, CASE WHEN status = 'committed' THEN 'already_committed' WHEN status = 'processing' THEN 'not_committable'
  WHEN EXISTS (SELECT 1 FROM works w WHERE w.id = work_id) THEN 'work_not_empty' ELSE 'committed' END AS outcome FROM commit_jobs) t"""),
)
def commit_outcome(spark, d):
    jobs, staged, works = frames(spark, d, "commit_jobs", "staged", "works")
    return flow.first_commit(jobs, staged, works.select(F.col("id").alias("work_id")), VERSION)[2].select("job_id", "status", "outcome")


VIEWS["updates"] = "SELECT c.work_id, c.id AS item_id, CASE WHEN c.id % 3 = 0 THEN 'keep' ELSE 'update' END AS action, c.id AS chapter_id FROM chapters c WHERE c.id % 4 = 0"
VIEWS["update_items"] = "SELECT id AS item_id, id % 100 AS job_id, 'N' || label_raw AS title, 'k' || label_raw AS content_key, 'b' || label_raw AS body_hash FROM chapters"


@query(
    "overwrite_heads",
    over(f"""WITH u AS (SELECT p.chapter_id, sha256(p.chapter_id || '/' || {HASH} || '/' || s.job_id) AS rev FROM updates p JOIN update_items s ON s.item_id = p.item_id JOIN all_chapters c ON c.id = p.chapter_id WHERE action = 'update' AND c.merged_into_chapter_id IS NULL AND c.deleted_at IS NULL)
SELECT c.id, coalesce(u.rev, c.head_revision_id::VARCHAR) AS head_revision_id FROM all_chapters c LEFT JOIN u ON u.chapter_id = c.id"""),
)
def overwrite_heads(spark, d):
    return flow.overwrite(*frames(spark, d, "updates", "update_items", "all_chapters"), VERSION)[1].select("id", "head_revision_id")


@query(
    "reanalyze_bodies",
    over("""SELECT DISTINCT content_key FROM staged s WHERE job_id IN (SELECT job_id FROM commit_jobs WHERE job_id % 2 = 0 AND status IN ('ready', 'review_required', 'failed'))
  AND NOT EXISTS (SELECT 1 FROM staged o WHERE o.content_key = s.content_key AND o.job_id NOT IN (SELECT job_id FROM commit_jobs WHERE job_id % 2 = 0 AND status IN ('ready', 'review_required', 'failed'))) AND content_key NOT LIKE '%3'"""),
)
def reanalyze_bodies(spark, d):
    jobs, staged = frames(spark, d, "commit_jobs", "staged")
    needed = staged.where("content_key LIKE '%3'").select("content_key")
    return flow.reanalyze(jobs, staged, jobs.where("job_id % 2 = 0").select("job_id"), needed)[2]
