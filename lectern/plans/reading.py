"""A reader's state, bookmarks, references and settings, edits and retention over the analog tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import scalars as S
from lectern.operators import catalog as C
from lectern.operators import ingest as I
from lectern.operators import maintenance as M
from lectern.operators import projections as J
from lectern.operators import publishing as P
from lectern.operators import toc
from lectern.plans import operations as _jobs  # noqa: F401  # the view of jobs
from lectern.plans.analog import VIEWS, frame, over
from lectern.plans.projections import frames
from lectern.plans.registry import query

# An event is a bookmark of a chapter and its work, a session, a reset.
VIEWS["bookmarks"] = """SELECT e.event_id AS id, e.user_id, c.work_id, c.id AS chapter_id, CAST(e.event_id % 30 AS INT) AS paragraph_index, e.event_type AS note, e.ts AS created_at
FROM events e JOIN chapters c ON c.id = e.event_id % 3000"""
VIEWS["asked"] = "SELECT DISTINCT user_id, event_id % 1000 AS work_id FROM events"
UUID = "substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12)"
VIEWS["uuid_works"] = f"SELECT {UUID.format('CAST(id AS VARCHAR(9))')} AS id, id AS nr, title FROM works"
VIEWS["uuid_chapters"] = f"SELECT {UUID.format(chr(39) + 'c' + chr(39) + ' || CAST(c.id AS VARCHAR(9))')} AS id, {UUID.format('CAST(c.work_id AS VARCHAR(9))')} AS work_id, c.id AS nr, c.work_id AS work_nr FROM chapters c"


@query("reading_state", over("""SELECT a.user_id, a.work_id, EXISTS (SELECT 1 FROM library l WHERE l.user_id = a.user_id AND l.work_id = a.work_id) AS in_library, f.user_id IS NOT NULL AS following, f.last_seen AS last_seen_version,
  (SELECT max(version) FROM releases r WHERE r.work_id = a.work_id)::INT AS latest_version,
  CASE WHEN f.user_id IS NULL THEN 0 ELSE coalesce((SELECT sum(n_new) FROM events_of_release e WHERE e.work_id = a.work_id AND e.release_version > f.last_seen), 0) END::BIGINT AS new_chapter_count
FROM asked a LEFT JOIN follows f ON f.user_id = a.user_id AND f.work_id = a.work_id"""))
def reading_state(spark, d):
    return J.reading_state(*frames(spark, d, "asked", "library", "follows", "releases", "events_of_release"))


PAGE = """SELECT id, user_id, work_id, chapter_id, paragraph_index, note, created_at, title AS work_title, label_raw AS chapter_label, total, CASE WHEN 30 < total THEN 30 END AS next_offset
FROM (SELECT b.*, w.title, c.label_raw, count(*) OVER (PARTITION BY b.user_id)::INT AS total, row_number() OVER (PARTITION BY b.user_id ORDER BY b.created_at DESC, b.id DESC) AS nth FROM bookmarks b JOIN works w ON w.id = b.work_id JOIN chapters c ON c.id = b.chapter_id) t WHERE nth BETWEEN 11 AND 30"""


@query("bookmark_pages", over(PAGE))
def bookmark_pages(spark, d):
    """The second page of each reader."""
    return J.bookmark_pages(*frames(spark, d, "bookmarks", "works", "chapters"), limit=20, offset=10)


@query("bookmark_works", over("SELECT DISTINCT b.user_id, w.id, w.title FROM bookmarks b JOIN works w ON w.id = b.work_id"))
def bookmark_works(spark, d):
    return J.bookmark_works(*frames(spark, d, "bookmarks", "works"))


@query("resolve_works", over("SELECT nr, lower(replace(title, '#', '-')) || '-' || CASE WHEN nr % 3 = 0 THEN 'nothing' WHEN nr % 3 = 1 THEN left(id, 8) ELSE '' END AS segment, CASE WHEN nr % 3 = 1 THEN (SELECT min(o.id) FROM uuid_works o WHERE left(o.id, 8) = left(w.id, 8)) END AS work_id FROM uuid_works w UNION ALL SELECT nr, upper(id), id FROM uuid_works"))
def resolve_works(spark, d):
    """Slugs with a short id, with none, and whole ids."""
    works = frame(spark, d, "uuid_works")
    short = F.when(F.col("nr") % 3 == 0, "nothing").when(F.col("nr") % 3 == 1, S.public_id(F.col("id"))).otherwise("")
    refs = works.select("nr", F.concat(F.lower(F.replace("title", F.lit("#"), F.lit("-"))), F.lit("-"), short).alias("segment")).unionByName(works.select("nr", F.upper("id").alias("segment")))
    return C.resolve_works(refs, works)


@query("resolve_chapters", over("SELECT nr, CASE WHEN nr % 4 = 0 THEN id WHEN work_nr % 2 = 0 THEN (SELECT min(o.id) FROM uuid_chapters o WHERE o.work_id = c.work_id AND left(o.id, 8) = left(c.id, 8)) END AS chapter_id FROM uuid_chapters c"))
def resolve_chapters(spark, d):
    """Short ids under their work, under no work, and whole ids."""
    works, chapters = frames(spark, d, "uuid_works", "uuid_chapters")
    work = F.when(F.col("work_nr") % 2 == 0, F.concat(F.lit("a-title-"), S.public_id(F.col("work_id")))).otherwise("unknown")
    refs = chapters.select("nr", work.alias("work"), F.when(F.col("nr") % 4 == 0, F.col("id")).otherwise(F.concat(F.lit("ch-"), S.public_id(F.col("id")))).alias("segment"))
    return C.resolve_chapters(refs, works, chapters).select("nr", "chapter_id")


@query("review_targets", over("SELECT id, label_raw, position FROM all_chapters WHERE work_id = 7 AND merged_into_chapter_id IS NULL AND deleted_at IS NULL AND label_raw ILIKE '%cH_1%' ORDER BY position, id LIMIT 41"))
def review_targets(spark, d):
    return I.review_targets(frame(spark, d, "all_chapters"), 7, " cH_1 ")


RAW = """'{"v":' || CAST(c_custkey % 3 AS VARCHAR(9)) || ',"theme":"' || CASE c_custkey % 5 WHEN 0 THEN 'light' WHEN 1 THEN 'dark' WHEN 2 THEN 'pink' WHEN 3 THEN 'schedule' ELSE 'sepia' END || '","fontSize":' || CASE WHEN c_custkey % 7 = 0 THEN '"big"' ELSE CAST(c_custkey % 40 AS VARCHAR(9)) END || ',"lineHeight":"' || CAST(c_custkey % 4 AS VARCHAR(9)) || '","mode":"' || CASE WHEN c_custkey % 2 = 0 THEN 'paginated' ELSE 'page' END || '","conversion":"' || CASE c_custkey % 3 WHEN 0 THEN 't' WHEN 1 THEN 'cn' ELSE 'x' END || '","warmth":' || CAST(c_custkey % 6 AS VARCHAR(9)) || ',"nightFrom":' || CAST(c_custkey % 30 AS VARCHAR(9)) || '.' || CAST(c_custkey % 2 AS VARCHAR(9)) || ',"autoContinue":' || CASE WHEN c_custkey % 4 = 0 THEN 'true' ELSE '"true1"' END || '}'"""


@query("reader_choices", """SELECT c_custkey, CASE WHEN k = 0 OR k = 1 THEN CASE WHEN t = 0 THEN 'system' WHEN t = 1 THEN 'dark' WHEN t = 2 THEN 'system' WHEN t = 3 THEN 'schedule' ELSE 'sepia' END ELSE CASE t WHEN 0 THEN 'light' WHEN 1 THEN 'dark' WHEN 2 THEN 'system' WHEN 3 THEN 'schedule' ELSE 'sepia' END END AS theme,
  CASE WHEN c_custkey % 7 = 0 THEN 18 ELSE least(28, greatest(14, c_custkey % 40)) END::DOUBLE AS font_size, least(2.6, greatest(1.4, c_custkey % 4))::DOUBLE AS line_height, 0.9::DOUBLE AS spacing,
  CASE WHEN c_custkey % 2 = 0 THEN 'paginated' ELSE 'scroll' END AS mode, CASE c_custkey % 3 WHEN 0 THEN 't' WHEN 1 THEN 'cn' ELSE 'original' END AS conversion, CASE WHEN c_custkey % 6 <= 3 THEN c_custkey % 6 ELSE 0 END::INT AS warmth, 2::INT AS speed,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 30 <= 23 THEN c_custkey % 30 ELSE 19 END::INT AS night_from, 7::INT AS night_to, c_custkey % 4 = 0 AS auto_continue
FROM (SELECT *, c_custkey % 3 AS k, c_custkey % 5 AS t FROM customer) c""")
def reader_choices(spark, d):
    """Stored settings of every kind, known, unknown, out of range or no number."""
    s = frame(spark, d, "customer").select("c_custkey", S.settings(F.expr(RAW)).alias("s"))
    names = {"theme": "theme", "fontSize": "font_size", "lineHeight": "line_height", "paragraphSpacing": "spacing", "mode": "mode", "conversion": "conversion", "warmth": "warmth", "autoSpeed": "speed", "nightFrom": "night_from", "nightTo": "night_to", "autoContinue": "auto_continue"}
    return s.select("c_custkey", *[F.col(f"s.{a}").alias(b) for a, b in names.items()])


NOW = "TIMESTAMP '2024-02-20 00:00:00'"


@query("expired_sessions", f"SELECT event_id AS id FROM events WHERE ts + (event_id % 20) * INTERVAL 1 DAY < {NOW} - INTERVAL 30 DAY OR event_id % 3 = 0 AND ts < {NOW} - INTERVAL 30 DAY ORDER BY 1 LIMIT 5000")
def expired_sessions(spark, d):
    rows = frame(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 20).cast("int"))).alias("expires_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("revoked_at"))
    return M.expired_sessions(rows, F.expr(NOW)).select("id")


@query("spent_resets", f"SELECT event_id AS id FROM events WHERE ts + (event_id % 20) * INTERVAL 1 DAY < {NOW} - INTERVAL 25 DAY OR event_id % 3 = 0 AND ts < {NOW} - INTERVAL 25 DAY")
def spent_resets(spark, d):
    rows = frame(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 20).cast("int"))).alias("expires_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("used_at"))
    return M.spent_resets(rows, F.expr(NOW), 25).select("id")


VIEWS["edits"] = """SELECT id AS chapter_id, CASE WHEN id % 5 = 0 THEN id * 10 ELSE id * 10 + id % 3 END AS expected_revision_id, id * 10 + 7 AS new_revision_id, CASE WHEN id % 4 = 0 THEN 'New label' ELSE label_raw END AS label_raw,
  CASE WHEN id % 4 = 1 THEN 'New title' ELSE 'T' || CAST(id % 3 AS VARCHAR(3)) || '-' || volume END AS title, (id + id % 3) % 1500 AS content_key FROM chapters WHERE id % 2 = 0 OR id % 13 = 0
UNION ALL SELECT id + 100000000, 1, 2, 'x', 'y', 3 FROM chapters WHERE id % 1000 = 0"""
JUDGED = """SELECT e.chapter_id, e.new_revision_id, e.label_raw, c.work_id, CASE WHEN c.id IS NULL THEN 'chapter_not_found' WHEN r.id IS NULL THEN 'chapter_missing_revision' WHEN c.head_revision_id <> e.expected_revision_id THEN 'stale_chapter_revision'
  WHEN c.label_raw = e.label_raw AND r.title = e.title AND r.content_key = e.content_key THEN 'unchanged' ELSE 'applied' END AS outcome
FROM edits e LEFT JOIN all_chapters c ON c.id = e.chapter_id AND c.merged_into_chapter_id IS NULL AND c.deleted_at IS NULL LEFT JOIN revisions r ON r.id = c.head_revision_id"""


def edited(spark, d):
    return P.edit_chapters(*frames(spark, d, "works", "all_chapters", "revisions", "edits"))


@query("edit_outcomes", over(f"SELECT chapter_id, outcome FROM ({JUDGED}) j"))
def edit_outcomes(spark, d):
    return edited(spark, d)[0]


@query("edited_chapters", over(f"SELECT c.id, coalesce(j.label_raw, c.label_raw) AS label_raw, coalesce(j.new_revision_id, c.head_revision_id) AS head_revision_id, w.edit_version + (SELECT count(*) FROM ({JUDGED}) k WHERE k.outcome = 'applied' AND k.work_id = w.id)::INT AS edit_version FROM all_chapters c JOIN works w ON w.id = c.work_id LEFT JOIN ({JUDGED}) j ON j.chapter_id = c.id AND j.outcome = 'applied'"))
def edited_chapters(spark, d):
    """Labels, heads and the works' versions after the edits."""
    _, works, chapters, _ = edited(spark, d)
    return chapters.join(works.select(F.col("id").alias("work_id"), "edit_version"), "work_id").select("id", "label_raw", "head_revision_id", "edit_version")


SPLIT = 12


@query("split_positions", over(f"SELECT id, CASE WHEN work_id = (SELECT work_id FROM chapters WHERE id = {SPLIT}) AND position > (SELECT position FROM chapters WHERE id = {SPLIT}) THEN position + 1 ELSE position END AS position FROM chapters UNION ALL SELECT -1, position + 1 FROM chapters WHERE id = {SPLIT}"))
def split_positions(spark, d):
    """All chapters after one is cut in two."""
    chapters = frame(spark, d, "chapters")
    bodies = frame(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return P.split_chapter(chapters, bodies, SPLIT, -1, 2, "\n")[0].select("id", "position")


@query("split_bodies", f"SELECT doc_id AS id, sha256(CASE WHEN doc_id = {SPLIT} THEN array_to_string(string_split(text, chr(10))[1:2], chr(10)) ELSE text END) AS body FROM documents UNION ALL SELECT -1, sha256(array_to_string(string_split(text, chr(10))[3:], chr(10))) FROM documents WHERE doc_id = {SPLIT}")
def split_bodies(spark, d):
    chapters = frame(spark, d, "chapters")
    bodies = frame(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return P.split_chapter(chapters, bodies, SPLIT, -1, 2, "\n")[1].select("id", F.sha2("body", 256).alias("body"))


@query("soft_delete", over("SELECT id, work_id, CASE WHEN id = 12 AND deleted_at IS NULL AND (SELECT count(*) FROM all_chapters o WHERE o.work_id = c.work_id AND o.deleted_at IS NULL) > 1 THEN DATE '2025-01-01' ELSE deleted_at END AS deleted_at FROM all_chapters c"))
def soft_delete(spark, d):
    return P.soft_delete(frame(spark, d, "all_chapters"), 12, F.lit("2025-01-01").cast("date")).select("id", "work_id", "deleted_at")


@query("set_removed", over("SELECT id, CASE WHEN id = 41 THEN 'draft' ELSE visibility END AS visibility, CASE WHEN id = 41 THEN edit_version + 1 ELSE edit_version END AS edit_version FROM works"))
def set_removed(spark, d):
    """A removed work comes back as a draft; asked again, nothing happens."""
    once = P.set_removed(frame(spark, d, "works"), 41, False)
    return P.set_removed(once, 41, False).select("id", "visibility", "edit_version")


@query("page_json", over("SELECT work_id, '[' || string_agg('{\"id\":' || id || ',\"label_raw\":\"' || label_raw || '\",\"position\":' || position || '}', ',' ORDER BY position) || ']' AS chapters FROM (SELECT *, count(*) OVER (PARTITION BY work_id) AS total FROM chapters) t WHERE position > total - 4 GROUP BY work_id"))
def page_json(spark, d):
    """The last four chapters of each work as JSON."""
    return toc.page_json(toc.window(frame(spark, d, "chapters"), limit=4, latest=True), ["id", "label_raw", "position"])


IDS = "upper(id) || ' ,' || CASE WHEN nr % 4 = 0 THEN 'nothing' WHEN nr % 4 = 1 THEN '' ELSE id END || ', ' || substr(id, 1, 8) || '-0000-0000-0000-' || substr(id, 25, 12)"


@query("id_lists", over("SELECT nr, CASE WHEN nr % 4 <> 0 THEN least(id, left(id, 8) || '-0000-0000-0000-' || substring(id, 25, 12)) || '|' || greatest(id, left(id, 8) || '-0000-0000-0000-' || substring(id, 25, 12)) END AS ids, CASE nr % 6 WHEN 0 THEN 20 WHEN 1 THEN 1 WHEN 2 THEN 50 WHEN 3 THEN 20 WHEN 4 THEN 20 ELSE 7 END::DOUBLE AS size FROM uuid_works"))
def id_lists(spark, d):
    """What requests give as ids and page sizes, made whole or refused."""
    asked = F.get(F.array(*[F.lit(x) for x in (None, "-3", "400", "many", "0", "7")]), (F.col("nr") % 6).cast("int"))
    return frame(spark, d, "uuid_works").select("nr", F.array_join(S.id_list(F.expr(IDS)), "|").alias("ids"), S.page_size(asked).alias("size"))


VIEWS["leased"] = "SELECT id, status, CASE WHEN status = 'processing' THEN 'w' || CAST(id % 3 AS VARCHAR(3)) END AS lease_owner, lease_expires_at, CAST(NULL AS VARCHAR(30)) AS error_code FROM jobs"
VIEWS["lease_writes"] = "SELECT id AS job_id, 'w' || CAST(id % 2 AS VARCHAR(3)) AS owner, CASE id % 5 WHEN 0 THEN 'renew' WHEN 1 THEN 'retry' WHEN 2 THEN 'fail' WHEN 3 THEN 'renew' ELSE 'steal' END AS action, TIMESTAMP '2024-01-01 00:00:00' AS at FROM jobs WHERE id % 7 <> 0 UNION ALL SELECT -1, 'w0', 'renew', TIMESTAMP '2024-01-01 00:00:00'"
FENCED = "SELECT w.*, l.id AS id, CASE WHEN action = 'steal' THEN 'invalid' WHEN l.status = 'processing' AND l.lease_owner = w.owner THEN 'applied' ELSE 'lease_lost' END AS outcome FROM lease_writes w LEFT JOIN leased l ON l.id = w.job_id"


@query("lease_outcomes", over(f"SELECT job_id, owner, action, outcome FROM ({FENCED}) f"))
def lease_outcomes(spark, d):
    return M.fenced(*frames(spark, d, "leased", "lease_writes"))[0]


@query("leased_jobs", over(f"""SELECT l.id, CASE WHEN f.action = 'retry' THEN 'queued' WHEN f.action = 'fail' THEN 'failed' ELSE l.status END AS status, CASE WHEN f.action IS NULL OR f.action = 'renew' THEN l.lease_owner END AS lease_owner,
  CASE WHEN f.action = 'renew' THEN TIMESTAMP '2024-01-01 00:05:00' WHEN f.action IS NULL THEN l.lease_expires_at END AS lease_expires_at, CASE f.action WHEN 'retry' THEN 'processing_retry' WHEN 'fail' THEN 'processing_failed' END AS error_code
FROM leased l LEFT JOIN ({FENCED}) f ON f.id = l.id AND f.outcome = 'applied'"""))
def leased_jobs(spark, d):
    """The queue after the writes of those who own their lease."""
    return M.fenced(*frames(spark, d, "leased", "lease_writes"))[1]
