"""Import quality, matching, merging and publishing over the analog tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import ingest as I
from lectern.operators import publishing as P
from lectern.plans.analog import VIEWS, frame, over
from lectern.plans.registry import query

# A line item is an item of its order's import; a part stands for its label and body.
VIEWS["items"] = """SELECT l_orderkey AS job_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS position, l_returnflag AS volume, 'ch' || CAST(l_partkey % 6 AS VARCHAR(3)) AS label_key, 'ch' AS family,
  CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_partkey % 30 AS INT) END AS number,
  CASE WHEN l_suppkey % 10 = 0 THEN 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855' ELSE CAST(l_suppkey % 20 AS VARCHAR(3)) END AS body_hash
FROM lineitem"""
# Chapters of a work, and an import of it that shares most labels.
VIEWS["existing"] = """SELECT work_id, id, 'k' || CAST(id % 23 AS VARCHAR(3)) AS label_key, position, 'b' || CAST(id % 40 AS VARCHAR(3)) AS body_hash, CAST(id % 2 AS VARCHAR(3)) AS resource_digest FROM chapters WHERE id % 4 <> 1"""
VIEWS["source"] = """SELECT work_id, id AS item_id, 'k' || CAST(id % 23 AS VARCHAR(3)) AS label_key, CAST(CASE WHEN id % 9 = 0 THEN position + 3 ELSE position END AS INT) AS position,
  'b' || CAST(CASE WHEN id % 5 = 0 THEN id % 41 ELSE id % 40 END AS VARCHAR(3)) AS body_hash, CAST(id % 3 % 2 AS VARCHAR(3)) AS resource_digest FROM chapters WHERE id % 4 <> 2"""

QUALITY = """SELECT job_id, 'empty' AS type, position AS finding, position FROM items WHERE body_hash = 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855'
UNION ALL SELECT job_id, 'duplicate_label', finding, position FROM (SELECT *, count(*) OVER w AS n, min(position) OVER w AS finding FROM items WHERE label_key IS NOT NULL WINDOW w AS (PARTITION BY job_id, volume, label_key)) t WHERE n > 1
UNION ALL SELECT job_id, 'duplicate_body', finding, position FROM (SELECT *, count(*) OVER w AS n, min(position) OVER w AS finding FROM items WHERE body_hash <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855' WINDOW w AS (PARTITION BY job_id, body_hash)) t WHERE n > 1
UNION ALL SELECT job_id, 'gap', lp, u.position FROM (SELECT *, lag(position) OVER w AS lp, lag(volume) OVER w AS lv, lag(family) OVER w AS lf, lag(number) OVER w AS ln FROM items WHERE number BETWEEN 1 AND 1000000 WINDOW w AS (PARTITION BY job_id ORDER BY position)) t, unnest([lp, t.position]) AS u(position)
  WHERE volume = lv AND family = lf AND number > ln + 1"""


@query("import_quality", over(QUALITY))
def import_quality(spark, d):
    return I.quality(frame(spark, d, "items"))


@query("duplicate_bodies", "SELECT sha256(text) AS body_hash, doc_id FROM documents WHERE text <> '' AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1)")
def duplicate_bodies(spark, d):
    """A row a copy: a group of very many is no row of its own."""
    docs = frame(spark, d, "documents").where("text <> ''").select(F.sha2("text", 256).alias("body_hash"), "doc_id")
    return docs.join(docs.groupBy("body_hash").agg(F.count("*").alias("n")).where("n > 1"), "body_hash", "left_semi")


MATCH = """WITH ek AS (SELECT *, count(*) OVER (PARTITION BY work_id, label_key) AS eu FROM existing),
sk AS (SELECT *, count(*) OVER (PARTITION BY work_id, label_key) AS su FROM source),
j AS (SELECT s.*, coalesce(e1.eu, 0) AS eu, CASE WHEN s.su = 1 THEN e2.id END AS mid, CASE WHEN s.su = 1 THEN e2.position END AS mpos, e2.body_hash AS eh, e2.resource_digest AS ed
  FROM sk s LEFT JOIN (SELECT DISTINCT work_id, label_key, eu FROM ek) e1 ON s.work_id = e1.work_id AND s.label_key = e1.label_key
  LEFT JOIN ek e2 ON s.work_id = e2.work_id AND s.label_key = e2.label_key AND e2.eu = 1),
loose AS (SELECT * FROM existing e WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.work_id = e.work_id AND j.mid = e.id)),
c AS (SELECT j.*, CASE WHEN mid IS NOT NULL THEN CASE WHEN body_hash = eh AND resource_digest = ed THEN 'unchanged' WHEN body_hash = eh THEN 'modified'
     WHEN EXISTS (SELECT 1 FROM existing o WHERE o.work_id = j.work_id AND o.body_hash = j.body_hash AND o.id <> j.mid) THEN 'structural_conflict' ELSE 'modified' END
   WHEN label_key IS NOT NULL AND (eu > 1 OR su > 1) THEN 'ambiguous'
   WHEN (SELECT count(*) FROM loose l WHERE l.work_id = j.work_id AND l.body_hash = j.body_hash) = 1 THEN 'ambiguous' ELSE 'new' END AS c1 FROM j),
p AS (SELECT *, last_value(CASE WHEN mid IS NOT NULL THEN mpos END IGNORE NULLS) OVER w1 AS bp, last_value(mid IGNORE NULLS) OVER w1 AS bid,
   first_value(CASE WHEN mid IS NOT NULL THEN mpos END IGNORE NULLS) OVER w2 AS ap, first_value(mid IGNORE NULLS) OVER w2 AS aid FROM c
   WINDOW w1 AS (PARTITION BY work_id ORDER BY position, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY work_id ORDER BY position, item_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
m AS (SELECT *, c1 = 'new' AS is_new, (SELECT count(*) FROM loose l WHERE l.work_id = p.work_id AND l.position < coalesce(ap, 2147483647)) - (SELECT count(*) FROM loose l WHERE l.work_id = p.work_id AND l.position < bp) AS inside FROM p)
SELECT work_id, item_id, CASE WHEN is_new AND bp IS NOT NULL AND inside > 0 OR mid IS NOT NULL AND bp > mpos THEN 'structural_conflict' ELSE c1 END AS class, mid AS matched_chapter_id,
  CASE WHEN is_new AND NOT (ap IS NULL AND inside > 0) THEN bid END AS insert_after_id, CASE WHEN is_new THEN aid END AS insert_before_id,
  is_new AND (bp IS NOT NULL OR ap IS NOT NULL) AND NOT (bp IS NOT NULL AND inside > 0) AS position_confident FROM m"""


@query("match_chapters", over(MATCH))
def match_chapters(spark, d):
    return I.match(frame(spark, d, "existing"), frame(spark, d, "source")).drop("position")


@query("match_missing", over(f"WITH r AS ({MATCH}) SELECT work_id, id FROM existing e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.work_id = e.work_id AND r.matched_chapter_id = e.id)"))
def match_missing(spark, d):
    return I.missing(frame(spark, d, "existing"), match_chapters(spark, d)).select("work_id", "id")


@query("match_histogram", over(f"WITH r AS ({MATCH}) SELECT c.class, count(r.class) AS n FROM (VALUES ('unchanged'), ('modified'), ('new'), ('ambiguous'), ('structural_conflict')) c(class) LEFT JOIN r ON r.class = c.class GROUP BY c.class"))
def match_histogram(spark, d):
    return I.histogram(match_chapters(spark, d))


@query("match_needs_review", over(f"WITH r AS ({MATCH}) SELECT work_id, bool_or(class IN ('ambiguous', 'structural_conflict') OR (class = 'new' AND NOT position_confident)) AS needs_review FROM r GROUP BY work_id"))
def match_needs_review(spark, d):
    return I.needs_review(match_chapters(spark, d))


@query(
    "apply_summary",
    over(f"""WITH r AS ({MATCH}), d AS (SELECT *, CASE WHEN item_id % 10 = 0 THEN 'exclude' WHEN item_id % 10 = 3 THEN 'new' END AS choice FROM r),
t AS (SELECT *, CASE WHEN choice IS NULL AND class IN ('unchanged', 'modified') THEN matched_chapter_id END AS chapter_id FROM d),
a AS (SELECT *, CASE WHEN choice = 'exclude' THEN 'skip' WHEN choice = 'new' THEN 'add' WHEN chapter_id IS NOT NULL THEN CASE WHEN class = 'unchanged' THEN 'keep' ELSE 'update' END WHEN class = 'new' AND position_confident THEN 'add' ELSE 'unresolved' END AS action FROM t),
m AS (SELECT work_id, count(*) AS n FROM existing e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.work_id = e.work_id AND r.matched_chapter_id = e.id) GROUP BY work_id)
SELECT a.work_id, count(*) FILTER (action = 'add') AS added, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'keep' AND class = 'unchanged') AS unchanged,
  count(*) FILTER (action = 'keep' AND class <> 'unchanged') AS modified_kept, count(*) FILTER (action = 'skip') AS skipped, coalesce(max(m.n), 0) AS missing_kept
FROM a LEFT JOIN m ON a.work_id = m.work_id GROUP BY a.work_id"""),
)
def apply_summary(spark, d):
    m = I.match(frame(spark, d, "existing"), frame(spark, d, "source"))
    choice = F.when(F.col("item_id") % 10 == 0, "exclude").when(F.col("item_id") % 10 == 3, "new")
    picks = frame(spark, d, "source").select("work_id", "item_id", choice.alias("choice"), F.lit(None).cast("bigint").alias("target")).where("choice IS NOT NULL")
    return I.summary(I.decide(m, picks, "overwrite"), I.missing(frame(spark, d, "existing"), m))


@query(
    "merge_order",
    over("""SELECT work_id, chapter_id, item_id, row_number() OVER (PARTITION BY work_id ORDER BY anchor, rank, nth)::INT AS position FROM (
  SELECT work_id, id AS chapter_id, NULL::VARCHAR AS item_id, position::BIGINT AS anchor, 0 AS rank, 0 AS nth FROM chapters WHERE id % 3 <> 0
  UNION ALL SELECT a.work_id, NULL, a.id::VARCHAR, coalesce(e.position, 2147483648), 1, a.position FROM chapters a LEFT JOIN chapters e ON e.work_id = a.work_id AND e.id = a.id - 1 AND e.id % 3 <> 0 WHERE a.id % 3 = 0) t"""),
)
def merge_order(spark, d):
    c = frame(spark, d, "chapters")
    added = c.where("id % 3 = 0").select("work_id", F.col("id").alias("item_id"), "position", (F.col("id") - 1).alias("insert_after_id"))
    return I.merge_order(c.where("id % 3 <> 0"), added)


@query(
    "renumber_reserved",
    over("""WITH r AS (SELECT work_id, id, row_number() OVER (PARTITION BY work_id ORDER BY position, id) AS k FROM chapters WHERE id % 5 <> 0),
f AS (SELECT work_id, s, row_number() OVER (PARTITION BY work_id ORDER BY s) AS k FROM (SELECT DISTINCT work_id FROM r), unnest(range(1, 200)) u(s) WHERE NOT EXISTS (SELECT 1 FROM chapters c WHERE c.work_id = r.work_id AND c.position = s AND c.id % 5 = 0))
SELECT r.work_id, r.id, f.s::INT AS position FROM r JOIN f ON r.work_id = f.work_id AND r.k = f.k""".replace("c.work_id = r.work_id", "c.work_id = q.work_id").replace("(SELECT DISTINCT work_id FROM r),", "(SELECT DISTINCT work_id FROM r) q,")),
)
def renumber_reserved(spark, d):
    c = frame(spark, d, "chapters")
    return I.renumber(c.where("id % 5 <> 0"), c.where("id % 5 = 0"))


DIFF = """SELECT coalesce(c.work_id, p.work_id) AS work_id, coalesce(c.chapter_id, p.chapter_id) AS chapter_id,
  CASE WHEN p.chapter_id IS NULL THEN 'new' WHEN c.chapter_id IS NULL THEN 'removed' WHEN c.revision_id <> p.revision_id THEN 'updated' WHEN c.position <> p.position THEN 'reordered' END AS change
FROM release_now c FULL JOIN release_before p ON c.work_id = p.work_id AND c.chapter_id = p.chapter_id"""


@query("release_diff", over(f"SELECT * FROM ({DIFF}) t WHERE change IS NOT NULL"))
def release_diff(spark, d):
    return P.release_diff(frame(spark, d, "release_now"), frame(spark, d, "release_before"))


@query("release_diff_counts", over(f'SELECT work_id, count(*) FILTER (change = \'new\') AS new, count(*) FILTER (change = \'updated\') AS updated, count(*) FILTER (change = \'reordered\') AS reordered, count(*) FILTER (change = \'removed\') AS removed FROM ({DIFF}) t WHERE change IS NOT NULL GROUP BY work_id'))
def release_diff_counts(spark, d):
    return P.diff_counts(release_diff(spark, d))


@query(
    "publish_problems",
    over("""SELECT w.id, concat_ws(',', CASE WHEN title IS NULL OR trim(title) = '' THEN 'title' END, CASE WHEN work_type NOT IN ('serial', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE') OR work_type IS NULL THEN 'work_type' END, CASE WHEN work_type = 'serial' AND serial_status IS NULL THEN 'serial_status' END,
  CASE WHEN visibility = 'removed' THEN 'removed' END, CASE WHEN coalesce(n, 0) = 0 THEN 'no_chapters' END, CASE WHEN h > 0 THEN 'missing_revisions:' || h END, CASE WHEN b > 0 THEN 'missing_objects:' || b END, CASE WHEN w.id % 8 = 0 THEN 'missing_resources:' || CASE WHEN w.id % 16 = 0 THEN 2 ELSE 1 END END,
  CASE WHEN NOT EXISTS (SELECT 1 FROM work_categories x JOIN categories k ON k.id = x.category_id AND k.is_active WHERE x.work_id = w.id) THEN 'no_category' END) AS problems
FROM (SELECT id, title, CASE WHEN work_type = 'BUILDING' THEN 'serial' ELSE work_type END AS work_type, serial_status, visibility FROM works) w
LEFT JOIN (SELECT work_id, count(*) AS n, count(*) FILTER (id % 50 = 0) AS h, count(*) FILTER (id % 50 <> 0 AND id % 30 = 0) AS b FROM chapters WHERE id % 11 <> 0 GROUP BY work_id) c ON c.work_id = w.id"""),
)
def publish_problems(spark, d):
    works = frame(spark, d, "works").withColumn("work_type", F.when(F.col("work_type") == "BUILDING", "serial").otherwise(F.col("work_type")))
    chapters = frame(spark, d, "chapters").withColumn("head_revision_id", F.when(F.col("id") % 50 != 0, F.col("id"))).withColumn("body_key", F.when(F.col("id") % 30 != 0, F.col("id")))
    live = frame(spark, d, "work_categories").join(frame(spark, d, "categories").where("is_active").select(F.col("id").alias("category_id")), "category_id", "left_semi")
    chapters = chapters.withColumn("deleted_at", F.when(F.col("id") % 11 == 0, F.current_timestamp()))
    key = F.when(F.col("id") % 8 != 0, F.lit("k"))
    images = works.select(F.col("id").alias("work_id"), F.lit("a").alias("content_hash"), key.alias("storage_key")).union(works.where("id % 16 = 0").select("id", F.lit("b"), F.lit(None).cast("string")))
    return P.problems(works, chapters, live, images, ("serial", "MACHINERY", "HOUSEHOLD", "FURNITURE")).select("id", F.array_join("problems", ",").alias("problems"))


@query(
    "publish_release",
    over("""WITH v AS (SELECT work_id, max(release_version) AS version FROM events_of_release WHERE work_id % 2 = 0 GROUP BY work_id)
SELECT c.work_id, (coalesce(max(v.version), 0) + 1)::INT AS version, count(*)::INT AS chapter_count FROM chapters c LEFT JOIN v ON v.work_id = c.work_id WHERE c.work_id % 3 = 0 GROUP BY c.work_id"""),
)
def publish_release(spark, d):
    return published(spark, d)[0]


def published(spark, d):
    chapters = frame(spark, d, "chapters").withColumn("head_revision_id", F.col("id") % 13).withColumn("title", F.col("label_raw"))
    releases = frame(spark, d, "events_of_release").where("work_id % 2 = 0").select("work_id", F.col("release_version").alias("version"))
    return P.publish(frame(spark, d, "works").where("id % 3 = 0"), chapters, releases, frame(spark, d, "release_before"))


NEXT = "SELECT w.work_id, coalesce(v.version, 0) + 1 AS version FROM (SELECT DISTINCT work_id FROM chapters WHERE work_id % 3 = 0) w LEFT JOIN (SELECT work_id, max(release_version) AS version FROM events_of_release WHERE work_id % 2 = 0 GROUP BY work_id) v ON v.work_id = w.work_id"


@query("publish_items", over(f"SELECT c.work_id, n.version::INT AS version, c.id AS chapter_id, c.id % 13 AS revision_id, c.position, c.label_raw, c.label_raw AS title FROM chapters c JOIN ({NEXT}) n ON n.work_id = c.work_id"))
def publish_items(spark, d):
    return published(spark, d)[1]


@query(
    "publish_events",
    over(f"""SELECT n.work_id, n.version::INT AS version, coalesce(string_agg(c.id, ',' ORDER BY c.id) FILTER (b.chapter_id IS NULL), '') AS new_ids, coalesce(string_agg(c.id, ',' ORDER BY c.id) FILTER (b.revision_id <> c.id % 13), '') AS updated_ids
FROM ({NEXT}) n JOIN chapters c ON c.work_id = n.work_id LEFT JOIN release_before b ON b.work_id = c.work_id AND b.chapter_id = c.id GROUP BY ALL"""),
)
def publish_events(spark, d):
    ids = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("")).alias(c)
    return published(spark, d)[2].select("work_id", "version", ids("new_ids"), ids("updated_ids"))


@query("merge_candidates", over("SELECT id, next_id FROM (SELECT id, volume, lead(id) OVER w AS next_id, lead(volume) OVER w AS nv FROM chapters WINDOW w AS (PARTITION BY work_id ORDER BY position, id)) t WHERE next_id IS NOT NULL AND volume = nv AND NOT EXISTS (SELECT 1 FROM release_now r WHERE r.chapter_id IN (t.id, t.next_id) AND r.chapter_id % 2 = 0)"))
def merge_candidates(spark, d):
    c = frame(spark, d, "chapters").select("work_id", "id", "position", F.col("volume").alias("volume_id"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(None).cast("bigint").alias("merged_into_chapter_id"))
    used = frame(spark, d, "release_now").where("chapter_id % 2 = 0")
    return P.can_merge(c, used, used.limit(0))


@query(
    "revert_import",
    over("""WITH a AS (SELECT work_id, id AS chapter_id, CASE WHEN id % 2 = 0 THEN id % 13 END AS prev, id % 13 + 100 AS new FROM chapters WHERE id % 3 = 0),
locked AS (SELECT DISTINCT work_id FROM a WHERE work_id % 5 = 0 OR work_id % 7 = 0)
SELECT c.work_id, c.id, row_number() OVER (PARTITION BY c.work_id ORDER BY c.position, c.id)::INT AS position, CASE WHEN a.chapter_id IS NOT NULL THEN a.prev ELSE c.id % 13 + 100 END AS head_revision_id
FROM chapters c LEFT JOIN a ON a.chapter_id = c.id AND a.work_id NOT IN (SELECT work_id FROM locked) WHERE a.chapter_id IS NULL OR a.prev IS NOT NULL"""),
)
def revert_import(spark, d):
    c = frame(spark, d, "chapters")
    applied = c.where("id % 3 = 0").select("work_id", F.col("id").alias("chapter_id"), F.when(F.col("id") % 2 == 0, F.col("id") % 13).alias("previous_revision_id"), (F.col("id") % 13 + 100).alias("new_revision_id"))
    released = applied.where("work_id % 5 = 0").select("work_id", F.col("new_revision_id").alias("revision_id"))
    # works edited since the import
    edits = c.select("work_id", F.lit(4).alias("applied_version"), F.when(F.col("work_id") % 7 == 0, 5).otherwise(4).alias("edit_version")).distinct()
    return I.revert(c.withColumn("head_revision_id", F.col("id") % 13 + 100), applied, released, edits)


@query("resource_digest", "SELECT l_orderkey, sha256(string_agg(l_partkey || ':' || l_returnflag, chr(10) ORDER BY l_partkey || ':' || l_returnflag)) AS resource_digest FROM lineitem GROUP BY l_orderkey")
def resource_digest(spark, d):
    links = frame(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("content_hash"), F.col("l_returnflag").alias("alt"))
    return P.resource_digest(links, "l_orderkey")


@query("upsert_latest", over("SELECT user_id, work_id, reading_status FROM (SELECT * FROM library WHERE NOT (user_id % 2 = 0) UNION ALL SELECT user_id, work_id, created_at, updated_at, 'want', group_name FROM library WHERE user_id % 2 = 0) t"))
def upsert_latest(spark, d):
    lib = frame(spark, d, "library")
    return P.upsert(lib, lib.where("user_id % 2 = 0").withColumn("reading_status", F.lit("want")), ["user_id", "work_id"], "updated_at").select("user_id", "work_id", "reading_status")
