"""Rankings and reading statistics over the analog tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import activity as A
from lectern.plans.analog import frame, over
from lectern.plans.registry import query

AS_OF = "2024-01-20"
TAIPEI = "CAST(ts + INTERVAL 8 HOUR AS DATE)"
CLICKS = f"SELECT DISTINCT work_id, sha256(work_id || ':' || visitor) AS visitor_hash, {TAIPEI} AS day FROM clicks"
LISTED = "visibility = 'public' AND active_release_id IS NOT NULL"


@query("click_dedupe", over(CLICKS))
def click_dedupe(spark, d):
    return A.click_rows(frame(spark, d, "clicks"))


def ranked(name: str, period: str, bound: str):
    sql = f"SELECT id, title, count(*) AS score FROM works JOIN ({CLICKS}) c ON c.work_id = id WHERE {LISTED} {bound} GROUP BY id, title ORDER BY score DESC, title, id LIMIT 50"

    @query(name, over(sql))
    def run(spark, d):
        return A.click_ranking(frame(spark, d, "clicks"), frame(spark, d, "works"), AS_OF, period).select("id", "title", "score")


ranked("ranking_clicks_week", "week", f"AND day >= DATE '{AS_OF}' - 6")
ranked("ranking_clicks_month", "month", f"AND day >= DATE '{AS_OF}' - 29")
ranked("ranking_clicks_all", "all", "")


@query("ranking_favourites_week", over(f"SELECT id, title, count(*) AS score FROM works JOIN library l ON l.work_id = id WHERE {LISTED} AND CAST(created_at + INTERVAL 8 HOUR AS DATE) >= DATE '{AS_OF}' - 6 GROUP BY id, title ORDER BY score DESC, title, id LIMIT 50"))
def ranking_favourites_week(spark, d):
    return A.favourite_ranking(frame(spark, d, "library"), frame(spark, d, "works"), AS_OF).select("id", "title", "score")


@query("ranking_in_category", over(f"SELECT id, title, count(*) AS score FROM works JOIN ({CLICKS}) c ON c.work_id = id WHERE {LISTED} AND EXISTS (SELECT 1 FROM work_categories w JOIN categories k ON w.category_id = k.id AND is_active WHERE w.work_id = works.id AND category_id = 7) GROUP BY id, title ORDER BY score DESC, title, id LIMIT 50"))
def ranking_in_category(spark, d):
    works = A.in_category(frame(spark, d, "works"), frame(spark, d, "work_categories"), frame(spark, d, "categories"), 7)
    return A.click_ranking(frame(spark, d, "clicks"), works, AS_OF, "all").select("id", "title", "score")


ACTIVITY = "SELECT user_id, CAST(ts AS DATE) AS activity_date, least(86400, sum(seconds))::BIGINT AS active_seconds FROM heartbeats GROUP BY 1, 2"


@query("capped_activity", over(ACTIVITY))
def capped_activity(spark, d):
    return A.capped_seconds(frame(spark, d, "heartbeats"))


@query("reading_totals", over(f"SELECT (SELECT count(DISTINCT chapter_id) FROM reads WHERE user_id = 7 AND work_id IN (SELECT id FROM works WHERE visibility NOT IN ('removed', 'draft'))) AS chapters, (SELECT count(DISTINCT work_id) FROM reads WHERE user_id = 7 AND work_id IN (SELECT id FROM works WHERE visibility NOT IN ('removed', 'draft'))) AS works, (SELECT coalesce(sum(active_seconds), 0)::BIGINT FROM ({ACTIVITY}) a WHERE user_id = 7) AS seconds"))
def reading_totals(spark, d):
    return A.reading_totals(A.visible_reads(frame(spark, d, "reads"), frame(spark, d, "works")), A.capped_seconds(frame(spark, d, "heartbeats")), 7)


@query("reading_recent", over("SELECT work_id, chapter_id, chapters, last_read_at FROM (SELECT *, count(*) OVER (PARTITION BY work_id) AS chapters, row_number() OVER (PARTITION BY work_id ORDER BY last_read_at DESC, chapter_id) AS nth FROM reads WHERE user_id = 7 AND work_id IN (SELECT id FROM works WHERE visibility NOT IN ('removed', 'draft'))) t WHERE nth = 1 ORDER BY last_read_at DESC, work_id LIMIT 20"))
def reading_recent(spark, d):
    return A.recent_works(A.visible_reads(frame(spark, d, "reads"), frame(spark, d, "works")), 7)


CALENDAR = f"""SELECT day, sum(chapters)::BIGINT AS chapters, sum(seconds)::BIGINT AS seconds FROM (
  SELECT CAST(first_read_at AS DATE) AS day, 1 AS chapters, 0 AS seconds FROM reads WHERE user_id = 7 AND work_id IN (SELECT id FROM works WHERE visibility NOT IN ('removed', 'draft'))
  UNION ALL SELECT activity_date, 0, active_seconds FROM ({ACTIVITY}) a WHERE user_id = 7) u
WHERE day BETWEEN DATE '{AS_OF}' - 364 AND DATE '{AS_OF}' GROUP BY day"""


@query("reading_calendar", over(CALENDAR))
def reading_calendar(spark, d):
    return A.calendar(A.visible_reads(frame(spark, d, "reads"), frame(spark, d, "works")), A.capped_seconds(frame(spark, d, "heartbeats")), 7, AS_OF)


@query("reading_heat", over(f"SELECT day, CASE WHEN w <= 0 THEN 0 WHEN w <= 2 THEN 1 WHEN w <= 5 THEN 2 WHEN w <= 9 THEN 3 ELSE 4 END AS level FROM (SELECT day, chapters + floor(seconds / 600) AS w FROM ({CALENDAR}) c) t"))
def reading_heat(spark, d):
    return reading_calendar(spark, d).select("day", A.heat(F.col("chapters"), F.col("seconds")).alias("level"))


@query("reads_minmax", "SELECT user_id, event_id % 500 AS chapter_id, min(ts) AS first_read_at, max(ts) AS last_read_at FROM events GROUP BY ALL")
def reads_minmax(spark, d):
    return A.read_marks(frame(spark, d, "events").withColumn("chapter_id", F.col("event_id") % 500))


@query("session_batch", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 90 SECOND THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS nr FROM g) SELECT user_id, count(*) AS beats, min(ts) AS began, max(ts) AS ended FROM s GROUP BY user_id, nr")
def session_batch(spark, d):
    return A.sessions(frame(spark, d, "events"))


@query("shelf_page", over("SELECT work_id, reading_status, group_name, updated_at FROM library WHERE user_id = 7 AND (updated_at < TIMESTAMP '2024-01-15 00:00:00' OR (updated_at = TIMESTAMP '2024-01-15 00:00:00' AND work_id > 5)) ORDER BY updated_at DESC, work_id LIMIT 21"))
def shelf_page(spark, d):
    return A.shelf(frame(spark, d, "library"), 7, after=("2024-01-15 00:00:00", 5)).select("work_id", "reading_status", "group_name", "updated_at")


@query("shelf_ungrouped", over("SELECT work_id, reading_status FROM library WHERE user_id = 7 AND group_name IS NULL AND reading_status = 'reading' ORDER BY updated_at DESC, work_id LIMIT 51"))
def shelf_ungrouped(spark, d):
    return A.shelf(frame(spark, d, "library"), 7, status="reading", group="", limit=50).select("work_id", "reading_status")


@query("shelf_groups", over("SELECT DISTINCT group_name FROM library WHERE user_id = 7 AND group_name IS NOT NULL"))
def shelf_groups(spark, d):
    return A.shelf_groups(frame(spark, d, "library"), 7)


@query("unseen_updates", over("""SELECT f.user_id, f.work_id, f.last_seen, coalesce(sum(n_new), 0)::BIGINT AS new_chapters, greatest(coalesce(max(release_version), 0), f.last_seen)::INT AS latest_version,
  greatest(coalesce(max(release_version), 0), f.last_seen) > f.last_seen AS has_update
FROM follows f LEFT JOIN events_of_release r ON f.work_id = r.work_id AND r.release_version > f.last_seen GROUP BY f.user_id, f.work_id, f.last_seen"""))
def unseen_updates(spark, d):
    return A.unseen(frame(spark, d, "follows"), frame(spark, d, "events_of_release"))


@query("update_badge", over("SELECT f.user_id, count(DISTINCT f.work_id) FILTER (r.work_id IS NOT NULL) AS badge FROM follows f LEFT JOIN events_of_release r ON f.work_id = r.work_id AND r.release_version > f.last_seen GROUP BY f.user_id"))
def update_badge(spark, d):
    return unseen_updates(spark, d).groupBy("user_id").agg(F.count_if("has_update").alias("badge"))


@query("night_window", "SELECT event_id FROM events WHERE hour(ts) >= 19 OR hour(ts) < 7")
def night_window(spark, d):
    from lectern.functions.scalars import is_night

    return frame(spark, d, "events").where(is_night(F.hour("ts"), 19, 7)).select("event_id")


@query("seen_marker", over("SELECT f.user_id, f.work_id, least(f.last_seen + 5, (SELECT max(release_version) FROM events_of_release r WHERE r.work_id = f.work_id))::INT AS seen FROM follows f WHERE EXISTS (SELECT 1 FROM events_of_release r WHERE r.work_id = f.work_id)"))
def seen_marker(spark, d):
    """A reader can't have seen more than there is."""
    newest = frame(spark, d, "events_of_release").groupBy("work_id").agg(F.max("release_version").alias("newest"))
    return frame(spark, d, "follows").join(newest, "work_id").select("user_id", "work_id", A.mark_seen(F.col("last_seen") + 5, F.col("newest")).cast("int").alias("seen"))
