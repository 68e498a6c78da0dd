"""Catalog queries over the analog tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import catalog as C
from lectern.plans.analog import frame, over
from lectern.plans.registry import query

TERMS = ("categories", "work_categories", "tags", "work_tags", "library")
LISTED = "visibility = 'public' AND active_release_id IS NOT NULL"
SHOWN = "id, title, work_type, serial_status"


def found(spark, d, f: C.Filter):
    return C.matching(f, frame(spark, d, "works"), **{t: frame(spark, d, t) for t in TERMS})


def shown(df):
    return df.select("id", "title", "work_type", "serial_status")


def simple(name: str, f: C.Filter, condition: str):
    """Registers the list of works under ``f`` (all of it), which SQL gives by ``condition``."""

    @query(name, over(f"SELECT {SHOWN} FROM works WHERE {LISTED} AND {condition}"))
    def run(spark, d):
        return shown(found(spark, d, f))


simple("catalog_listed", C.Filter(), "true")
simple("catalog_type", C.Filter(work_type="BUILDING"), "work_type = 'BUILDING'")
simple("catalog_status_in", C.Filter(statuses=("ongoing", "paused")), "serial_status IN ('ongoing', 'paused')")
simple("catalog_category_any", C.Filter(category_ids=(3, 5)), "EXISTS (SELECT 1 FROM work_categories c WHERE c.work_id = id AND category_id IN (3, 5))")
simple("catalog_tag_any", C.Filter(tag_ids=("1-URGENT", "2-HIGH"), tag_mode="any"), "EXISTS (SELECT 1 FROM work_tags t WHERE t.work_id = id AND tag_id IN ('1-URGENT', '2-HIGH'))")
simple("catalog_tag_all", C.Filter(tag_ids=("1-URGENT", "2-HIGH", "5-LOW")), "(SELECT count(DISTINCT tag_id) FROM work_tags t WHERE t.work_id = id AND tag_id IN ('1-URGENT', '2-HIGH', '5-LOW')) = 3")
simple("catalog_tag_exclude", C.Filter(exclude_tag_ids=("1-URGENT",)), "NOT EXISTS (SELECT 1 FROM work_tags t WHERE t.work_id = id AND tag_id = '1-URGENT')")
simple("catalog_hide_finished", C.Filter(hide_finished=True, user_id=7), "NOT EXISTS (SELECT 1 FROM library l WHERE l.work_id = id AND user_id = 7 AND reading_status = 'finished')")
simple(
    "catalog_keyword", C.Filter(q="_LOW"),
    "(title ILIKE '%_LOW%' OR author ILIKE '%_LOW%' OR EXISTS (SELECT 1 FROM work_categories c JOIN categories k ON c.category_id = k.id WHERE c.work_id = works.id AND k.display_name ILIKE '%_LOW%')"
    " OR EXISTS (SELECT 1 FROM work_tags t JOIN tags g ON t.tag_id = g.id WHERE t.work_id = works.id AND g.display_name ILIKE '%_LOW%'))",
)
simple(
    "catalog_combined", C.Filter(q="A_I", statuses=("ongoing", "completed"), tag_ids=("5-LOW",), exclude_tag_ids=("2-HIGH",)),
    "serial_status IN ('ongoing', 'completed') AND EXISTS (SELECT 1 FROM work_tags t WHERE t.work_id = id AND tag_id = '5-LOW') AND NOT EXISTS (SELECT 1 FROM work_tags t WHERE t.work_id = id AND tag_id = '2-HIGH')"
    " AND (title ILIKE '%A_I%' OR author ILIKE '%A_I%' OR EXISTS (SELECT 1 FROM work_categories c JOIN categories k ON c.category_id = k.id WHERE c.work_id = works.id AND k.display_name ILIKE '%A_I%'))",
)


@query("catalog_count", over(f"SELECT count(DISTINCT id)::INT AS count FROM works WHERE {LISTED} AND serial_status IN ('ongoing')"))
def catalog_count(spark, d):
    return C.count(found(spark, d, C.Filter(statuses=("ongoing",))))


KEY = "strftime(published_at, '%Y-%m-%dT%H:%M:%S.000000Z')"


@query("catalog_page_updated", over(f"SELECT id, title, {KEY} AS sort_key FROM works WHERE {LISTED} AND ({KEY} < '2025-06-01T00:00:00.000000Z' OR ({KEY} = '2025-06-01T00:00:00.000000Z' AND id > 10)) ORDER BY published_at DESC, id LIMIT 21"))
def catalog_page_updated(spark, d):
    return C.page(found(spark, d, C.Filter()), after=("2025-06-01T00:00:00.000000Z", 10)).select("id", "title", "sort_key")


@query("catalog_page_title", over(f"SELECT id, title, title AS sort_key FROM works WHERE {LISTED} AND (title > 'Customer#000000100' OR (title = 'Customer#000000100' AND id > 100)) ORDER BY title, id LIMIT 31"))
def catalog_page_title(spark, d):
    return C.page(found(spark, d, C.Filter()), sort="title", limit=30, after=("Customer#000000100", 100)).select("id", "title", "sort_key")


@query(
    "catalog_names",
    over(f"""SELECT id, coalesce((SELECT string_agg(DISTINCT display_name, '|' ORDER BY display_name) FROM work_categories c JOIN categories k ON c.category_id = k.id WHERE c.work_id = works.id AND is_active), '') AS category_names,
  coalesce((SELECT string_agg(DISTINCT display_name, '|' ORDER BY display_name) FROM work_tags t JOIN tags g ON t.tag_id = g.id WHERE t.work_id = works.id AND is_active), '') AS tag_names
FROM works WHERE {LISTED}"""),
)
def catalog_names(spark, d):
    t = {k: frame(spark, d, k) for k in TERMS[:4]}
    out = C.with_names(found(spark, d, C.Filter()), **t)
    return out.select("id", F.array_join("category_names", "|").alias("category_names"), F.array_join("tag_names", "|").alias("tag_names"))


SHARED = "SELECT work_id, {c} FROM {e} JOIN {t} ON {c} = {t}.id AND is_active GROUP BY work_id, {c}"


@query(
    "related_works",
    over(f"""WITH tg AS ({SHARED.format(c='tag_id', e='work_tags', t='tags')}), ct AS ({SHARED.format(c='category_id', e='work_categories', t='categories')}),
st AS (SELECT work_id, count(*) AS n FROM tg WHERE tag_id IN (SELECT tag_id FROM tg WHERE work_id = 1) AND work_id <> 1 GROUP BY work_id),
sc AS (SELECT work_id, count(*) AS n FROM ct WHERE category_id IN (SELECT category_id FROM ct WHERE work_id = 1) AND work_id <> 1 GROUP BY work_id)
SELECT id, title, coalesce(st.n, 0)::BIGINT AS shared_tags, coalesce(sc.n, 0)::BIGINT AS shared_categories
FROM works LEFT JOIN st ON st.work_id = id LEFT JOIN sc ON sc.work_id = id
WHERE {LISTED} AND coalesce(st.n, 0) + coalesce(sc.n, 0) > 0 ORDER BY 3 DESC, 4 DESC, title, id LIMIT 6"""),
)
def related_works(spark, d):
    return C.related(1, *[frame(spark, d, t) for t in ("works", *TERMS[:4])]).select("id", "title", "shared_tags", "shared_categories")


@query("catalog_admin_search", over("SELECT id, title, visibility FROM works WHERE (contains(lower(title), '#00000001') OR contains(lower(author), '#00000001')) AND visibility <> 'removed' ORDER BY published_at DESC, id LIMIT 50"))
def catalog_admin_search(spark, d):
    return C.search_admin(frame(spark, d, "works"), "#00000001").select("id", "title", "visibility")


@query("taxonomy_active", over("SELECT id, display_name FROM categories WHERE is_active"))
def taxonomy_active(spark, d):
    return frame(spark, d, "categories").where("is_active").select("id", "display_name")


@query("parse_ref", "SELECT page_id, nullif(regexp_extract(lower(url), '(?:^|[-/])([0-9a-f]{4})$', 1), '') AS ref, CASE WHEN lower(hex(page_id)) = '' THEN NULL ELSE right('0000000' || lower(hex(page_id)), 8) END AS parsed FROM pages")
def parse_ref(spark, d):
    padded = F.lpad(F.lower(F.hex("page_id")), 8, "0")
    return frame(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract(F.lower("url"), r"(?:^|[-/])([0-9a-f]{4})$", 1), F.lit("")).alias("ref"), C.parse_ref(F.concat(F.lit("a-slug-"), padded)).alias("parsed"))
