"""Tables of contents, scalar functions and search over the analog tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import scalars as S
from lectern.operators import search, toc
from lectern.operators.catalog import ordinals
from lectern.operators.gram_index import GramIndex, search_next
from lectern.plans.analog import WRITTEN, frame, over
from lectern.plans.registry import query
from lectern.stored import shared_folder


@query("toc_window", over("SELECT id, ordinal, total, false AS anchor_missing FROM (SELECT id, (row_number() OVER (ORDER BY position, id) - 1)::INT AS ordinal, count(*) OVER () AS total FROM chapters WHERE work_id = 4) t WHERE ordinal >= greatest(0, least(greatest(0, total - 5), (SELECT a FROM (SELECT id AS i, row_number() OVER (ORDER BY position, id) - 1 AS a FROM chapters WHERE work_id = 4) q ORDER BY i LIMIT 1) - 2)) AND ordinal < greatest(0, least(greatest(0, total - 5), (SELECT a FROM (SELECT id AS i, row_number() OVER (ORDER BY position, id) - 1 AS a FROM chapters WHERE work_id = 4) q ORDER BY i LIMIT 1) - 2)) + 5"))
def toc_window(spark, d):
    mine = frame(spark, d, "chapters").where("work_id = 4")
    mine = mine.withColumn("anchor_id", F.min("id").over(Window.partitionBy("work_id")))
    return toc.window(mine, limit=5, around=F.col("anchor_id")).select("id", "ordinal", "total", "anchor_missing")


@query("toc_latest", over("SELECT id, work_id, ordinal FROM (SELECT id, work_id, (row_number() OVER (PARTITION BY work_id ORDER BY position, id) - 1)::INT AS ordinal, count(*) OVER (PARTITION BY work_id) AS total FROM chapters) t WHERE ordinal >= greatest(0, total - 3)"))
def toc_latest(spark, d):
    return toc.window(frame(spark, d, "chapters"), limit=3, latest=True).select("id", "work_id", "ordinal")


@query("toc_neighbours", over("SELECT work_id, id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM chapters WINDOW w AS (PARTITION BY work_id ORDER BY position, id)"))
def toc_neighbours(spark, d):
    return toc.neighbours(frame(spark, d, "chapters"))


@query("toc_ends", over("SELECT work_id, first(id ORDER BY position, id) AS first_id, last(id ORDER BY position, id) AS last_id, count(*) AS chapters FROM chapters GROUP BY work_id"))
def toc_ends(spark, d):
    return toc.ends(frame(spark, d, "chapters"))


@query("toc_search", over("SELECT id FROM chapters WHERE strpos(lower(label_raw), 'ch 12') > 0 OR strpos(lower(volume), 'ch 12') > 0"))
def toc_search(spark, d):
    return toc.titled(frame(spark, d, "chapters"), ["CH 12"], ("label_raw", "volume")).select("id")


TOKENS = """WITH lines AS (SELECT work_id, position || ':' || id || ':' || label_raw AS line, (row_number() OVER (PARTITION BY work_id ORDER BY position, id) - 1) // 8 AS piece FROM chapters),
low AS (SELECT work_id, piece, sha256(string_agg(line, chr(10) ORDER BY split_part(line, ':', 1)::INT, split_part(line, ':', 2)::BIGINT)) AS line FROM lines GROUP BY work_id, piece),
mid AS (SELECT work_id, piece // 8 AS part, CASE WHEN max(piece) OVER (PARTITION BY work_id) = 0 THEN NULL ELSE line END AS line, line AS lone, piece AS nr FROM low),
high AS (SELECT work_id, part, CASE WHEN count(line) = 0 THEN min(lone) ELSE sha256(string_agg(line, chr(10) ORDER BY nr)) END AS line FROM mid GROUP BY work_id, part)
SELECT work_id, CASE WHEN count(*) = 1 THEN min(line) ELSE sha256(string_agg(line, chr(10) ORDER BY part)) END AS toc_version FROM high GROUP BY work_id"""


@query("toc_version", over(TOKENS))
def toc_version(spark, d):
    """Chunks of eight, so that most works have a tree."""
    return toc.version_token(frame(spark, d, "chapters"), 8)


@query("paragraphs", "SELECT doc_id, (u.pos - 1)::INT AS at, u.p FROM (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END AS ps FROM documents) t, unnest(ps) WITH ORDINALITY AS u(p, pos)")
def paragraphs(spark, d):
    return frame(spark, d, "documents").select("doc_id", F.posexplode(S.paragraphs(F.col("text"), "\n")).alias("at", "p"))


@query("paragraph_excerpt", "SELECT doc_id, left(string_split(text, chr(10))[2], 1000) AS excerpt FROM documents")
def paragraph_excerpt(spark, d):
    return frame(spark, d, "documents").select("doc_id", S.excerpt(F.col("text"), F.lit(1), "\n").alias("excerpt"))


SNIPPET = r"""WITH para AS (
  SELECT doc_id, u.pos - 1 AS para, trim(regexp_replace(u.p, '\s+', ' ', 'g')) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents) t, unnest(ps) WITH ORDINALITY AS u(p, pos)
), hit AS (
  SELECT *, least(nullif(strpos(lower(p), 'ing the'), 0), nullif(strpos(lower(p), 'der'), 0)) - 1 AS place FROM para
), one AS (
  SELECT *, greatest(0, place - 72) AS s, least(length(p), place + 112) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY para) AS nth FROM hit WHERE place IS NOT NULL
)
SELECT doc_id, para::INT AS paragraph, (place - s + CASE WHEN s > 0 THEN 1 ELSE 0 END)::INT AS match_start,
  CASE WHEN s > 0 THEN '…' ELSE '' END || substring(p, s + 1, e - s) || CASE WHEN e < length(p) THEN '…' ELSE '' END AS snippet
FROM one WHERE nth = 1"""


@query("snippet_window", SNIPPET)
def snippet_window(spark, d):
    m = search.first_match(F.col("text"), F.lit("untitled"), ["ing the", "der"], "\n")
    return frame(spark, d, "documents").withColumn("m", m).where("m IS NOT NULL").select("doc_id", "m.*")


@query("book_search", "WITH b AS (" + SNIPPET.replace("'ing the'", "'reation'").replace("'der'", "'reation'") + ") SELECT doc_id AS position, paragraph, match_start, snippet FROM b ORDER BY 1 LIMIT 51")
def book_search(spark, d):
    docs = frame(spark, d, "documents").select(F.col("doc_id").alias("position"), F.lit("untitled").alias("title"), F.col("text").alias("body"))
    return search.search_book(docs, ["reation"], separator="\n").drop("title")


HITS = "WITH b AS (" + SNIPPET.replace("'ing the'", "'reation'").replace("'der'", "'reation'") + ") SELECT doc_id AS position, paragraph, match_start, snippet FROM b ORDER BY 1 LIMIT {n} OFFSET {first}"


def book_and_index(spark, d):
    """All documents as the chapters of one book, and their index: the one written before, or a new one."""
    docs = frame(spark, d, "documents")
    chapters = docs.select(F.col("doc_id").alias("position"), F.lit("untitled").alias("title"), F.col("doc_id").alias("key"))
    if (d, "body_index") in WRITTEN:
        return chapters, GramIndex(spark, WRITTEN[d, "body_index"], 16)
    return chapters, write_index(spark, d, f"{shared_folder(spark)}/lectern/index-{uuid.uuid4().hex}")


def write_index(spark, d, path):
    return GramIndex(spark, path, 16).add(frame(spark, d, "documents"), "doc_id", "text")


@query("book_search_indexed", HITS.format(n=8, first=0))
def book_search_indexed(spark, d):
    """The first page, by the index."""
    chapters, index = book_and_index(spark, d)
    return search_next(chapters, index, ["reation"], "reation", "r1", limit=8, separator="\n")[0].drop("title")


@query("book_search_next", HITS.format(n=8, first=8))
def book_search_next(spark, d):
    """The second page, by the first one's cursor."""
    chapters, index = book_and_index(spark, d)
    cursor = search_next(chapters, index, ["reation"], "reation", "r1", limit=8, separator="\n")[1]
    return search_next(chapters, index, ["reation"], "reation", "r1", cursor, 8, separator="\n")[0].drop("title")


@query("body_hash", "SELECT doc_id, sha256(text) AS body_hash, sha256(lang || chr(10) || sha256(text) || chr(10) || 'p1' || chr(10) || source) AS revision_hash FROM documents")
def body_hash(spark, d):
    h = F.sha2("text", 256)
    return frame(spark, d, "documents").select("doc_id", h.alias("body_hash"), S.revision_hash(F.col("lang"), h, F.lit("p1"), F.col("source")).alias("revision_hash"))


@query("url_slug", r"SELECT page_id, CASE WHEN length(s) <= 40 THEN s WHEN strpos(left(s, 40), '-') > 0 THEN regexp_replace(left(s, 40), '-[^-]*$', '') ELSE left(s, 40) END AS slug FROM (SELECT page_id, array_to_string(regexp_extract_all(lower(url), '[\p{L}\p{N}]+'), '-') AS s FROM pages) t")
def url_slug(spark, d):
    return frame(spark, d, "pages").select("page_id", S.slug(F.col("url")).alias("slug"))


@query("xml_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def xml_escape(spark, d):
    return frame(spark, d, "pages").select("page_id", S.xml_escape(F.col("html")).alias("escaped"))


@query("speech_chunks", "SELECT doc_id, u.i::INT AS at, substring(text, (u.i * 180 + 1)::INT, 180) AS chunk FROM documents, unnest(range(0, ((length(text) + 179) // 180)::INT)) AS u(i)")
def speech_chunks(spark, d):
    return frame(spark, d, "documents").select("doc_id", F.posexplode(S.speech_chunks(F.col("text"))).alias("at", "chunk"))


KEYWORDS = "regexp_split_to_array(p_name || ' #' || p_type || '/' || p_brand, '[、,，/／|｜;；#＃]|\\s{2,}')"


@query("keyword_split", f"SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(w, lambda x: x <> '')), lambda x: [lpad(list_position(w, x)::VARCHAR, 4, '0'), x])), lambda x: x[2]), '|') AS words FROM (SELECT p_partkey, list_transform({KEYWORDS}, lambda x: trim(x)) AS w FROM part) t")
def keyword_split(spark, d):
    words = S.keywords(F.concat(F.col("p_name"), F.lit(" #"), F.col("p_type"), F.lit("/"), F.col("p_brand")))
    return frame(spark, d, "part").select("p_partkey", F.array_join(words, "|").alias("words"))


@query("completion_status", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'completed' WHEN o_orderkey % 7 IN (1, 2, 3) THEN 'ongoing' WHEN o_orderkey % 7 = 4 THEN 'completed' END AS status FROM orders")
def completion_status(spark, d):
    said = F.array(*map(F.lit, ("本書已完結", "未完結", "未完成", "連載中 (Ongoing)", "全本", "未定", "finis")))
    return frame(spark, d, "orders").select("o_orderkey", S.completion_status(F.get(said, (F.col("o_orderkey") % 7).cast("int"))).alias("status"))


@query("body_window", "SELECT doc_id, substring(text, 101, 200) AS part FROM documents")
def body_window(spark, d):
    return frame(spark, d, "documents").select("doc_id", S.body_window(F.col("text"), F.lit(100), 200).alias("part"))


@query("picker_match", "SELECT p_partkey FROM part WHERE strpos(replace(lower(p_name), ' ', ''), 'redwid') > 0")
def picker_match(spark, d):
    return frame(spark, d, "part").where(S.term_matches(F.col("p_name"), F.lit(" Red-WiD "))).select("p_partkey")


@query("analysis_version", "SELECT p_partkey, sha256('[\"' || p_brand || '\",\"' || p_size || '\"]') AS version FROM part")
def analysis_version(spark, d):
    return frame(spark, d, "part").select("p_partkey", S.analysis_version(F.col("p_brand"), F.col("p_size")).alias("version"))


@query("props_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_array_length('[' || coalesce(json_extract_string(props, '$.k'), '') || ']'), 0)::INT AS n FROM events")
def props_json(spark, d):
    k = F.get_json_object("props", "$.k")
    return frame(spark, d, "events").select("event_id", k.alias("k"), F.coalesce(F.json_array_length(F.concat(F.lit("["), F.coalesce(k, F.lit("")), F.lit("]"))), F.lit(0)).alias("n"))


@query("title_order", over("SELECT id, row_number() OVER (ORDER BY title, id)::INT AS nth FROM works WHERE visibility = 'public'"))
def title_order(spark, d):
    public = frame(spark, d, "works").where("visibility = 'public'")
    return ordinals(public, F.left("title", F.lit(16)), ["title", "id"]).select("id", (F.col("at") + 1).cast("int").alias("nth"))


@query("offset_page", over("SELECT id, title FROM works ORDER BY published_at DESC, id LIMIT 100 OFFSET 200"))
def offset_page(spark, d):
    return frame(spark, d, "works").orderBy(F.desc("published_at"), "id").offset(200).limit(100).select("id", "title")


@query("reader_settings", "SELECT c_custkey, least(greatest(c_acctbal, 12), 32) AS font_size, greatest(0, least(c_custkey % 50, c_custkey % 31 - 1))::BIGINT AS paragraph, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago' ELSE strftime(DATE '2024-03-01' - d::INT, '%Y-%m-%d') END AS day FROM (SELECT *, c_custkey % 20 AS d FROM customer) t")
def reader_settings(spark, d):
    day = F.date_sub(F.lit("2024-03-01").cast("date"), (F.col("c_custkey") % 20).cast("int"))
    return frame(spark, d, "customer").select("c_custkey", S.clamped(F.col("c_acctbal"), 12.0, 32.0, 18.0).alias("font_size"), S.remap_paragraph(F.col("c_custkey") % 50, F.col("c_custkey") % 31).alias("paragraph"), S.relative_day(day, F.lit("2024-03-01").cast("date")).alias("day"))
