"""The catalog: one predicate for list and count, keyset pages, names, related works."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.phrases import spellings
from lectern.functions.scalars import public_id

STATUSES = ("ongoing", "completed", "paused")
SORTS = ("updated", "title")


class InvalidFilter(ValueError):
    """A filter value the catalog refuses; ``field`` names it."""

    def __init__(self, field: str):
        super().__init__(f"invalid_filter/{field}")
        self.field = field


@dataclass(frozen=True)
class Filter:
    """What a list page and its count have in common. Empty values do not constrain."""

    q: str = ""
    work_type: str | None = None
    statuses: tuple = ()
    category_ids: tuple = ()
    tag_ids: tuple = ()
    exclude_tag_ids: tuple = ()
    tag_mode: str = "all"
    hide_finished: bool = False
    user_id: object = None
    sort: str = "updated"

    def __post_init__(self):
        if len(self.q) > 100:
            raise InvalidFilter("q")
        if set(self.statuses) - set(STATUSES):
            raise InvalidFilter("serialStatus")
        if set(self.tag_ids) & set(self.exclude_tag_ids):
            raise InvalidFilter("excludeTagIds")
        if self.hide_finished and self.user_id is None:
            raise PermissionError("unauthenticated")
        if self.sort not in SORTS:
            raise InvalidFilter("sort")

    def fingerprint(self) -> str:
        """Identifies the conditions, so that a cursor can't be used with others."""
        parts = [self.q.strip(), self.work_type, sorted(self.statuses), sorted(map(str, self.category_ids)), sorted(map(str, self.tag_ids)), sorted(map(str, self.exclude_tag_ids)), "any" if self.tag_mode == "any" and self.tag_ids else "all" if self.tag_ids else None, [str(self.user_id)] if self.hide_finished else None, self.sort]
        return hashlib.sha256(json.dumps(parts, ensure_ascii=False).encode()).hexdigest()[:16]


def id_list(text: str | None) -> tuple[str, ...]:
    """Comma-separated UUIDs: trimmed, lower-cased, distinct, sorted; others are refused."""
    ids = {p.strip().lower() for p in (text or "").split(",") if p.strip()}
    if any(not re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", i) for i in ids):
        raise InvalidFilter("ids")
    return tuple(sorted(ids))


def limit_of(value: object, default: int = 20, most: int = 50) -> int:
    """A page size between 1 and ``most``."""
    try:
        return max(1, min(most, int(value)))
    except (TypeError, ValueError):
        return default


def encode_cursor(fingerprint: str, key: str, ident: object) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "f": fingerprint, "k": key, "id": ident}).encode()).decode().rstrip("=")


def decode_cursor(raw: str, fingerprint: str) -> tuple[str, object]:
    try:
        got = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)))
        key, ident = got["k"], got["id"]
        if got["v"] != 1 or not isinstance(key, str) or ident is None:
            raise ValueError
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ValueError("invalid_cursor") from e
    if got.get("f") != fingerprint:
        raise ValueError("cursor_filter_mismatch")
    return key, ident


def listed(works: DataFrame) -> DataFrame:
    return works.where("visibility = 'public' AND active_release_id IS NOT NULL")


def any_of(works: DataFrame, edges: DataFrame, column: str, ids) -> DataFrame:
    """Works with at least one of the ids."""
    return works.join(edges.where(F.col(column).isin(*ids)).select(F.col("work_id").alias("id")).distinct(), "id", "left_semi")


def all_of(works: DataFrame, edges: DataFrame, column: str, ids) -> DataFrame:
    """Works with every one of the ids: division by a count, one shuffle of the matching edges."""
    full = edges.where(F.col(column).isin(*ids)).groupBy("work_id").agg(F.count_distinct(column).alias("n")).where(F.col("n") == len(set(ids)))
    return works.join(full.select(F.col("work_id").alias("id")), "id", "left_semi")


def none_of(works: DataFrame, edges: DataFrame, column: str, ids) -> DataFrame:
    """Works with none of the ids; works without any edge stay."""
    return works.join(edges.where(F.col(column).isin(*ids)).select(F.col("work_id").alias("id")), "id", "left_anti")


def keyword(works: DataFrame, q: str, categories: DataFrame, work_categories: DataFrame, tags: DataFrame, work_tags: DataFrame) -> DataFrame:
    """Title, author, or the name of a category or tag (active or not) is like ``%q%``, in any script variant.

    ``%`` and ``_`` in ``q`` are wildcards. Names are matched before the edges
    are read, so only matching edges are shuffled.
    """
    patterns = [f"%{v}%" for v in spellings(q)]

    def like(c: Column) -> Column:
        return reduce(lambda a, b: a | b, [c.ilike(p) for p in patterns])

    def named(terms: DataFrame, edges: DataFrame, column: str) -> DataFrame:
        return edges.join(terms.where(like(F.col("display_name"))).select(F.col("id").alias(column)), column, "left_semi").select("work_id")

    by_term = named(categories, work_categories, "category_id").unionByName(named(tags, work_tags, "tag_id")).distinct().select(F.col("work_id").alias("id"), F.lit(True).alias("by_term"))
    return works.join(by_term, "id", "left").where(like(F.col("title")) | like(F.col("author")) | F.col("by_term")).drop("by_term")


def matching(f: Filter, works: DataFrame, *, categories=None, work_categories=None, tags=None, work_tags=None, library=None) -> DataFrame:
    """The listed works that satisfy ``f``; unselected conditions are left out of the plan."""
    out = listed(works)
    if f.work_type:
        out = out.where(F.col("work_type") == f.work_type)
    if f.statuses:
        out = out.where(F.col("serial_status").isin(*f.statuses))
    if f.category_ids:
        out = any_of(out, work_categories, "category_id", f.category_ids)
    if f.tag_ids:
        out = (any_of if f.tag_mode == "any" else all_of)(out, work_tags, "tag_id", f.tag_ids)
    if f.exclude_tag_ids:
        out = none_of(out, work_tags, "tag_id", f.exclude_tag_ids)
    if f.hide_finished:
        done = library.where((F.col("user_id") == f.user_id) & (F.col("reading_status") == "finished"))
        out = out.join(done.select(F.col("work_id").alias("id")), "id", "left_anti")
    if f.q.strip():
        out = keyword(out, f.q.strip(), categories, work_categories, tags, work_tags)
    return out


def count(found: DataFrame) -> DataFrame:
    return found.agg(F.count_distinct("id").cast("int").alias("count"))


def exact_key(ts: Column) -> Column:
    """Microseconds are kept: a key that loses them repeats or skips rows."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def page(found: DataFrame, sort: str = "updated", limit: int = 20, after: tuple[str, object] | None = None) -> DataFrame:
    """Up to ``limit + 1`` rows in order, the last a sign that there are more; ``sort_key`` goes into the cursor."""
    found = found.withColumn("sort_key", exact_key(F.col("published_at")) if sort == "updated" else F.col("title"))
    key, ident = F.col("sort_key"), F.col("id")
    if after:
        further = key < after[0] if sort == "updated" else key > after[0]
        found = found.where(further | ((key == after[0]) & (ident > after[1])))
    first = key.desc_nulls_last() if sort == "updated" else key.asc_nulls_last()
    return found.orderBy(first, ident.asc()).limit(limit + 1)


def names(edges: DataFrame, terms: DataFrame, column: str, as_name: str) -> DataFrame:
    """``id`` and the sorted names of a work's active terms."""
    active = terms.where("is_active").select(F.col("id").alias(column), "display_name")
    return edges.join(active, column).groupBy(F.col("work_id").alias("id")).agg(F.array_sort(F.collect_set("display_name")).alias(as_name))


def with_names(rows: DataFrame, categories, work_categories, tags, work_tags) -> DataFrame:
    """A page's rows with category_names and tag_names, empty where there are none."""
    empty = F.array().cast("array<string>")
    out = rows.join(names(work_categories.join(rows.select(F.col("id").alias("work_id")), "work_id", "left_semi"), categories, "category_id", "category_names"), "id", "left")
    out = out.join(names(work_tags.join(rows.select(F.col("id").alias("work_id")), "work_id", "left_semi"), tags, "tag_id", "tag_names"), "id", "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("category_names", "tag_names")})


def related(seed, works, categories, work_categories, tags, work_tags, limit: int = 6) -> DataFrame:
    """Listed works that share active tags or categories with the seed, most first."""

    def shared(edges, terms, column, name):
        live = edges.join(terms.where("is_active").select(F.col("id").alias(column)), column, "left_semi").select("work_id", column).distinct()
        mine = live.where(F.col("work_id") == seed).select(column)
        return live.where(F.col("work_id") != seed).join(mine, column, "left_semi").groupBy(F.col("work_id").alias("id")).agg(F.count("*").alias(name))

    t = shared(work_tags, tags, "tag_id", "shared_tags")
    c = shared(work_categories, categories, "category_id", "shared_categories")
    both = t.join(c, "id", "full").select("id", F.coalesce("shared_tags", F.lit(0)).cast("long").alias("shared_tags"), F.coalesce("shared_categories", F.lit(0)).cast("long").alias("shared_categories"))
    return listed(works).join(both, "id").orderBy(F.desc("shared_tags"), F.desc("shared_categories"), "title", "id").limit(limit)


def search_admin(works: DataFrame, q: str, removed: bool = False, limit: int = 50) -> DataFrame:
    """Title or author contains ``q`` literally, whatever its case."""
    v = F.lower(F.lit(q))
    hit = F.lower("title").contains(v) | F.lower("author").contains(v)
    gone = F.col("visibility") == "removed"
    return works.where(hit & (gone if removed else ~gone)).orderBy(F.desc("published_at"), "id").limit(limit)


def parse_ref(segment: Column) -> Column:
    """The id a path segment refers to: a whole UUID, or the eight hex digits after the last dash; else null."""
    whole = F.lower(segment)
    short = F.regexp_extract(whole, r"(?:^|-)([0-9a-f]{8})$", 1)
    return F.when(whole.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), whole).when(short != "", short)


def resolve_works(refs: DataFrame, works: DataFrame) -> DataFrame:
    """``refs (segment)`` with ``work_id``: of a whole UUID itself, of a short id the work that has it (the least, if several), else null.

    ``works``: id, a UUID, whose first eight digits are its short id.
    """
    parsed = refs.withColumn("_ref", parse_ref(F.col("segment")))
    short = works.groupBy(public_id(F.col("id")).alias("_short")).agg(F.min("id").alias("_id"))
    out = parsed.join(short, F.col("_ref") == F.col("_short"), "left")
    return out.withColumn("work_id", F.when(F.length("_ref") == 36, F.col("_ref")).otherwise(F.col("_id"))).drop("_ref", "_short", "_id")


def resolve_chapters(refs: DataFrame, works: DataFrame, chapters: DataFrame) -> DataFrame:
    """``refs (work, segment)`` with ``chapter_id``: a whole UUID needs no work; a short id is looked up in the work that ``work`` refers to.

    ``chapters``: id, a UUID, and work_id. Works may share a short id: it stands
    for all of them, and the chapter's tells them apart.
    """
    owned = refs.withColumns({"_ref": parse_ref(F.col("segment")), "_work": parse_ref(F.col("work"))})
    known = chapters.join(works.select(F.col("id").alias("work_id")), "work_id", "left_semi")
    named = known.select(public_id(F.col("work_id")).alias("_of"), "id").unionByName(chapters.select(F.col("work_id").alias("_of"), "id"))
    short = named.groupBy("_of", public_id(F.col("id")).alias("_short")).agg(F.min("id").alias("_id"))
    out = owned.join(short, (F.col("_ref") == F.col("_short")) & (F.col("_work") == F.col("_of")), "left")
    return out.withColumn("chapter_id", F.when(F.length("_ref") == 36, F.col("_ref")).otherwise(F.col("_id"))).drop("_ref", "_short", "_id", "_work", "_of")


def ordinals(rows: DataFrame, bucket: Column, order: list, first: int | None = None, last: int | None = None) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in a total order; of a page only those from ``first`` to ``last``.

    Not one task's sort: ``bucket`` grows with the order, its counts say where
    each bucket begins, and rows are ordered within their bucket. The counts, a
    row a bucket, are the only thing ordered as a whole.
    """
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if first is not None:
        starts = starts.where((F.col("_start") <= last) & (F.col("_start") + F.col("_n") > first))
    at = F.col("_start") + F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    out = rows.withColumn("_bucket", bucket).join(starts, "_bucket").withColumn("at", at)
    if first is not None:
        out = out.where(F.col("at").between(first, last))
    return out.drop("_bucket", "_n", "_start")
