"""What readers and editors see of works and chapters: details, metadata, chapter views, editorial lists.

Each works on whole tables; a request is a filter before it. Release items carry
the columns of their release's snapshot, so no projection of published text reads
the editorial head.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalars import paragraphs
from lectern.operators.catalog import names
from lectern.operators.scan import running
from lectern.operators.toc import active
from lectern.stored import table

SHOWN = ("public", "unlisted")


def gate(works: DataFrame, role: str = "") -> DataFrame:
    """``works`` with ``access`` (ok, forbidden, work_not_found) and ``source``, what is read of them: head, release or none."""
    removed, draft = F.col("visibility") == "removed", F.col("visibility") == "draft"
    access = F.when(removed, "work_not_found").when(draft & F.lit(role != "admin"), "forbidden").otherwise("ok")
    source = F.when(draft, "head").when(F.col("active_release_id").isNotNull(), "release").otherwise("none")
    return works.withColumn("access", access).withColumn("source", F.when(F.col("access") == "ok", source))


def released(works: DataFrame, releases: DataFrame) -> DataFrame:
    """Works with the release they show: its id, version, time and chapter count."""
    r = releases.select(F.col("id").alias("release_id"), F.col("version").alias("release_version"), F.col("published_at").alias("released_at"), "chapter_count")
    return works.join(r, works["active_release_id"] == r["release_id"])


def _ends(rows: DataFrame, by: str, ident: str) -> DataFrame:
    return rows.groupBy(by).agg(F.min_by(ident, "position").alias("first_chapter_id"), F.max_by(ident, "position").alias("latest_chapter_id"), F.count("*").cast("int").alias("n"))


def work_detail(works, releases, items, categories, work_categories, tags, work_tags) -> DataFrame:
    """Public and unlisted works with their active release, its first chapter and the names of active terms."""
    shown = released(works.where(F.col("visibility").isin(*SHOWN)), releases)
    out = shown.join(_ends(items, "release_id", "chapter_id").select("release_id", "first_chapter_id"), "release_id", "left")
    out = out.join(names(work_categories, categories, "category_id", "category_names"), "id", "left").join(names(work_tags, tags, "tag_id", "tag_names"), "id", "left")
    empty = F.array().cast("array<string>")
    kept = ("id", "title", "author", "work_type", "serial_status", "visibility", "release_id", "release_version", "released_at", "chapter_count", "first_chapter_id")
    return out.select(*kept, *[F.coalesce(c, empty).alias(c) for c in ("category_names", "tag_names")])


def reader_metadata(works, releases, items, chapters, role: str = "") -> DataFrame:
    """What a reader is told of each work it may read: counts and ends from the release, or from the head of a draft under an editor; nothing without a release."""
    ok = gate(works, role).where("access = 'ok'")
    r = releases.select(F.col("id").alias("release_id"), F.col("version").alias("release_version"), F.col("published_at").alias("released_at"), F.col("chapter_count").alias("released_count"))
    head = _ends(active(chapters), "work_id", "id").select("work_id", *[F.col(c).alias(f"head_{c}") for c in ("first_chapter_id", "latest_chapter_id", "n")])
    rows = ok.withColumn("release_id", F.when(F.col("source") == "release", F.col("active_release_id")))
    rows = rows.join(r, "release_id", "left").join(_ends(items, "release_id", "chapter_id").drop("n"), "release_id", "left").join(head, rows["id"] == head["work_id"], "left")
    is_head = F.col("source") == "head"
    count = F.when(is_head, F.coalesce("head_n", F.lit(0))).otherwise(F.coalesce("released_count", F.lit(0))).cast("int")
    ends = [F.when(is_head, F.col(f"head_{c}")).otherwise(F.col(c)).alias(c) for c in ("first_chapter_id", "latest_chapter_id")]
    return rows.select("id", "title", "author", "work_type", "serial_status", "visibility", "source", count.alias("chapter_count"), *ends, "release_id", "release_version", "released_at")


def readable_chapters(works, items, chapters, role: str = "") -> DataFrame:
    """``work_id, chapter_id, revision_id, label_raw, position, previous_chapter_id, next_chapter_id`` of every chapter that may be read."""
    ok = gate(works, role).where("access = 'ok'").select(F.col("id").alias("work_id"), "source", "active_release_id")
    published = ok.where("source = 'release'").join(items, F.col("active_release_id") == F.col("release_id")).select("work_id", "chapter_id", "revision_id", "label_raw", "position")
    drafts = ok.where("source = 'head'").select("work_id").join(active(chapters), "work_id").select("work_id", F.col("id").alias("chapter_id"), F.col("head_revision_id").alias("revision_id"), "label_raw", "position")
    order = Window.partitionBy("work_id").orderBy("position")
    return published.unionByName(drafts).withColumns({"previous_chapter_id": F.lag("chapter_id").over(order), "next_chapter_id": F.lead("chapter_id").over(order)})


def resource_lists(links: DataFrame, resources: DataFrame) -> DataFrame:
    """``revision_id, resources``: each revision's images as one array of structs, by hash. A revision's links are few."""
    r = resources.select("content_hash", "media_type", "size_bytes")
    one = F.struct("content_hash", F.concat(F.lit("/resources/"), "content_hash").alias("url"), "media_type", "size_bytes", "alt")
    return links.join(r, "content_hash").groupBy("revision_id").agg(F.array_sort(F.collect_list(one)).alias("resources"))


def chapter_view(works, items, chapters, revisions, bodies, links, resources, role: str = "") -> DataFrame:
    """A chapter as it is read: text, neighbours, paragraphs, and its images by hash; ``error`` says why there is no text.

    ``revisions``: id, title, content_key, created_at; ``bodies``: content_key, body.
    """
    rows = readable_chapters(works, items, chapters, role)
    r = revisions.select(F.col("id").alias("revision_id"), "title", "content_key", "created_at")
    out = rows.join(r, "revision_id", "left").join(bodies, "content_key", "left").join(resource_lists(links, resources), "revision_id", "left")
    error = F.when(F.col("body").isNull(), "content_unavailable")
    return out.select(
        "chapter_id", "work_id", "revision_id", "label_raw", "title", "body", "previous_chapter_id", "next_chapter_id", F.size(paragraphs(F.coalesce("body", F.lit("")))).alias("paragraph_count"),
        F.col("created_at").alias("updated_at"), "resources", error.alias("error"),
    )


def head_chapters(chapters: DataFrame, revisions: DataFrame) -> DataFrame:
    """The editorial list: active chapters in order, with the title of their head revision if they have one."""
    r = revisions.select(F.col("id").alias("head_revision_id"), "title")
    return active(chapters).join(r, "head_revision_id", "left").select("work_id", "id", "label_raw", "title", "position", F.col("head_revision_id").alias("revision_id"))


def head_chapter(chapters: DataFrame, revisions: DataFrame, bodies: DataFrame) -> DataFrame:
    """Active chapters with a head revision, and its text; null where the object is gone."""
    r = revisions.select(F.col("id").alias("head_revision_id"), "title", "content_key", F.col("created_at").alias("updated_at"))
    out = active(chapters).join(r, "head_revision_id").join(bodies, "content_key", "left")
    return out.select(F.col("id").alias("chapter_id"), "work_id", F.col("head_revision_id").alias("revision_id"), "label_raw", "title", "body", F.size(paragraphs(F.col("body"))).alias("paragraph_count"), "updated_at")


def newest_release(releases: DataFrame) -> DataFrame:
    """``work_id, release_id, version`` of the highest version, which an editor's preview is compared with, active or not."""
    return releases.groupBy("work_id").agg(F.max_by("id", "version").alias("release_id"), F.max("version").alias("version"))


def export_versions(works: DataFrame, releases: DataFrame) -> DataFrame:
    """``work_id, nth, version_id, label, kind, version, active``: the head, then releases from the newest on."""
    head = works.select(F.col("id").alias("work_id"), F.lit(0).alias("nth"), F.lit("head").alias("version_id"), F.lit("草稿目前版本").alias("label"), F.lit("head").alias("kind"), F.lit(None).cast("int").alias("version"), F.lit(False).alias("active"))
    nth = F.row_number().over(Window.partitionBy("work_id").orderBy(F.desc("version")))
    is_active = F.coalesce(F.col("id") == F.col("active_release_id"), F.lit(False))
    rows = releases.join(works.select(F.col("id").alias("work_id"), "active_release_id"), "work_id").select(
        "work_id", nth.alias("nth"), F.col("id").cast("string").alias("version_id"), F.concat(F.lit("v"), F.col("version").cast("string"), F.when(is_active, "（目前發布）").otherwise("")).alias("label"),
        F.lit("release").alias("kind"), F.col("version").cast("int").alias("version"), is_active.alias("active"),
    )
    return head.unionByName(rows)


def import_job(jobs: DataFrame, files: DataFrame, items: DataFrame, most_attempts: int = 3) -> DataFrame:
    """A job with its file and how many chapters it staged, and how many of them want a review."""
    staged = items.groupBy("job_id").agg(F.count("*").cast("int").alias("staged_chapters"), F.count_if("needs_review").cast("int").alias("staged_needs_review"))
    f = files.select(F.col("id").alias("source_file_id"), "file_hash", "size_bytes", "mime_type")
    out = jobs.join(f, "source_file_id", "left").join(staged, jobs["id"] == staged["job_id"], "left").drop("job_id")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("staged_chapters", "staged_needs_review")}).withColumn("max_attempts", F.lit(most_attempts))


def shelf_rows(library: DataFrame, works: DataFrame, progress: DataFrame, follows: DataFrame, events: DataFrame) -> DataFrame:
    """Shelf rows with the reader's own progress and follow, the newest version, and chapters new since the version last seen.

    ``events``: work_id, release_version, n_new. New chapters come from running
    sums by work and one look-up at the version seen, not from all pairs of
    follows and releases.
    """
    p = progress.select("user_id", "work_id", "chapter_id", "paragraph_index")
    f = follows.select("user_id", "work_id", "last_seen")
    rows = library.join(works.select(F.col("id").alias("work_id"), "title", "visibility"), "work_id").join(p, ["user_id", "work_id"], "left").join(f, ["user_id", "work_id"], "left")
    return newer_than(rows, events, "last_seen")


def newer_than(rows: DataFrame, events: DataFrame, seen: str) -> DataFrame:
    """``rows`` with latest_version and new_chapters, those of releases above the version ``seen`` (null: all).

    A segmented scan: a work's releases and the rows that ask about it are in
    one order, but not in one task; a work that half of all readers follow is
    spread over many. What the asking rows carry beyond the scan is looked up.
    """
    n, v = F.col("n_new").cast("long"), F.col("release_version").cast("long")
    asked = rows.withColumn("row", F.struct(*rows.columns)).select("work_id", F.coalesce(F.col(seen), F.lit(0)).cast("long").alias("v"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("n"), F.xxhash64("row").alias("tie"), "row")
    held = events.select("work_id", v.alias("v"), F.lit(0).alias("asks"), n.alias("n"), F.lit(0).cast("long").alias("tie"))
    both = running(held.unionByName(asked, allowMissingColumns=True), ["work_id"], ["v", "asks", "tie"], {"below": "n"})
    whole = events.groupBy(F.col("work_id").alias("work")).agg(F.sum(n).alias("all"), F.max(v).cast("int").alias("latest_version"))
    out = both.where("asks = 1").join(whole, F.col("work_id") == F.col("work"), "left")
    return out.select("row.*", "latest_version", (F.coalesce("all", F.lit(0)) - F.col("below")).alias("new_chapters"))


def belongs(claims: DataFrame, revisions: DataFrame, chapters: DataFrame, works: DataFrame, items: DataFrame) -> DataFrame:
    """Claims (work_id, chapter_id, revision_id) that hold: the revision is the chapter's, the chapter the work's and not merged away.

    A deleted chapter holds only as the active release has it.
    """
    r = revisions.select(F.col("id").alias("revision_id"), "chapter_id")
    c = chapters.where("merged_into_chapter_id IS NULL").select(F.col("id").alias("chapter_id"), "work_id", "deleted_at")
    published = works.where("active_release_id IS NOT NULL").join(items, F.col("active_release_id") == F.col("release_id")).select(F.col("id").alias("work_id"), "chapter_id", "revision_id", F.lit(True).alias("published")).distinct()
    known = claims.join(r, ["revision_id", "chapter_id"], "left_semi").join(c, ["chapter_id", "work_id"])
    return known.join(published, ["work_id", "chapter_id", "revision_id"], "left").where("deleted_at IS NULL OR published").select("work_id", "chapter_id", "revision_id")


def reachability(resources: DataFrame, links: DataFrame, items: DataFrame, works: DataFrame) -> DataFrame:
    """Resources with ``publicly_reachable``: a revision in the active release of a public or unlisted work uses it."""
    live = works.where(F.col("visibility").isin(*SHOWN) & F.col("active_release_id").isNotNull()).select(F.col("active_release_id").alias("release_id"))
    used = links.join(items.join(live, "release_id", "left_semi").select("revision_id"), "revision_id", "left_semi").select("content_hash", F.lit(True).alias("used")).distinct()
    return resources.join(used, "content_hash", "left").withColumn("publicly_reachable", F.coalesce("used", F.lit(False))).drop("used")


def review_rows(matched: DataFrame, missing: DataFrame, chapters: DataFrame) -> DataFrame:
    """The review list of an import: its classed items in order, then chapters that nothing matches; ``nth`` counts from 0 within a work."""
    label = lambda of: chapters.select(F.col("id").alias(of), F.col("label_raw").alias(of.replace("_id", "_label")))
    rows = matched
    for of in ("matched_chapter_id", "insert_after_id", "insert_before_id"):
        rows = rows.join(label(of), of, "left")
    pending = F.col("class").isin("ambiguous", "structural_conflict") | ((F.col("class") == "new") & ~F.col("position_confident"))
    gone = missing.select("work_id", F.col("position"), F.col("id").alias("chapter_id"), F.lit("missing").alias("class"), F.lit(False).alias("pending"), F.lit(1).alias("last"))
    both = rows.withColumn("pending", pending).withColumn("last", F.lit(0)).unionByName(gone, allowMissingColumns=True)
    return both.withColumn("nth", F.row_number().over(Window.partitionBy("work_id").orderBy("last", "position", F.coalesce(F.col("item_id").cast("string"), F.col("chapter_id").cast("string")))) - 1).drop("last")


def review_page(rows: DataFrame, which: str = "all", page: int = 1, limit: int = 40) -> DataFrame:
    """One page of each work's review list, filtered to ``all``, ``pending`` or a class, with the filtered total."""
    page = min(1_000_000, max(1, page))
    wanted: Column = F.lit(True) if which == "all" else F.col("pending") if which == "pending" else F.col("class") == which
    of_work = Window.partitionBy("work_id")
    picked = rows.where(wanted).withColumns({"total": F.count("*").over(of_work), "at": F.row_number().over(of_work.orderBy("nth")) - 1})
    return picked.where(F.col("at").between((page - 1) * limit, page * limit - 1))


def offset_page(rows: DataFrame, keys: list, offset: int, limit: int) -> DataFrame:
    """``limit`` rows of a total order from ``offset`` on, each with ``next_offset``, null on the last page.

    Places come from a scan, so a far page sorts no more in one task than a near one.
    """
    limit, offset = max(1, limit), max(0, offset)
    numbered = table(running(rows.withColumn("_one", F.lit(1).cast("long")), [], keys, {"_nth": "_one"}))
    total = numbered.agg(F.max("_nth").alias("_total"))  # one row
    out = numbered.where(F.col("_nth").between(offset + 1, offset + limit)).crossJoin(F.broadcast(total))
    return out.withColumn("next_offset", F.when(F.lit(offset + limit) < F.col("_total"), offset + limit)).drop("_one", "_nth", "_total")


def reading_state(asked: DataFrame, library: DataFrame, follows: DataFrame, releases: DataFrame, events: DataFrame) -> DataFrame:
    """What a reader has to do with a work, a row for each pair ``asked (user_id, work_id)``.

    in_library, following, last_seen_version, latest_version (of ``releases``),
    and new_chapter_count above the version last seen, 0 unless the reader follows.
    """
    pair = ["user_id", "work_id"]
    mine = asked.select(*pair).distinct().join(library.select(*pair, F.lit(True).alias("shelved")).distinct(), pair, "left")
    mine = mine.join(follows.select(*pair, "last_seen", F.lit(True).alias("follows")), pair, "left")
    counted = newer_than(mine, events, "last_seen").drop("latest_version")
    latest = releases.groupBy("work_id").agg(F.max("version").cast("int").alias("latest_version"))
    following = F.coalesce("follows", F.lit(False))
    return counted.join(latest, "work_id", "left").select(
        *pair, F.coalesce("shelved", F.lit(False)).alias("in_library"), following.alias("following"), F.col("last_seen").alias("last_seen_version"), "latest_version",
        F.when(following, F.col("new_chapters")).otherwise(0).alias("new_chapter_count"),
    )


def bookmark_pages(bookmarks: DataFrame, works: DataFrame, chapters: DataFrame, work_id=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Every reader's page of bookmarks, newest first, with title and label, the reader's ``total`` and ``next_offset``.

    ``bookmarks``: id, user_id, work_id, chapter_id, paragraph_index, note,
    created_at. With ``work_id`` only that work's count and show.
    """
    limit, offset = min(100, max(1, limit)), max(0, offset)
    wanted = bookmarks if work_id is None else bookmarks.where(F.col("work_id") == work_id)
    total = wanted.groupBy("user_id").agg(F.count("*").cast("int").alias("total"))
    rows = wanted.join(works.select(F.col("id").alias("work_id"), F.col("title").alias("work_title")), "work_id").join(chapters.select(F.col("id").alias("chapter_id"), F.col("label_raw").alias("chapter_label")), "chapter_id")
    placed = running(rows.withColumn("_one", F.lit(1).cast("long")), ["user_id"], [F.desc("created_at"), F.desc("id")], {"_nth": "_one"})
    page = placed.where(F.col("_nth").between(offset + 1, offset + limit)).join(total, "user_id")
    return page.withColumn("next_offset", F.when(F.lit(offset + limit) < F.col("total"), offset + limit)).drop("_one", "_nth")


def bookmark_works(bookmarks: DataFrame, works: DataFrame) -> DataFrame:
    """``user_id, id, title``: the works a reader can filter bookmarks by, whatever the page shows."""
    return bookmarks.select("user_id", F.col("work_id").alias("id")).distinct().join(works.select("id", "title"), "id").select("user_id", "id", "title")
