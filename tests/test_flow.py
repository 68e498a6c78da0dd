"""Objects, the import flow, projections, indexes and cursors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.operators import import_flow, maintenance, projections, publishing, search
from lectern.sources import objects


def test_objects(spark, tmp_path):
    folder = f"{tmp_path}/store"
    assert objects.stored(spark, folder) is None
    bodies = spark.createDataFrame([("one text here",), ("two",), ("one text here",), ("",)], "body string")
    keyed = objects.put_bodies(bodies, folder)
    objects.put_bodies(bodies.limit(1), folder)  # adds nothing
    held = objects.stored(spark, folder)
    assert held.count() == 3 and keyed.join(held, "content_key", "left_anti").count() == 0
    assert all(len(r.key) > 40 and r.modified_at for r in objects.listing(held).collect())
    keys = keyed.select("content_key").limit(1).union(spark.createDataFrame([("../x",), ("ab/gone",)], "k string"))
    assert sorted(r.body is None for r in objects.get(held, keys).collect()) == [False, True, True]
    assert objects.without(held, spark.createDataFrame([("ab/gone",)], "key string").union(keyed.select("content_key").limit(1))).count() == 2
    files = spark.createDataFrame([("a.TXT", b"x", 1), ("b.TXT", b"x", 1), ("c.pdf", b"y", 1), ("d.epub", b"", 0)], "path string, content binary, length long")
    rows = {r.path: r for r in objects.uploads(files).collect()}
    assert rows["a.TXT"].file_hash == rows["b.TXT"].file_hash and [rows[p].error for p in sorted(rows)] == [None, None, "unsupported_format", "empty_file"]


def test_index_damage(spark):
    df = spark.createDataFrame([("小龍在此", "t")], "body string, title string").withColumn("i", search.body_index("body"))
    raw = df.first().i
    broken = [raw, bytes(len(raw)), raw[:-1], raw[:8] + bytes(len(raw) - 8), b"", None]
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(broken)], "k int, i binary")
    assert [r.x for r in rows.select("k", search.may_contain(F.col("i"), ["qqqq"]).alias("x")).orderBy("k").collect()] == [False, True, True, True, True, True]


def test_search_cursor():
    raw = search.search_cursor("f", "r", 7, 50)
    assert search.read_search_cursor(raw, "f", "r", 60) == (7, 50)
    for args, why in ((("x", "r", 60), "cursor_filter_mismatch"), (("f", "x", 60), "search_version_changed"), (("f", "r", 7), "invalid_cursor")):
        with pytest.raises(ValueError, match=why):
            search.read_search_cursor(raw, *args)
    for bad in ("", "!", raw[:-4] + "AAAA", "x" * 3000, search.search_cursor("f", "r", -1, 0)):
        with pytest.raises(ValueError, match="invalid_cursor"):
            search.read_search_cursor(bad, "f", "r", 60)


def test_import_flow(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("第一章 甲\n一。\n第二章 乙\n二。\n".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("nothing that heads".encode())
    (tmp_path / "c.txt").write_bytes(b"\n \n")
    items, jobs = import_flow.stage(spark.read.format("binaryFile").load(str(tmp_path)))
    states = {r.job_id[-5:]: (r.status, r.chapter_count, r.error_code) for r in jobs.collect()}
    assert states == {"a.txt": ("ready", 2, None), "b.txt": ("review_required", 1, None), "c.txt": ("failed", 0, "empty_source")}
    staged = items.where("job_id LIKE '%a.txt'").orderBy("position").collect()
    assert [(r.label_key, r.number, r.title, r.body) for r in staged] == [("ch:1", 1, "甲", "一。"), ("ch:2", 2, "乙", "二。")]
    named = jobs.select("job_id", F.when(F.col("job_id").endswith("a.txt"), 1).otherwise(2).alias("work_id"), "status")
    none = spark.createDataFrame([], "work_id int")
    chapters, revisions, after = import_flow.first_commit(named, items, none, import_flow.processor_version("txt"))
    assert chapters.count() == revisions.count() == 3 and revisions.select("id").distinct().count() == 3
    assert {r.job_id[-5:]: r.outcome for r in after.collect()} == {"a.txt": "committed", "b.txt": "committed", "c.txt": "not_committable"}
    again = import_flow.first_commit(after.drop("outcome"), items, chapters.select("work_id"), "v")
    assert again[0].count() == 0 and {r.outcome for r in again[2].collect()} == {"already_committed", "not_committable"}
    live = chapters.withColumn("merged_into_chapter_id", F.lit(None).cast("string")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    first = live.where("work_id = 1 AND position = 1").first()
    decided = spark.createDataFrame([(1, 9, "update", first.id), (1, 8, "keep", "other")], "work_id int, item_id long, action string, chapter_id string")
    changed = spark.createDataFrame([(9, "j", "T", "k", "h")], "item_id long, job_id string, title string, content_key string, body_hash string")
    new, moved, changes = import_flow.overwrite(decided, changed, live, "v")
    c = changes.first()
    assert (c.chapter_id, c.previous_revision_id, c.revision_id) == (first.id, first.head_revision_id, new.first().id)
    assert moved.where(F.col("head_revision_id") == c.revision_id).count() == 1 and moved.count() == 3
    queued, kept, gone = import_flow.reanalyze(jobs, items, jobs.where("job_id LIKE '%a.txt'").select("job_id"), items.where("title = '甲'").select("content_key"))
    assert {r.job_id[-5:]: r.status for r in queued.collect()}["a.txt"] == "queued" and kept.count() == 1 and gone.count() == 1


def test_projections(spark):
    works = spark.createDataFrame([(1, "public", 10), (2, "draft", None), (3, "removed", 30), (4, "unlisted", None)], "id int, visibility string, active_release_id int")
    assert [(r.access, r.source) for r in projections.gate(works).orderBy("id").collect()] == [("ok", "release"), ("forbidden", None), ("work_not_found", None), ("ok", "none")]
    assert projections.gate(works, "admin").where("id = 2").first().source == "head"
    matched = spark.createDataFrame([(1, i, i, "ambiguous" if i % 2 else "new", None, None, None, True) for i in range(1, 90)], "work_id int, item_id long, position int, class string, matched_chapter_id long, insert_after_id long, insert_before_id long, position_confident boolean")
    lost = spark.createDataFrame([(1, 500, 3)], "work_id int, id long, position int")
    rows = projections.review_rows(matched, lost, spark.createDataFrame([], "id long, label_raw string"))
    page = projections.review_page(rows, "pending", 2).collect()
    assert len(page) == 5 and {r.total for r in page} == {45} and projections.review_page(rows, "missing").first().nth == 89
    assert [r.next_offset for r in projections.offset_page(spark.range(7), ["id"], 4, 2).collect()] == [6, 6] and projections.offset_page(spark.range(7), ["id"], 6, 2).first().next_offset is None


def test_merge_and_sweeps(spark):
    chapters = spark.createDataFrame([(1, 10, 1, None), (1, 11, 2, None), (1, 12, 3, None)], "work_id int, id long, position int, merged_into_chapter_id long")
    bodies = spark.createDataFrame([(10, "a"), (11, "b\n\nc"), (12, "z")], "id long, body string")
    c, b = publishing.merge_chapters(chapters, bodies, spark.createDataFrame([(10, 11)], "id long, next_id long"))
    assert {(r.id, r.merged_into_chapter_id) for r in c.collect()} == {(10, None), (11, 10), (12, None)}
    assert {(r.id, r.body) for r in b.collect()} == {(10, "a\n\nb\n\nc"), (11, "b\n\nc"), (12, "z")}
    now = F.lit("2024-06-01").cast("timestamp")
    d = lambda day: dt.datetime(2024, 4, day) if day else None
    late = dt.datetime(2024, 5, 30)
    sessions = spark.createDataFrame([(1, d(1), None), (2, late, None), (3, late, d(2))], "id int, expires_at timestamp, revoked_at timestamp")
    assert [r.id for r in maintenance.expired_sessions(sessions, now).orderBy("id").collect()] == [1, 3]
    resets = spark.createDataFrame([(1, late, d(1)), (2, late, late), (3, d(3), None)], "id int, expires_at timestamp, used_at timestamp")
    assert sorted(r.id for r in maintenance.spent_resets(resets, now).collect()) == [1, 3]
