"""A reader's state, bookmarks, references, settings, edits and leases on small and awkward tables."""

from datetime import datetime

from pyspark.sql import functions as F

from lectern.functions import scalars
from lectern.operators import catalog, ingest, maintenance, projections, publishing

U = "{0:08x}-0000-4000-8000-{0:012x}"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_reading_state(spark):
    asked = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, 9)], "user_id int, work_id int")
    library = spark.createDataFrame([(1, 1), (1, 1)], "user_id int, work_id int")
    follows = spark.createDataFrame([(1, 1, 2), (2, 1, None)], "user_id int, work_id int, last_seen int")
    releases = spark.createDataFrame([(1, 1), (1, 4)], "work_id int, version int")
    events = spark.createDataFrame([(1, 1, 5), (1, 3, 7), (1, 4, 2)], "work_id int, release_version int, n_new int")
    got = {(r.user_id, r.work_id): tuple(r)[2:] for r in projections.reading_state(asked, library, follows, releases, events).collect()}
    assert got == {(1, 1): (True, True, 2, 4, 9), (1, 2): (False, False, None, None, 0), (2, 1): (False, True, None, 4, 14), (3, 9): (False, False, None, None, 0)}
    assert projections.reading_state(asked.limit(0), library, follows, releases, events).count() == 0


def test_bookmark_pages(spark):
    marks = spark.createDataFrame([(i, i % 2, 1 + i % 3, 10 + i % 3, 0, None, datetime(2024, 1, 1 + i // 4)) for i in range(20)], "id int, user_id int, work_id int, chapter_id int, paragraph_index int, note string, created_at timestamp")
    works = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "id int, title string")
    chapters = spark.createDataFrame([(10, "c0"), (11, "c1"), (12, "c2")], "id int, label_raw string")
    pages = [projections.bookmark_pages(marks, works, chapters, limit=4, offset=o).where("user_id = 0").collect() for o in (0, 4, 8, 12)]
    assert [{r.id for r in p} for p in pages] == [{18, 16, 14, 12}, {10, 8, 6, 4}, {2, 0}, set()]
    assert [{r.next_offset for r in p} for p in pages] == [{4}, {8}, {None}, set()] and {r.total for r in pages[0]} == {10}
    mine = projections.bookmark_pages(marks, works, chapters, work_id=2, limit=100).collect()
    assert {r.work_title for r in mine} == {"B"} and {r.total for r in mine if r.user_id == 0} == {sum(i % 2 == 0 and i % 3 == 1 for i in range(20))}
    assert {tuple(r) for r in projections.bookmark_works(marks, works).collect()} == {(u, w, t) for u in (0, 1) for w, t in ((1, "A"), (2, "B"), (3, "A"))}
    assert projections.bookmark_pages(marks.limit(0), works, chapters).count() == 0


def test_offset_page(spark):
    rows = spark.range(25).select((24 - F.col("id")).alias("k"))
    assert [(r.k, r.next_offset) for r in projections.offset_page(rows, ["k"], 10, 5).orderBy("k").collect()] == [(k, 15) for k in range(10, 15)]
    assert {r.next_offset for r in projections.offset_page(rows, ["k"], 20, 5).collect()} == {None}
    assert projections.offset_page(rows, ["k"], 100, 5).count() == projections.offset_page(rows.limit(0), ["k"], 0, 5).count() == 0
    assert [r.k for r in projections.offset_page(rows, [F.desc("k")], -3, 0).collect()] == [24]


def test_references(spark):
    works = spark.createDataFrame([(U.format(i), f"t{i}") for i in (1, 2)] + [(U.format(2)[:8] + U.format(3)[8:], "twin")], "id string, title string")
    chapters = spark.createDataFrame([(U.format(50), U.format(1)), (U.format(50)[:8] + U.format(51)[8:], U.format(2))], "id string, work_id string")
    refs = spark.createDataFrame([("a-title-00000001",), ("00000002",), (U.format(9).upper(),), ("no id",), ("",), (None,)], "segment string")
    got = {r.segment: r.work_id for r in catalog.resolve_works(refs, works).collect()}
    assert got == {"a-title-00000001": U.format(1), "00000002": min(U.format(2), U.format(2)[:8] + U.format(3)[8:]), U.format(9).upper(): U.format(9), "no id": None, "": None, None: None}
    asked = spark.createDataFrame([("x-00000001", "c-00000032"), ("x-00000002", "c-00000032"), (None, "c-00000032"), (None, U.format(50)), ("x-00000001", None)], "work string, segment string")
    got = [r.chapter_id for r in catalog.resolve_chapters(asked, works, chapters).select("work", "segment", "chapter_id").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [U.format(50), U.format(50)[:8] + U.format(51)[8:], None, U.format(50), None]))


def test_settings_and_requests(spark):
    default = one(spark, scalars.settings(F.lit("{}")))
    assert default.asDict() == {"theme": "system", "fontSize": 18.0, "lineHeight": 1.9, "paragraphSpacing": 0.9, "mode": "scroll", "conversion": "original", "warmth": 0, "autoSpeed": 2, "nightFrom": 19, "nightTo": 7, "autoContinue": False}
    for raw in (None, "no json", '{"fontSize":"NaN","warmth":9,"nightFrom":3.5,"theme":"light","mode":3}', '{"fontSize":"Infinity","warmth":-1,"nightTo":24}'):
        assert one(spark, scalars.settings(F.lit(raw).cast("string"))) == default
    some = one(spark, scalars.settings(F.lit('{"v":2,"theme":"light","fontSize":99,"lineHeight":"1","warmth":3,"nightFrom":0,"autoContinue":true,"conversion":"cn"}')))
    assert (some.theme, some.fontSize, some.lineHeight, some.warmth, some.nightFrom, some.autoContinue, some.conversion) == ("light", 28.0, 1.4, 3, 0, True, "cn")
    assert list(one(spark, scalars.id_list(F.lit(f" {U.format(2).upper()},{U.format(1)} ,, {U.format(2)}")))) == [U.format(1), U.format(2)]
    assert one(spark, scalars.id_list(F.lit(f"{U.format(1)},x"))) is None and list(one(spark, scalars.id_list(F.lit(None).cast("string")))) == []
    assert [one(spark, scalars.page_size(F.lit(x).cast("string"))) for x in (None, "", "0", "7", "-2", "99", "x")] == [20, 20, 20, 7, 1, 50, 20]


def test_review_targets(spark):
    rows = [(i, 1, f"Ch {i}", i, None, None) for i in range(60)] + [(100, 1, "Ch gone", 5, 3, None), (101, 1, "Ch gone", 6, None, "x"), (102, 2, "Ch 1", 1, None, None)]
    chapters = spark.createDataFrame(rows, "id int, work_id int, label_raw string, position int, merged_into_chapter_id int, deleted_at string")
    assert [r.id for r in ingest.review_targets(chapters, 1).collect()] == list(range(41))
    assert [r.id for r in ingest.review_targets(chapters, 1, " h _5 ").collect()] == [15, 25, 35, 45, 55]


def test_edits(spark):
    works = spark.createDataFrame([(1, 3), (2, 0)], "id int, edit_version int")
    chapters = spark.createDataFrame([(10, 1, "a", 100, None, None), (11, 1, "b", 101, None, None), (12, 1, "c", None, None, None), (13, 2, "d", 103, 10, None), (14, 1, "e", 104, None, None)], "id int, work_id int, label_raw string, head_revision_id int, merged_into_chapter_id int, deleted_at string")
    revisions = spark.createDataFrame([(100, 10, "A", "k0"), (101, 11, "B", "k1"), (104, 14, "E", "k4")], "id int, chapter_id int, title string, content_key string")
    edits = spark.createDataFrame([(10, 100, 200, "a", "A", "new"), (11, 101, 201, "b", "B", "k1"), (12, 1, 202, "c", "C", "k"), (13, 103, 203, "d", "D", "k"), (14, 99, 204, "e", "E", "k"), (99, 1, 205, "x", "X", "k")], "chapter_id int, expected_revision_id int, new_revision_id int, label_raw string, title string, content_key string")
    outcomes, w, c, r = publishing.edit_chapters(works, chapters, revisions, edits)
    assert {x.chapter_id: x.outcome for x in outcomes.collect()} == {10: "applied", 11: "unchanged", 12: "chapter_missing_revision", 13: "chapter_not_found", 14: "stale_chapter_revision", 99: "chapter_not_found"}
    assert {x.id: x.edit_version for x in w.collect()} == {1: 4, 2: 0}
    assert {x.id: x.head_revision_id for x in c.collect()} == {10: 200, 11: 101, 12: None, 13: 103, 14: 104}
    assert r.count() == 4 and r.where("id = 200").first().content_key == "new" and c.columns == chapters.columns


def test_leases(spark):
    at = datetime(2024, 1, 1)
    jobs = spark.createDataFrame([(1, "processing", "w", at, None), (2, "processing", "v", at, None), (3, "queued", None, None, None), (4, "processing", None, at, "old")], "id int, status string, lease_owner string, lease_expires_at timestamp, error_code string")
    writes = spark.createDataFrame([(1, "w", "renew", at), (2, "w", "fail", at), (3, "w", "retry", at), (4, "w", "renew", at), (9, "w", "renew", at), (1, None, "steal", at)], "job_id int, owner string, action string, at timestamp")
    outcomes, after = maintenance.fenced(jobs, writes)
    assert sorted((r.job_id, r.outcome) for r in outcomes.collect()) == [(1, "applied"), (1, "invalid"), (2, "lease_lost"), (3, "lease_lost"), (4, "lease_lost"), (9, "lease_lost")]
    rows = {r.id: r for r in after.collect()}
    assert rows[1].lease_expires_at == datetime(2024, 1, 1, 0, 5) and rows[2].lease_owner == "v" and rows[4].error_code == "old"
    ended = maintenance.fenced(jobs, spark.createDataFrame([(1, "w", "fail", at), (2, "v", "retry", at)], writes.schema))[1]
    assert {r.id: (r.status, r.lease_owner, r.error_code) for r in ended.collect() if r.id < 3} == {1: ("failed", None, "processing_failed"), 2: ("queued", None, "processing_retry")}


def test_chapters_of_works_with_one_short_id(spark):
    """Works that share their short id keep their chapters."""
    tail = "-0000-4000-8000-00000000000"
    works = spark.createDataFrame([(f"aaaaaaaa{tail}{n}",) for n in (1, 2)], "id string")
    chapters = spark.createDataFrame([(f"{s}{tail}0", f"aaaaaaaa{tail}{n}") for s, n in (("11111111", 1), ("22222222", 2), ("33333333", 2))] + [(f"44444444{tail}0", f"bbbbbbbb{tail}0")], "id string, work_id string")
    asked = spark.createDataFrame([("t-aaaaaaaa", "x-11111111"), ("t-aaaaaaaa", "x-22222222"), (f"aaaaaaaa{tail}1", "33333333"), (f"aaaaaaaa{tail}2", "33333333"), ("bbbbbbbb", "44444444")], "work string, segment string")
    got = {(r.work, r.segment): r.chapter_id for r in catalog.resolve_chapters(asked, works, chapters).collect()}
    assert list(map(got.get, [("t-aaaaaaaa", "x-11111111"), ("t-aaaaaaaa", "x-22222222"), (f"aaaaaaaa{tail}1", "33333333"), (f"aaaaaaaa{tail}2", "33333333"), ("bbbbbbbb", "44444444")])) == [f"11111111{tail}0", f"22222222{tail}0", None, f"33333333{tail}0", None]
