"""Matching, merging, publishing, catalog rules, state folds, streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.operators import activity, catalog, ingest, maintenance, publishing
from lectern.streaming import events

E = "work_id int, id long, label_key string, position int, body_hash string, resource_digest string"
S = "work_id int, item_id long, label_key string, position int, body_hash string, resource_digest string"


def chapter_rows(numbers, changed=()):
    return [(1, i, f"ch:{n}", p, f"h{n}{'x' if n in changed else ''}", "") for p, (i, n) in enumerate(enumerate(numbers, 1), 1)]


def classes(spark, existing, source):
    out = ingest.match(spark.createDataFrame(existing, E), spark.createDataFrame(source, S)).cache()
    return out, {r["class"]: r.n for r in ingest.histogram(out).collect() if r.n}


def test_match(spark):
    base = [str(i) for i in range(1, 181)]
    revised = ("101", "102", "103", "104")
    out, n = classes(spark, chapter_rows(base), chapter_rows([str(i) for i in range(1, 191)], revised))
    assert n == {"unchanged": 176, "modified": 4, "new": 10} and not ingest.needs_review(out).first().needs_review
    between = [str(i) for i in range(1, 88)] + ["87.5"] + [str(i) for i in range(88, 191)]
    out, n = classes(spark, chapter_rows(base), chapter_rows(between, revised))
    assert n["new"] == 11
    new = out.where("class = 'new' AND item_id = 88").first()
    assert (new.insert_after_id, new.insert_before_id, new.position_confident) == (87, 88, True)
    added = out.where("class = 'new'").select("work_id", "item_id", "position", "insert_after_id")
    merged = ingest.merge_order(spark.createDataFrame(chapter_rows(base), E), added)
    assert merged.count() == 191 and merged.where("item_id = '88'").first().position == 88
    out, n = classes(spark, chapter_rows(base), chapter_rows(base[:170]))
    assert n == {"unchanged": 170} and ingest.missing(spark.createDataFrame(chapter_rows(base), E), out).count() == 10
    out, n = classes(spark, chapter_rows(base), chapter_rows([str(i) for i in range(181, 191)]))
    assert n == {"new": 10} and out.where("position_confident").count() == 0
    # a key that only the source repeats; chapters that nothing matches between anchors, or after the last
    one = [(1, 1, "ch:1", 1, "h1", "")]
    assert classes(spark, one, [(1, 1, "ch:1", 1, "h1", ""), (1, 2, "ch:2", 2, "h2", ""), (1, 3, "ch:2", 3, "h3", "")])[1] == {"unchanged": 1, "ambiguous": 2}
    out, n = classes(spark, chapter_rows(["1", "2", "3"]), [(1, 1, "ch:1", 1, "h1", ""), (1, 2, "ch:x", 2, "hx", ""), (1, 3, "ch:3", 3, "h3", "")])
    assert n == {"unchanged": 2, "structural_conflict": 1} and out.where("class = 'structural_conflict'").first().insert_before_id == 3
    out, n = classes(spark, chapter_rows(["1", "2"]), [(1, 1, "ch:1", 1, "h1", ""), (1, 2, "ch:9", 2, "h9", "")])
    assert n == {"unchanged": 1, "structural_conflict": 1} and out.where("class = 'structural_conflict'").first().insert_after_id is None
    one = [(1, 1, "ch:1", 1, "h1", "a")]
    assert classes(spark, one, [(1, 1, "ch:1", 1, "h1", "b")])[1] == {"modified": 1}
    assert classes(spark, one, [(1, 1, "ch:1", 1, "h1", "a"), (1, 2, "ch:1", 2, "h2", "a")])[1] == {"ambiguous": 2}
    assert classes(spark, one, [(1, 1, None, 1, "h1", "a")])[1] == {"ambiguous": 1}


def test_decide_and_renumber(spark):
    out, _ = classes(spark, chapter_rows(["1", "2", "3"]), chapter_rows(["1", "2", "3", "4"], ("2",)))
    none = spark.createDataFrame([], "work_id int, item_id long, choice string, target long")
    s = ingest.summary(ingest.decide(out, none), ingest.missing(spark.createDataFrame(chapter_rows(["1", "2", "3"]), E), out)).first()
    assert (s.added, s.updated, s.unchanged, s.modified_kept, s.skipped, s.missing_kept) == (1, 0, 2, 1, 0, 0)
    two = spark.createDataFrame([(1, 4, "match", 2)], none.schema)
    assert sorted(r.item_id for r in ingest.decide(out, two, "overwrite").where("action = 'unresolved'").collect()) == [2, 4]
    rows = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "work_id int, id long, position int")
    got = ingest.renumber(rows, spark.createDataFrame([(1, 1), (1, 3), (1, 4), (1, 9)], "work_id int, position int"))
    assert [r.position for r in got.orderBy("id").collect()] == [2, 5, 6, 7, 8]


def test_publish(spark):
    works = spark.createDataFrame([(1,), (2,)], "id long")
    chapters = spark.createDataFrame([(1, 10, 100, 1, "1", "a"), (1, 11, 111, 2, "2", "b"), (1, 12, 120, 3, "3", "c")], "work_id long, id long, head_revision_id long, position int, label_raw string, title string")
    before = spark.createDataFrame([(1, 10, 100, 1), (1, 11, 110, 2), (1, 13, 1, 3)], "work_id long, chapter_id long, revision_id long, position int")
    rel, items, ev = publishing.publish(works, chapters, spark.createDataFrame([(1, 4)], "work_id long, version int"), before)
    assert [(r.work_id, r.version, r.chapter_count) for r in rel.collect()] == [(1, 5, 3)] and items.count() == 3
    e = ev.first()
    assert list(e.new_ids) == [12] and list(e.updated_ids) == [11]
    c = spark.createDataFrame([(1, 10, 1, None), (1, 11, 2, None)], "work_id long, id long, position int, deleted_at timestamp")
    b = spark.createDataFrame([(10, "a\n\nb\n\nc"), (11, "z")], "id long, body string")
    cs, bs = publishing.split_chapter(c, b, 10, 20, 1)
    assert {(r.id, r.position) for r in cs.collect()} == {(10, 1), (20, 2), (11, 3)} and {(r.id, r.body) for r in bs.collect()} == {(10, "a"), (20, "b\n\nc"), (11, "z")}
    gone = publishing.soft_delete(c, 10, F.current_timestamp())
    assert gone.where("deleted_at IS NOT NULL").count() == 1 and publishing.soft_delete(gone, 11, F.current_timestamp()).where("deleted_at IS NOT NULL").count() == 1
    w = spark.createDataFrame([(1, "public", 3)], "id long, visibility string, edit_version int")
    assert publishing.set_removed(publishing.set_removed(w, 1, True), 1, False).first()[1:] == ("draft", 5)


def test_transitions(spark):
    states = list(maintenance.TRANSITIONS)
    rows = [(a, b) for a in states for b in states]
    bad = {tuple(r) for r in maintenance.illegal(spark.createDataFrame(rows, "before string, after string")).collect()}
    assert ("queued", "failed") in bad and ("queued", "cancelled") not in bad and ("applied", "reverted") not in bad and ("cancelled", "queued") in bad
    assert len(bad) == 81 - 17


def test_cursor():
    f = catalog.Filter(q="x", tag_ids=("b", "a"))
    assert f.fingerprint() == catalog.Filter(q="x", tag_ids=("a", "b"), tag_mode="all").fingerprint() != catalog.Filter(q="x").fingerprint()
    raw = catalog.encode_cursor(f.fingerprint(), "k", 5)
    assert catalog.decode_cursor(raw, f.fingerprint()) == ("k", 5)
    with pytest.raises(ValueError, match="cursor_filter_mismatch"):
        catalog.decode_cursor(raw, "other")
    for bad in ("", "!!", catalog.base64.urlsafe_b64encode(b"null").decode(), catalog.base64.urlsafe_b64encode(b"{}").decode()):
        with pytest.raises(ValueError, match="invalid_cursor"):
            catalog.decode_cursor(bad, "f")
    for kw in ({"statuses": ("x",)}, {"tag_ids": (1,), "exclude_tag_ids": (1,)}, {"sort": "z"}, {"q": "a" * 101}):
        with pytest.raises(catalog.InvalidFilter):
            catalog.Filter(**kw)
    with pytest.raises(PermissionError):
        catalog.Filter(hide_finished=True)
    u = "0123ABCD-0000-0000-0000-000000000000"
    assert catalog.id_list(f" {u},{u.lower()},") == (u.lower(),) and [catalog.limit_of(x) for x in (0, 99, "x", 7)] == [1, 50, 20, 7]


def test_folds(spark):
    w = spark.createDataFrame([(1, 1, s, b, s * 10) for s, b in ((1, 0), (2, 1), (3, 1), (4, 2), (5, 0))], "user_id int, work_id int, seq long, base_version int, position int")
    assert activity.merge_progress(w).first()[2:] == (3, 40, 2)
    hits = spark.createDataFrame([("k", t, i) for i, t in enumerate((0, 1, 2, 9, 10, 11, 12))], "key string, at int, hit_id long")
    assert [r.admitted for r in maintenance.rate_limit(hits, 2, 10).orderBy("hit_id").collect()] == [True, True, False, False, True, True, False]


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 15, 59)
    rows = [(1, 7, t0), (1, 7, t0 + dt.timedelta(seconds=10)), (1, 7, t0 + dt.timedelta(minutes=2)), (2, 7, t0), (9, 9, t0 + dt.timedelta(days=9))]
    spark.createDataFrame([(*r, 30) for r in rows], "work_id long, visitor long, ts timestamp, seconds long").withColumn("user_id", F.col("visitor")).coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
        return spark.table(name)

    clicks = run(events.click_stream(src), "clicks_out", "append")
    assert clicks.count() == 4 == activity.click_rows(spark.read.parquet(f"{tmp_path}/in")).count()
    spent = run(events.activity_stream(src), "spent_out", "complete")
    assert {(r.user_id, str(r.activity_date), r.active_seconds) for r in spent.collect()} == {(7, "2024-01-01", 120), (9, "2024-01-10", 30)}
    closed = run(events.session_stream(src), "sessions_out", "append")
    assert sorted(r.beats for r in closed.collect()) == [1, 3]
