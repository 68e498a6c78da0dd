"""Forms for hot keys and large stores: the gram index, scans, selection, streams, sinks."""

import hashlib
import random
import re
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.operators import gram_index, ingest, maintenance, projections, search, toc
from lectern.sources import book_files, epub_files, exports


def book(spark, bodies, titles=()):
    titles = dict(titles)
    chapters = spark.createDataFrame([(i, titles.get(i, f"t{i}"), f"k{i}") for i in range(len(bodies))], "position int, title string, key string")
    return chapters, spark.createDataFrame([(f"k{i}", b) for i, b in enumerate(bodies)], "key string, body string")


def scanned(chapters, bodies, variants, **more):
    return [tuple(r) for r in search.search_book(chapters.join(bodies, "key", "left").withColumn("body", F.coalesce("body", F.lit(""))), variants, **more).collect()]


def test_index_search_equals_the_scan(spark, tmp_path):
    bodies = [f"para {i}\n\n" + ("the Needle\t is 😀 here " if i % 7 == 0 else "hay ") + "x" * (i % 50) for i in range(150)] + ["小龍在此", None, "", "nee\n\ndle", "[[img:" + "a" * 64 + "|needle]]", "ab"]
    chapters, texts = book(spark, bodies, {3: "a needle in the title", 151: "Needle"})
    index = gram_index.GramIndex(spark, f"{tmp_path}/index", 4).add(texts)
    for variants in (["needle"], ["needle", "小龍在"], ["😀 he"], ["needle is"], ["zzz"], ["ab"], ["ne"], ["needle", "x"]):
        got = [tuple(r) for r in gram_index.search_page(chapters, index, variants, limit=500).collect()]
        assert got == scanned(chapters, texts, variants, limit=500), variants
    # page after page by cursor, each hit once
    pages, cursor = [], None
    while True:
        page, cursor = gram_index.search_next(chapters, index, ["needle"], "q", "r", cursor, limit=5)
        pages.append([tuple(r) for r in page.collect()])
        if cursor is None:
            break
    assert [len(p) for p in pages] == [5, 5, 5, 5, 4] and sum(pages, []) == scanned(chapters, texts, ["needle"], limit=500)
    first = gram_index.search_next(chapters, index, ["needle"], "q", "r", None, 5)[1]
    with pytest.raises(ValueError, match="search_version_changed"):
        gram_index.search_next(chapters, index, ["needle"], "q", "other", first)
    assert gram_index.search_page(chapters.limit(0), index, ["needle"]).count() == 0


def test_index_reads_candidates_only(spark, tmp_path):
    """Slices of bodies without a candidate can be gone: nobody opens them."""
    chapters, texts = book(spark, [f"text number {i} " + ("rare words" if i == 41 else "") for i in range(300)])
    index = gram_index.GramIndex(spark, f"{tmp_path}/index").add(texts)
    held = gram_index.slices_of(["k41"])
    gone = [p for p in Path(f"{tmp_path}/index/bodies").glob("slice=*") if int(p.name[6:]) not in held]
    assert len(gone) > 50
    for p in gone:
        shutil.rmtree(p)
    assert [r.position for r in gram_index.search_page(chapters, index, ["rare words"]).collect()] == [41]
    plan = index.bodies(["k41"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*slice", plan) and "EqualTo(key,k41)" in plan


def test_index_grows_and_may_lag(spark, tmp_path):
    chapters, texts = book(spark, [f"body {i} needle" for i in range(20)])
    early = texts.where("key < 'k14'")
    index = gram_index.GramIndex(spark, f"{tmp_path}/index", 4).add(early)
    # what isn't indexed is read from the store, or matched by its title where the store lacks it
    assert gram_index.search_page(chapters, index, ["needle"], bodies=texts).count() == 20
    assert gram_index.search_page(chapters, index, ["needle"]).count() == early.count()
    index.add(texts).add(texts)
    assert gram_index.search_page(chapters, index, ["needle"]).count() == 20
    assert index.read("indexed").count() == 20 and index.read("postings").count() == index.read("postings").distinct().count()


def test_index_cuts_long_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gram_index, "STRETCH", 10)
    text = "0123456789abcdefghij" * 3 + "the end"
    df = spark.createDataFrame([("k", text), ("k2", "ab")], "key string, body string")
    assert {r.gram for r in gram_index.grams_of(df, "key", "body").collect()} == {text[i : i + 3] for i in range(len(text) - 2)}


def test_a_work_that_half_of_all_follow(spark):
    """New chapters by scan: the hot work's rows are spread, and every count is right."""
    follows = spark.range(6000).select(F.col("id").alias("user_id"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 40).cast("int").alias("work_id"), F.when(F.col("id") % 11 != 0, (F.col("id") % 9).cast("int")).alias("last_seen"))
    events = spark.range(200).select((F.col("id") % 20).cast("int").alias("work_id"), (F.col("id") / 20).cast("int").alias("release_version"), (F.col("id") % 4).alias("n_new"))
    got = {r.user_id: (r.latest_version, r.new_chapters) for r in projections.newer_than(follows, events, "last_seen").collect()}
    by = {}
    for e in events.collect():
        by.setdefault(e.work_id, []).append((e.release_version, e.n_new))
    for f in follows.collect():
        of = by.get(f.work_id, [])
        assert got[f.user_id] == (max((v for v, _ in of), default=None), sum(n for v, n in of if v > (f.last_seen or 0)))
    assert projections.newer_than(follows.limit(0), events, "last_seen").count() == 0
    assert {r.new_chapters for r in projections.newer_than(follows, events.limit(0), "last_seen").collect()} == {0}
    plan = projections.newer_than(follows, events, "last_seen")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not re.search(r"windowspecdefinition\(work_id#\d+,[^)]*v#", plan)  # no order within a whole work


def test_exact_percentiles(spark):
    rng = random.Random(3)
    data = {"hot": [rng.choice([0.0, -0.0, 1.5, 1.5000001, -2.0, 1e300, -1e-300, float("inf")]) for _ in range(3000)], "one": [4.25], "wide": [rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30) for _ in range(777)], None: [1.0, 2.0, 3.0], "many": [float(rng.randint(0, 50)) for _ in range(1000)]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in [*vs, None]], "name string, ms double")
    got = {r.name: (r.p50, r.p95, r.max) for r in maintenance.percentiles(df).collect()}
    assert got == {g: (sorted(vs)[-(-len(vs) * 50 // 100) - 1], sorted(vs)[-(-len(vs) * 95 // 100) - 1], max(vs)) for g, vs in data.items()}
    assert maintenance.percentiles(df.limit(0)).count() == 0


def names_in(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file()) if Path(folder).exists() else []


def test_files_appear_on_commit(spark, tmp_path):
    folder = f"{tmp_path}/out"
    df = spark.createDataFrame([(f"a/{i}.txt", f"text {i} 龍") for i in range(40)] + [("b.epub", None)], "file string, content string").repartition(5)
    book_files.write_files(df, folder, F.col("file"), F.col("content"))
    assert names_in(folder) == sorted([f"a/{i}.txt" for i in range(40)] + ["b.epub"])
    got = {r.file: bytes(r.content).decode() for r in book_files.read_files(spark, folder, ".txt").collect()}
    assert got == {f"a/{i}.txt": f"text {i} 龍" for i in range(40)}
    # appending keeps the rest and replaces a file of the same name; overwriting leaves the new files only
    book_files.write_files(df.limit(0).unionByName(spark.createDataFrame([("a/3.txt", "new"), ("c.txt", "c")], df.schema)), folder, F.col("file"), F.col("content"))
    assert len(names_in(folder)) == 42 and Path(folder, "a/3.txt").read_text() == "new"
    book_files.write_files(spark.createDataFrame([("only.txt", "x")], df.schema), folder, F.col("file"), F.col("content"), overwrite=True)
    assert names_in(folder) == ["only.txt"] and book_files.read_files(spark, folder).count() == 1


@pytest.mark.parametrize("bad", ["../up.txt", "_hidden", "", "a/.x", "ok-7.txt"])
def test_an_aborted_write_leaves_nothing(spark, tmp_path, bad):
    """A task that fails, or two rows for one file: no file appears, and none is left in the staging folder."""
    folder = f"{tmp_path}/out"
    df = spark.createDataFrame([(f"ok-{i}.txt", "x") for i in range(20)] + [(bad, "y")], "file string, content string").repartition(4)
    with pytest.raises(Exception, match="not a file name|two rows"):
        book_files.write_files(df, folder, F.col("file"), F.col("content"))
    assert names_in(folder) == []


def test_books_and_sitemaps_as_files(spark, tmp_path):
    ids = [f"{i:08x}-0000-4000-8000-{i * 7919 % 997:012x}" for i in range(50)]
    works = spark.createDataFrame([(i, "Same title", "A", f"2024-01-{1 + k % 28:02d}") for k, i in enumerate(ids)], "id string, title string, author string, day string").withColumns({"created_at": F.to_timestamp("day"), "lastmod": F.to_timestamp("day")})
    chapters = works.select(F.col("id").alias("work_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("position")).select("*", F.concat(F.lit("第"), F.col("position").cast("string"), F.lit("章")).alias("label_raw"), F.lit("頭").alias("title"), F.concat(F.lit("body "), "work_id", F.col("position").cast("string")).alias("body"))
    book_files.write_files(exports.txt(works, chapters), f"{tmp_path}/txt", book_files.book_name(F.col("id"), F.col("file")), F.col("content"))
    texts = {r.file: bytes(r.content).decode("utf-8-sig") for r in book_files.read_files(spark, f"{tmp_path}/txt").collect()}
    assert set(texts) == {f"{i}-Same title.txt" for i in ids} and all(f"body {i}2" in texts[f"{i}-Same title.txt"] for i in ids)
    chapters = chapters.withColumn("body_key", F.sha2("body", 256))
    book_files.write_files(exports.epub(works, chapters), f"{tmp_path}/epub", F.concat("id", F.lit(".epub")), F.col("content"))
    read = epub_files.chapters(book_files.read_files(spark, f"{tmp_path}/epub", ".epub")).where("error IS NULL")
    assert read.count() == 150 and read.where("body LIKE '%body %'").count() == 150
    # UUIDs in order of making, in the protocol's frame
    book_files.write_files(exports.sitemap_files(works, "https://x.example", "works", 20), f"{tmp_path}/map", F.col("file"), F.col("content"))
    files = {r.file: bytes(r.content).decode() for r in book_files.read_files(spark, f"{tmp_path}/map").collect()}
    urls = [u for n in (1, 2, 3) for u in re.findall(r"<loc>([^<]*)</loc>", files[f"sitemap-works-{n}.xml"])]
    want = [r.id for r in works.orderBy("created_at", "id").collect()]
    assert urls == [f"https://x.example/same-title-{i[:8]}" for i in want] and len(files) == 3
    assert all(f.startswith("<?xml") and f.endswith("</urlset>") for f in files.values())
    index = exports.sitemap_index_file(spark.createDataFrame([("works", 2), ("works", 1)], "kind string, page int"), "https://x.example").first().content
    assert re.findall(r"<loc>([^<]*)</loc>", index) == ["https://x.example/sitemap-works-1.xml", "https://x.example/sitemap-works-2.xml"]


def test_a_body_that_very_many_items_share(spark):
    """A million items with one hash: findings are rows, and no row or task holds them all."""
    items = spark.range(1_000_000, numPartitions=8).select(F.lit(1).alias("job_id"), F.col("id").alias("position"), F.lit(None).cast("string").alias("volume"), F.lit(None).cast("string").alias("label_key"), F.lit("f").alias("family"), F.lit(None).cast("int").alias("number"), F.when(F.col("id") % 100_000 == 7, F.concat(F.lit("own"), F.col("id").cast("string"))).otherwise("same").alias("body_hash"))
    got = ingest.quality(items)
    assert got.groupBy("type", "finding").count().collect() == [("duplicate_body", 0, 999_990)]
    assert dict(got.dtypes)["position"] == "bigint"


def test_version_token_is_a_tree(spark):
    rows = [(w, p, 1000 * w + p, f"label {p}") for w, n in ((1, 1), (2, 8), (3, 9), (4, 700)) for p in range(n)]
    df = spark.createDataFrame(rows, "work_id int, position int, id int, label_raw string")

    def token(lines, chunk):
        while True:
            lines = [hashlib.sha256("\n".join(lines[i : i + chunk]).encode()).hexdigest() for i in range(0, len(lines), chunk)]
            if len(lines) == 1:
                return lines[0]

    want = {w: token([f"{p}:{i}:{label}" for x, p, i, label in rows if x == w], 8) for w in (1, 2, 3, 4)}
    assert {r.work_id: r.toc_version for r in toc.version_token(df.repartition(5), 8).collect()} == want
    changed = df.withColumn("label_raw", F.when(F.col("id") == 4333, "other").otherwise(F.col("label_raw")))
    other = {r.work_id: r.toc_version for r in toc.version_token(changed, 8).collect()}
    assert other[4] != want[4] and {w: other[w] for w in (1, 2, 3)} == {w: want[w] for w in (1, 2, 3)}
    assert toc.version_token(df.limit(0)).count() == 0


def test_small_files_go_together(tmp_path):
    """Many small files are few partitions, and the driver holds their names packed."""
    from lectern.sources.book_files import FileReader, unpacked

    for i in range(900):
        (tmp_path / f"{i}.txt").write_text("x")
    parts = FileReader(str(tmp_path), ".txt").partitions()
    assert len(parts) == 1 and len(parts[0].value) < 4_000 and sorted(unpacked(parts[0].value)) == sorted(f"{i}.txt" for i in range(900))


def test_books_are_packed_together(spark):
    """No call of Python for each book, and a book's pages in their order whatever row they come in."""
    from lectern.sources import epub_files, exports

    works = spark.createDataFrame([(i, f"t{i}", "a") for i in range(300)], "id long, title string, author string")
    chapters = spark.createDataFrame([(i, p, f"Ch {p}", f"Ch {p}", f"text {i} {p}", f"{i}-{p}") for p in (2, 10, 1) for i in range(300)], "work_id long, position int, label_raw string, title string, body string, body_key string")
    books = exports.epub(works, chapters)
    assert "CoGroup" not in books._jdf.queryExecution().executedPlan().toString()
    read = epub_files.chapters(books.selectExpr("cast(id as string) as path", "content"))
    got = sorted((int(r.path), r.position, r.body) for r in read.select("path", "position", "body").collect())
    assert got == [(i, n, f"Ch {p}\n\ntext {i} {p}") for i in range(300) for n, p in enumerate((1, 2, 10))]


def test_pairs_of_labels_are_not_broadcast(spark):
    """However small the file of labels is."""
    import __spark_entry__

    plan = __spark_entry__.queries()["same_numbers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
