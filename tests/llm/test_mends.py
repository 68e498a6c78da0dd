"""Cases that went wrong before: few labels, repeated ids and rows, comments in articles, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import decontamination, html_text, mixing, near_dedup, quality


@pytest.mark.parametrize("n", [0, 1, 2, 10, 47])
def test_quality_with_few_labels(n):
    rng = np.random.default_rng(n)
    x, y = rng.random((n, 4)), (np.arange(n) % 2).astype(float)
    model = quality.fit(x, y, ["a", "b", "c", "d"])
    assert np.isfinite(model.intercept) and (n >= 48 or not model.rules)


def test_quality_of_constant_statistics():
    y = (np.arange(4000) % 4 == 0).astype(float)
    model = quality.fit(np.ones((4000, 3)), y, ["a", "b", "c"])
    assert model.rules == [] and abs(1 / (1 + np.exp(-model.intercept)) - 0.25) < 1e-6


def test_quality_sample_has_a_row_an_id(spark, monkeypatch):
    docs = spark.range(10).withColumn("nr", F.explode(F.sequence(F.lit(1), F.lit(400)))).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("nr").cast("string")).alias("text"))
    labels = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    taught = []
    monkeypatch.setattr(quality, "fit", lambda x, y, names, keep=quality.fit: taught.append(len(y)) or keep(x, y, names))
    out = quality.score_quality(docs, labels, max_labelled=10)
    assert out.where("score BETWEEN 0 AND 1").count() == 4000
    assert taught and max(taught) <= 10


def texts_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.main_text(df).select("src.page_id", "text").collect()}


NAMES = ["comment-body", "user-comments", "reader-comments", "post-comments", "comment_item", "ad-slot", "sidebar-left"]


@pytest.mark.parametrize("hosts", [1, 10])
def test_named_furniture_in_an_article(spark, hosts):
    """On one host of many pages, and on hosts of one page each."""
    story = lambda i: " ".join(f"word{i}of{j}" for j in range(14))
    rows = [(i, f"http://h{i % hosts}.example/{i}", f"<body><article><p>{story(i)}</p><div class='{c}'><p>Unique words {i} of somebody</p></div></article></body>") for i, c in enumerate(NAMES)]
    rows += [(20 + i, f"http://h{i % hosts}.example/x{i}", f"<body><div><p>{story(20 + i)}</p></div><div class='{c}'><p>Unique words {i} of somebody</p></div></body>") for i, c in enumerate(["comment-item", "ad-slot", "sidebar-left"])]
    assert texts_of(spark, rows) == {r[0]: story(r[0]) for r in rows}


def test_names_that_tell_a_state_only(spark):
    text = "All of the page's text is in this wrapper"
    rows = [(i, f"http://s{i}.example/", f"<body class='{c}'><div class='{c}'><p>{text}</p></div></body>") for i, c in enumerate(["comments-open", "no-comments", "with-sidebar", "no-sidebar", "ad-free", "sidebar-wrap"])]
    assert set(texts_of(spark, rows).values()) == {text}


def test_hinted_blocks_where_nothing_can_repeat(spark):
    page = "<body><article><p>The story as it was told</p><div class='related-work'><p>w x</p></div></article></body>"
    assert texts_of(spark, [(1, "http://one.example/", page)]) == {1: "The story as it was told"}


def unmarked(html):
    """The page without the marks that tell its parts apart."""
    for name in ("article", "nav", "footer", "header", "aside"):
        html = html.replace(f"<{name}", "<div").replace(f"</{name}", "</div")
    return html.replace(' class="ad"', "")


def test_array_decides_on_unmarked_pages(spark):
    """Without marks the host's suffix array takes what its pages repeat, and leaves the stories."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("al", "er", "in", "os", "um", "ay")]
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words[:12])
    foot = "This site belongs to its owners and all rights in it are reserved by them"
    stories = {i: [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(rng.randint(2, 6))] for i in range(40)}
    rows = [(i, f"http://h{i % 4}.example/{i}", unmarked(f"<body><nav><ul>{menu}</ul></nav><article>{''.join(f'<p>{p}</p>' for p in ps)}</article><footer>{foot}</footer></body>")) for i, ps in stories.items()]
    got = texts_of(spark, rows)
    kept = [(i, p) for i in got for p in got[i].split("\n")]
    right = [(i, p) for i, p in kept if p in stories[i]]
    assert len(right) / len(kept) > 0.95 and len(right) / sum(map(len, stories.values())) > 0.95
    assert not any(foot in t for t in got.values())


def test_equal_rows_are_mixed_to_the_target(spark):
    """Of five equal rows as many are taken as come nearest to the target."""
    docs = [(1, " ".join(["w"] * 50), "a")] * 5 + [(2, " ".join(["v"] * 700), "b")] + [(i, "x y z", "c") for i in range(10, 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        largest = max(r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= largest / 2 + 1e-9 and all(r.taken <= 3 * r.size for r in rows)
    again = mixing.mixed(df).groupBy("src.source").agg(F.sum(F.col("repeats") * mixing.n_words(F.col("src.text"))).alias("n")).collect()
    assert {r.source: r.n for r in again} == {s: sum(r.taken for r in rows) for s, rows in by.items() if sum(r.taken for r in rows)}
    # a hot group of equal rows, at the edge of its source
    hot = [(1, "one two three", "a")] * 900 + [(i, "p q r s t u v", "b") for i in range(2, 400)]
    rows = mixing.mix(spark.createDataFrame(hot, "doc_id long, text string, source string")).collect()
    for source in ("a", "b"):
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= mine[0].size / 2 + 1e-9


def test_pipeline_with_clashing_columns(spark, tmp_path):
    """Documents that have columns named as the stages' own, and no n_chars."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(40)), "en", f"s{i % 2}", "mine", 1, "x") for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, Repeats string, n_words int, src string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "Repeats", "n_words", "src", "_repeats"]
    assert out.where("Repeats <> 'mine' OR src <> 'x' OR _repeats < 1").count() == 0 and out.count() > 0


def test_one_pass_of_patterns_at_a_time(spark, monkeypatch):
    """Three passes or more over the documents, with no two broadcasts alive."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    items = [(i, text(30)) for i in range(12)]
    docs = [(i, f"{text(20)} {items[i % 12][1] if i % 3 else ''} {items[(i + 5) % 12][1]}") for i in range(40)]
    alive, most = set(), []

    def counted(value, keep=spark.sparkContext.broadcast):
        b = keep(value)
        gone = b.destroy
        b.destroy = lambda *a: (alive.discard(id(b)), gone(*a))[1]
        alive.add(id(b))
        most.append(len(alive))
        return b

    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {r.src.doc_id: tuple(r)[1:] for r in decontamination.find_benchmark(df, bench).collect()}
    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    got = {r.src.doc_id: tuple(r)[1:] for r in decontamination.find_benchmark(df, bench, pass_bytes=700).collect()}
    assert got == want and len(most) >= 3 and max(most) == 1 and not alive


def near_template_texts(rng, groups, copies, words):
    """Groups of near copies of one form with filled-in places: 0.9 or more alike within a group, about 0.7 across groups."""
    template = [f"t{i}" for i in range(words)]
    texts = []
    for g in range(groups):
        own = list(template)
        for at in range(20, words, 40):  # each change of a word alters four shingles
            own[at] = f"g{g}x{at}"
        for c in range(copies):
            text = list(own)
            for _ in range(3):
                text[rng.randrange(words)] = f"c{g}x{c}x{rng.random()}"
            texts.append(" ".join(text))
    return texts


def test_near_copies_of_one_template_do_not_all_meet(spark, monkeypatch):
    """What pivots leave open is far from all pairs of a bucket, and the links are those of brute force."""
    texts = near_template_texts(random.Random(6), 60, 5, 500)
    sets = [set(zip(*[t.split()[k:] for k in range(4)])) for t in texts]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert alike(sets[0], sets[1]) >= 0.9 and 0.6 < alike(sets[0], sets[5]) < 0.8
    checked = []
    monkeypatch.setattr(near_dedup, "confirm", lambda n, p, keep=near_dedup.confirm: checked.append(1) or keep(n, p))
    pairs = []
    monkeypatch.setattr(near_dedup, "rare_meetings", lambda *a, keep=near_dedup.rare_meetings: pairs.append(near_dedup.table(keep(*a))) or pairs[-1])
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 5 for i in range(len(texts))}
    assert sum(p.count() for p in pairs) < 1000 < len(texts) ** 2 / 40


def test_rare_meetings_miss_no_link(spark):
    """Every pair of different components that is alike enough is among the candidates."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(text)
    sets = [near_dedup.shingle_set(" ".join(t).encode(), near_dedup.WordHashes(), 4) for t in texts]
    comp = [i if i % 3 else i - i % 6 for i in range(len(texts))]
    df = spark.createDataFrame([(i, " ".join(t), len(s), 1, comp[i]) for i, (t, s) in enumerate(zip(texts, sets))], "id long, text string, size long, least long, comp long")
    got = {(r.a, r.b) for r in near_dedup.rare_meetings(df, 4, 80).collect()}
    for a in range(len(texts)):
        for b in range(a):
            common = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if comp[a] != comp[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                assert (a, b) in got
    assert len(got) < len(texts) ** 2 / 4


def test_personal_data_of_long_texts(spark):
    """200,000 addresses in one text, in time that grows with it; spans at the edges of pieces are those of one piece."""
    import time

    from lectern.llm import personal_data

    one = spark.createDataFrame([(1, "mail me at a@b.example now ")], "doc_id long, text string")
    took = []
    for n in (50_000, 200_000):
        df = one.withColumn("text", F.repeat("text", F.lit(n)))
        began = time.time()
        found = personal_data.find_personal_data(df).select(F.size("spans").alias("n"), F.element_at("spans", -1)["start"].alias("last")).first()
        took.append(time.time() - began)
        assert found.n == n and found.last == 27 * (n - 1) + 11
    assert took[1] < 8 * took[0]
    rng = random.Random(11)
    parts = ["ann@mail.example", "call +1 (826) 555-4081 now", "10.0.0.1", "4111 1111 1111 1111", "bob [at] host [dot] example", "word", "version 1.2.3.4", "é漢", "\n", ", ", " ", "5105105105105100"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {}
    for size in (4000, 50):
        personal_data_piece = personal_data.PIECE
        try:
            personal_data.PIECE = personal_data_piece.replace("4000", str(size))
            spans[size] = {r.doc_id: [tuple(s)[:4] for s in r.spans if s.base] for r in personal_data.find_personal_data(df).select("src.doc_id", "spans").collect()}
        finally:
            personal_data.PIECE = personal_data_piece
    assert spans[50] == spans[4000] and sum(map(len, spans[50].values())) > 1000


def test_lists_that_grow_with_the_table(spark, monkeypatch):
    """Beyond the centroids that memory holds, lists are cut into sublists of the same size: found as well, with fewer rows compared."""
    from lectern.llm import neighbours

    rng = np.random.default_rng(5)
    middles = rng.normal(size=(200, 12)) * 4
    x = middles[np.arange(8_000) % 200] + rng.normal(size=(8_000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 100 = 0")
    met = []
    monkeypatch.setattr(neighbours, "MAX_LISTS", 8)
    monkeypatch.setattr(neighbours, "FIRST", 64)
    keep = neighbours.Sublists.probed

    def counted(self, probes, nearest_ones):
        out = neighbours.table(keep(self, probes, nearest_ones))
        met.append(out.join(self.postings.groupBy("list").count(), "list").agg(F.sum("count")).first()[0] or 0)
        return out

    monkeypatch.setattr(neighbours.Sublists, "probed", counted)
    by = {}
    for r in neighbours.nearest(df, asked, per_list=32).collect():
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = []
    for q in range(0, 8_000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len({i for i, _ in by[q]} & set(np.argsort(-s)[:20].tolist())) / 20)
        assert len(by[q]) == 20 and all(abs(score - s[i]) < 1e-9 for i, score in by[q])
    assert np.mean(hits) >= 0.95 and len(met) == 2
    assert sum(met) / 80 < 8_000 / 5


def test_queries_that_probe_half_of_the_lists(spark, monkeypatch):
    """Without clusters a query probes very many lists: it is not repeated for each, and a shelf that outgrew the others is cut, with the same neighbours."""
    from lectern.llm import neighbours

    x = np.random.default_rng(6).normal(size=(2_000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 4 = 0")
    write, rows = neighbours.table, []

    def counted(made):
        out = write(made)
        rows.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "table", counted)

    def found():
        by = {}
        for r in neighbours.nearest(df, asked, per_list=10).collect():
            by.setdefault(r.query_id, {})[r.vec_id] = r.score
        return by

    whole = found()
    # no table has more rows than the vectors' copies, or than the neighbours
    assert rows and max(rows) <= max(neighbours.COPIES * 2_000, 20 * 500)
    hits = []
    for q in range(0, 2_000, 4):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(whole[q]) & set(np.argsort(-s)[:20].tolist())) / 20)
        assert len(whole[q]) == 20 and all(abs(score - s[i]) < 1e-9 for i, score in whole[q].items())
    assert np.mean(hits) >= 0.9
    for bound, at in (("PART_BYTES", 0), ("BLOCK", 64), ("SHELVES", 8), ("HANDED", 500), ("LOOKED_UP", 7), ("CELLS", 2_000)):
        monkeypatch.setattr(neighbours, bound, at)
    assert found() == whole
