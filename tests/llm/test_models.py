"""The trained scorers, the search and page extraction."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import html_text, neighbours, quality, toxicity

SCHEMA = "doc_id long, text string, src string, id int, label int, score int, found int, q_chars int"


def corpus(rng, n=400):
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna", "aliqua", "erat", "sed"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        bad, poor = i % 4 == 0, i % 5 == 0
        if bad:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), "vex" + rng.choice(["al", "or", "um", "ix"]))
        if poor:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), "clash", 1, 2, 3, 4, 5))
        labels.append((i, int(not poor), int(bad)))
    return docs, labels


@pytest.mark.parametrize("score, label, good", [(toxicity.score_toxicity, 2, 0.9), (quality.score_quality, 1, 0.95)])
def test_scores(spark, score, label, good):
    docs, labels = corpus(random.Random(1))
    odd = [(900, None), (901, ""), (902, "a" * 300_000), (None, "lorem ipsum"), (903, "\U0001f600 é")]
    df = spark.createDataFrame(docs + [(i, t, "c", 1, 2, 3, 4, 5) for i, t in odd], SCHEMA)
    lab = spark.createDataFrame(labels + [(5000, 1, 1), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = score(df, lab).select("src.doc_id", "held_out", "score").collect()
    assert len(out) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in out)
    held = [(r.score >= 0.5, bool(labels[r.doc_id][label])) for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(a == b for a, b in held) / len(held) >= good
    twice = score(df.unionByName(df), lab).select("src.doc_id", "score").collect()
    assert len(twice) == 2 * len(out)
    assert score(df.limit(0), lab).count() == 0
    assert score(df, lab.limit(0)).where("score IS NULL OR score NOT BETWEEN 0 AND 1").count() == 0


def statistics_brute(text):
    text = text or ""
    n, w = max(1, len(text)), " ".join(text.replace("\t", " ").replace("\n", " ").split(" ")).split()
    w = w or [""]
    share = lambda chars: sum(c in chars for c in text) / n
    shares = [share(quality.UPPER), share(quality.LOWER), share("%&*$#@=<>{}[]~^_\\"), share("|"), share("!?"), share("."), share(",;:"), share("0123456789"), share("\n")]
    return [len(text), *shares, len(w), len(text) / len(w), len(set(w)) / len(w), sum(a == b for a, b in zip(w, w[1:])) / len(w)]


def test_quality_rules(spark):
    """Statistics, rules and scores against plain Python on the same texts."""
    docs, labels = corpus(random.Random(5), 200)
    texts = [d[1] for d in docs] + [None, "", "a a a\tb\nB! 12; |x| é😀 {}", "Z" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, names = quality.measured(df, F.col("text"))
    got = {r.doc_id: [r[c] for c in names] for r in rows.collect()}
    for i, text in enumerate(texts):
        assert np.allclose(got[i], statistics_brute(text)), (text, got[i])
    x, y = np.array([got[i] for i in range(200)]), np.array([q for _, q, _ in labels], float)
    model = quality.fit(x, y, names)
    assert 0 < len(model.rules) < 120 and all(1 <= len(r.tests) <= quality.DEPTH for r in model.rules)
    scored = {r.doc_id: r.score for r in rows.select("doc_id", model.column().alias("score")).collect()}
    for i in range(len(texts)):
        z = model.intercept
        for rule in model.rules:
            if all((got[i][k] > t) if above else (got[i][k] <= t) for k, above, t in rule.tests):
                z += rule.weight
        assert abs(scored[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def kneser_ney(texts, every, d=0.75):
    """P(c | context) by class in plain recursion: own counts of six, own continuation counts of five and four, shared ones of three."""
    spaced = lambda t: f"  {'  '.join(t.lower().split())}  "
    grams = lambda ts, n: [s[i : i + n] for s in map(spaced, ts) for i in range(len(s) - n + 1)]
    shared = Counter(g[1:] for g in set(grams(every, 4)))
    chars = len({g[-1] for g in shared})
    own = {6: Counter(grams(texts, 6))}
    own[5] = Counter(g[1:] for g in own[6])
    own[4] = Counter(g[1:] for g in own[5])

    def p(g):
        counts, low = (shared, 1 / chars) if len(g) == 3 else (own[len(g)], p(g[1:]))
        below = [n for h, n in counts.items() if h[:-1] == g[:-1]]
        if not below:
            return low
        return max(counts[g] - d, 0) / sum(below) + d * len(below) / sum(below) * low

    return p


def test_toxicity_counts(spark):
    """The log-ratio of every character, seen and unseen, is that of a plain Kneser-Ney recursion."""
    rng = random.Random(3)
    docs = ["".join(rng.choice("ab c\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", "x"]
    toxic = [int(i % 3 == 0) for i in range(40)]
    frame = spark.createDataFrame([(t,) for t in docs], "text string")
    sample = spark.createDataFrame(list(zip(docs, toxic)), "text string, toxic int")
    tables = {k: toxicity.Lookup.of(d) for k, d in toxicity.differences(sample, frame).items()}
    p = [kneser_ney([t for t, y in zip(docs, toxic) if y == c], docs) for c in (0, 1)]
    unseen = 0
    for t in docs[35:] + ["abc abc", "cab zzzz bca", "qqqqqqqq"]:
        s = f"  {'  '.join(t.lower().split())}  "
        got = toxicity.log_ratios(toxicity.threes_of(toxicity.code_points(t)), tables)
        for i, g in enumerate(got):
            six = s[i : i + 6]
            if all(ch in "abc \U0001f600" for ch in six):
                assert abs(g - np.log(p[1](six) / p[0](six))) < 1e-4
            else:
                unseen += 1
    assert unseen


def brute(x, ids, q, k):
    out = {}
    for i in q:
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_neighbours(spark):
    random_ = np.random.default_rng(0)
    x = random_.normal(size=(3000, 16)).astype(np.float32)
    x[100:200] = x[7]  # a hundred equal vectors
    x[200:260] *= 3
    ids = np.arange(3000)
    rows = [(int(i), v.tolist(), "c") for i, v in zip(ids, x)]
    odd = [(5000, None, "c"), (5001, [0.0] * 16, "c"), (5002, [float("nan")] * 16, "c"), (5003, [1.0, None] + [0.0] * 14, "c"), (None, [1.0] * 16, "c"), (5004, [1.0] * 3, "c"), (5005, [float("inf")] * 16, "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    exact = brute(x.astype(np.float64), ids, [i for i in ids if i % 20 == 0], 20)
    assert set(by) == set(exact) and all(len(v) == 20 for v in by.values())
    recall = np.mean([len({r.vec_id for r in by[q]} & set(exact[q])) / 20 for q in exact])
    assert recall >= 0.95
    for v in by.values():
        assert [(r["rank"]) for r in v] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in v] == sorted((-r.score, r.vec_id) for r in v)
    equal = [r.vec_id for r in by[100] if r.vec_id == 7 or 100 <= r.vec_id < 200]
    assert equal and equal == [7, *range(101, 200)][: len(equal)]  # ties go to smaller ids
    for q, v in by.items():
        assert all(abs(r.score - float(x[q].astype(np.float64) @ x[r.vec_id].astype(np.float64))) < 1e-9 for r in v)
    few = df.where("vec_id < 5")
    assert neighbours.nearest(few, few).count() == 20
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    """Rows given many times, and ids with several vectors, take no one's place."""
    random_ = np.random.default_rng(1)
    x = random_.normal(size=(400, 8))
    x[50:90] = x[3] * 4  # equal vectors, of which one is given thirty times
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 2 + [(50, x[50].tolist())] * 30
    rows += [(60, (x[3] * (5 + j)).tolist()) for j in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 3")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    vecs, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    hits = []
    for q in range(3, 400, 20):
        best = {}
        for i, s in zip(ids, (vecs @ vecs[ids == q].T).max(1)):
            if i != q:
                best[i] = max(best.get(i, -np.inf), s)
        exact = [i for i, _ in sorted(best.items(), key=lambda e: (-round(e[1], 9), e[0]))[:20]]
        assert len(got[q]) == len(set(got[q])) == 20
        hits.append(len(set(exact) & set(got[q])) / 20)
    assert np.mean(hits) >= 0.95


def test_posting_lists(spark):
    """Candidates come from the probed lists alone: few of them in clustered data, found by the graph."""
    random_ = np.random.default_rng(2)
    middles = random_.normal(size=(60, 12)) * 4
    x = middles[np.arange(12_000) % 60] + random_.normal(size=(12_000, 12))
    model = neighbours.fit(x, float(np.linalg.norm(x, axis=1).max()), 100, 20)
    rows, lists = model.assign(x)
    assert len(model.centroids) > 60 and 12_000 < len(rows) <= 12_000 * neighbours.COPIES
    model.sizes = np.bincount(lists, minlength=len(model.centroids))
    assert model.sizes.max() < 12_000 / 10
    hits, probed = [], []
    for q in range(0, 12_000, 100):
        near = set(model.probe(x[q], 40))
        probed.append(len(near))
        s = x @ x[q]
        s[q] = -np.inf
        found = set(rows[np.isin(lists, list(near))])
        hits.append(np.mean([j in found for j in np.argsort(-s)[:20]]))
    assert np.mean(hits) >= 0.9 and np.mean(probed) < len(model.centroids) / 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:4000])], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 100 = 0")
    got = neighbours.nearest(df, asked, per_list=64).collect()
    exact = brute(x[:4000], np.arange(4000), range(0, 4000, 100), 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert 0.9 <= np.mean([len(by[q] & set(e)) / 20 for q, e in exact.items()])


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_blocks():
    kinds = dict(article=html_text.ARTICLE, out=html_text.OUT, open=html_text.OPEN)
    got = html_text.blocks(page("<nav><ul><li>Home</ul></nav><div class='ad'>Buy</div><!-- x --><article><header><h1>A &amp; B</h1></header><p>one <b>two</b>\n three<br><p>x&nbsp;y<aside>note</aside></article><footer>&copy;</footer>"))
    assert [t for k, t in got if k == kinds["article"]] == ["A & B", "one two three", "x y"]
    assert [t for k, t in got if k == kinds["out"]] == ["Home", "Buy", "note", "©"]
    assert html_text.blocks(None) == [] and html_text.blocks("") == []
    assert html_text.blocks("a < b <") == [(kinds["open"], "a < b <")]
    assert html_text.blocks("<p>x<!-- never closed") == [(kinds["open"], "x")]
    assert html_text.blocks("<div id=comments><article>c</article></div>")[0][0] == kinds["out"]
    assert html_text.blocks("<aside><article>teaser</article></aside><div><p>text</div>") == [(kinds["out"], "teaser"), (kinds["open"], "text")]
    assert html_text.blocks("<article><div class='related-work'>w</div><div class=ad>x</div></article>") == [(html_text.DOUBT, "w"), (kinds["out"], "x")]
    assert html_text.blocks("<body class='no-sidebar'><div class='has-sidebar'>t</div>")[0][0] == html_text.HINTED
    assert html_text.blocks("<body><form><div><article>a</article></div></form>") == [(kinds["article"], "a")]
    began = time.time()
    hostile = "<span><table>" + "<div>" * 40_000 + "</span>" * 40_000 + "x" + "<b><" * 100_000
    assert len(hostile) > 800_000 and any(t.startswith("x") for _, t in html_text.blocks(hostile))
    assert time.time() - began < 10


def repeats_brute(pages, depth=8, least=3):
    """Starts of each page's runs of ``depth`` tokens that ``least`` distinct pages have."""
    having = {}
    for p in pages:
        for i in range(len(p) - depth + 1):
            having.setdefault(tuple(p[i : i + depth]), set()).add(tuple(p))
    return [[i for i in range(len(p) - depth + 1) if len(having[tuple(p[i : i + depth])]) >= least] for p in pages]


def test_suffix_array():
    rng = random.Random(7)
    pages = [[rng.choice("ab") for _ in range(rng.randint(0, 60))] for _ in range(12)]
    pages += [list(pages[3]), list("abababababab"), []]
    same = {tuple(p): k for k, p in reversed(list(enumerate(pages)))}
    ids = np.array([ord(c) - 97 for p in pages for c in p])
    of = np.array([same[tuple(p)] for p in pages for _ in p])
    got = set(html_text.repeated_starts(ids, of).tolist())
    want, at = set(), 0
    for p, starts in zip(pages, repeats_brute(pages)):
        want |= {at + i for i in starts}
        at += len(p)
    assert got == want and want
    order, begin = html_text.suffix_intervals(ids)
    heads = [tuple(ids[o : o + 8]) for o in order]
    assert heads == sorted(heads) and len(begin) == len(set(heads))


def test_main_text(spark):
    endings = ["rain falls", "ships sail far", "bread rises slowly", "old men sing", "no bell rang", "it ended"]
    articles = [f"Only page {i} says this about subject number {i}: {e}." for i, e in enumerate(endings)]
    menu = "<p>Home</p><p>World news of today</p><p>Sport</p><p>Weather</p><p>All rights reserved by the publisher of this site</p>"
    rows = [(i, f"http://h.example/{i}", page(f"{menu}<div>{a}</div><p>Tail {i}</p>"), "c") for i, a in enumerate(articles)]
    rows += [(10, "http://other.example/", page(f"{menu}<div>Single page</div>"), "c"), (11, None, None, "c"), (12, "bad url", "", "c"), (13, "http://h.example/13", page("<article><p>Marked</p></article>" + menu), "c"), (14, "http://h.example/0", rows[0][2], "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.main_text(df).select("src.page_id", html_text.F.col("text")).collect()}
    assert len(got) == 11
    for i, a in enumerate(articles):
        assert got[i] == f"{a}\nTail {i}"
    assert got[10].endswith("Single page") and got[10].startswith("Home")  # nothing repeats on that host
    assert got[11] == got[12] == "" and got[13] == "Marked" and got[14] == got[0]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_marked_pages_are_evidence(spark):
    """Two unmarked pages can't tell what repeats, with marked pages of their host they can."""
    menu = "<p>Home</p><p>World news of today</p><p>Sport</p><p>Weather</p><p>All rights reserved by the publisher of this site</p>"
    rows = [(i, "http://h.example/", page(f"{menu}<div>Unmarked text {i}</div>")) for i in (0, 1)]
    rows += [(i, "http://h.example/", page(f"<article><p>Marked {i}</p>{menu}</article>")) for i in (2, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).select("src.page_id", "text").collect()}
    assert got[0] == "Unmarked text 0" and got[1] == "Unmarked text 1"
    assert got[2].startswith("Marked 2\nHome") and got[2].endswith("of this site")
    # the same in shards of single pages, where only the count over all of them finds repeats
    assert {r.page_id: r.text for r in html_text.main_text(df, shard=1).select("src.page_id", "text").collect()} == got
    # a block whose name hints at furniture stays in an article unless it repeats
    hinted = [(i, "http://d.example/", page(f"<article><p>Story {i}</p><div class='search-tips'><p>Own tip number {i}</p></div><div class='box-promo'><p>Become a member today and read all that we write</p></div></article>")) for i in range(4)]
    hinted += [(9, "http://d.example/9", page("<aside><article><p>Teaser</p></article></aside><article><p>Short card</p></article><div><p>The page's text is much longer than the card</p></div>"))]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(hinted, "page_id long, url string, html string")).select("src.page_id", "text").collect()}
    assert got[2] == "Story 2\nOwn tip number 2" and got[9] == "Short card\nThe page's text is much longer than the card"
    # seventy pages meet in 64 bits, and copies of one page still are one page
    copies = [(i, "http://c.example/", page(menu)) for i in range(70)] + [(100, "http://c.example/", page(f"{menu}<p>x</p>"))]
    got = html_text.main_text(spark.createDataFrame(copies, "page_id long, url string, html string")).select("text").collect()
    assert len(got) == 71 and all(r.text.startswith("Home") for r in got)
