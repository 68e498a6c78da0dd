"""The document operators on awkward rows, and against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontamination, line_dedup, mixing, near_dedup, personal_data, substring_dedup

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, source string, id int, src string, kept string, n_words string, spans int, mark int"


def rows_of(*texts):
    return [(i if i is None or i >= 0 else None, t, s, 1, "clash", "k", "w", 2, 3) for i, t, s in texts]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    data = rows_of((1, None, "b"), (2, "", "a"), (3, long, "a"), (3, long, "a"), (4, long + " more", None), (-1, "x y z", "b"), (5, "ä\n\n\n", None), (6, " \t ", "a"), (7, "x y z", "b"))
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lines_brute(docs):
    keyed = [(i, [(line, line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for line in (t or "").split("\n")]) for i, t in docs]
    found = {}
    for i, ls in keyed:
        for _, k in ls:
            if len(k) >= 40:
                found.setdefault(k, set()).add(i)
    gone = {k: max(v) for k, v in found.items() if len(v) >= 5}
    return {i: "\n".join(line for line, k in ls if k not in gone or gone[k] == i) for i, ls in keyed}


def test_line_dedup(spark, odd, empty):
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    out = line_dedup.drop_repeated_lines(odd).select("src.doc_id", "src.text", "n_lines", "n_dropped", "kept").collect()
    assert len(out) == 9 and all(r.kept == (r.text or "") and r.n_dropped == 0 for r in out)
    assert {r.n_lines for r in out if r.text == "ä\n\n\n"} == {4}
    line = "This very common line is long enough to be a key"
    docs = [(i, f"own {i}\n  {line.upper() if i % 2 else line}\t\nend {i}\n{line}") for i in range(6)] + [(9, "short\nshort"), (10, f"a\r\n{line[:-1]}")]
    got = {r.doc_id: r.kept for r in line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("src.doc_id", "kept").collect()}
    assert got == lines_brute(docs)
    assert line in got[5] and line not in got[0]


def test_mixing(spark, odd, empty):
    assert mixing.mix(empty).count() == 0
    out = mixing.mix(odd).collect()
    assert len(out) == 9 and sum(r.size for r in out) == 5000 * 3 + 1 + 6 + 1
    assert {r.size for r in out if r.doc_id in (1, 2, 6)} == {0}
    rng = random.Random(4)
    docs = [(i, " ".join("w" for _ in range(rng.randint(1, 30))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    for rows in by.values():
        assert rows[0].source_size == sum(r.size for r in rows) and rows[0].target <= 3 * rows[0].source_size + 1e-6
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 30 and all(r.taken <= 3 * r.size for r in rows)
    assert abs(sum(rows[0].target for rows in by.values()) - total) < 1e-6
    again = mixing.mix(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    kept = mixing.mixed(odd)
    assert kept.where("repeats < 1").count() == 0 and set(kept.select("src.*").columns) == set(odd.columns)


def substrings_brute(docs, n=50):
    texts = {i: re.findall(WORD, t or "") for i, t in docs}
    first = {}
    for i in sorted(texts):
        w = texts[i]
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), i)
    out = {}
    for i, w in texts.items():
        gone = {j for s in range(len(w) - n + 1) if first[tuple(w[s : s + n])] < i for j in range(s, s + n)}
        out[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    return out


def test_substring_dedup(spark, odd, empty):
    assert substring_dedup.drop_repeated_substrings(empty).count() == 0
    out = substring_dedup.drop_repeated_substrings(odd).select("src.doc_id", "n_words", "n_removed", "src.kept").collect()
    assert len(out) == 9
    assert {(r.n_words, r.n_removed) for r in out if r.doc_id == 3} == {(5000, 0)}
    assert [(r.n_words, r.n_removed) for r in out if r.doc_id == 4] == [(5001, 5000)]
    rng = random.Random(1)
    shared = [[rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(45, 130))] for _ in range(6)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(shared)
            a = rng.randint(0, 20)
            w += [rng.choice("xyz") + str(rng.randint(0, 5)) for _ in range(rng.randint(0, 9))] + p[a : a + rng.randint(40, 120)]
        docs.append((i, " ".join(w)))
    docs += [(70, " ".join(["la"] * 120)), (71, " ".join(["la"] * 49)), (72, " ".join(["la"] * 50) + "  end"), (73, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.kept for r in substring_dedup.drop_repeated_substrings(df).select("src.doc_id", "kept").collect()}
    assert got == substrings_brute(docs)
    # the same where groups are too big to be sorted by a task
    spans = {}
    for group in (substring_dedup.GROUP, 1):
        spans[group] = {r.id: {i for s in r.spans for i in range(s["first"], s["last"] + 1)} for r in substring_dedup.repeats(df, group=group).collect()}
    assert spans[1] == spans[substring_dedup.GROUP] and spans[1]


def test_suffix_groups():
    """Nodes of several groups sorted together, against all pairs of windows."""
    rng = random.Random(11)
    words = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(5, 12))] for _ in range(40)]
    group = np.array(sorted(rng.randint(0, 3) for _ in words))
    least = np.array([rng.randint(0, 50) for _ in words])
    most = least + np.array([rng.randint(0, 9) for _ in words])
    got = substring_dedup.node_runs(words, group, least, most, 5)
    for k, w in enumerate(words):
        want = {}
        for a in range(len(w) - 4):
            low = min(least[j] for j, v in enumerate(words) if group[j] == group[k] and any(v[b : b + 5] == w[a : a + 5] for b in range(len(v) - 4)))
            if low < most[k]:
                want[a] = low
        assert {a: r["least"] for r in got[k] for a in range(r["a"], r["b"] + 1)} == want


def near_brute(docs, n=4):
    sets = {}
    for i, t in docs:
        w = re.findall(WORD, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        k = min(n, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    comp = {i: i for i in sets}
    changed = True
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_near_dedup(spark, odd, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == 9
    by = {r.id: r for r in out}
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[6].kept
    assert by[4].component_id == 3 and by[7].component_id is None and not by[7].kept  # the null id is the smallest
    rng = random.Random(2)
    base = [[f"t{rng.randint(0, 500)}" for _ in range(rng.randint(5, 120))] for _ in range(8)]
    docs = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"e{i}-{rng.randint(0, 9)}"
        docs.append((i, " ".join(w).upper() if i % 3 == 0 else "  ".join(w)))
    docs += [(200, "one"), (201, "ONE"), (202, "one two"), (203, None)]
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == near_brute(docs)
    kept = near_dedup.keep_one_of_each(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in near_brute(docs).items() if i == c}


def test_near_dedup_ids(spark):
    """Null ids and ids repeated with other texts: a row out for a row in, and one row of each component stays."""
    rng = random.Random(6)
    base = [[f"n{k}x{j}" for j in range(60)] for k in range(6)]
    docs = [(None, " ".join(w)) for w in base] + [(5, " ".join([*w[:-1], "end"])) for w in base[:3]] + [(9, " ".join(base[3])), (None, " ".join(base[4])), (5, " ".join(base[0])), (None, None), (None, " "), (None, " ")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = near_dedup.near_duplicates(df).collect()
    assert len(out) == len(docs)
    assert all(r.component_id is None for r in out) and sum(r.kept for r in out) == 10
    of = {}
    for r in out:
        if r.n_shingles:
            of.setdefault(r.component, []).append(r.id)
    assert sorted(map(len, of.values())) == [1, 2, 2, 2, 2, 3]
    kept = [r.text for r in near_dedup.keep_one_of_each(df).collect()]
    assert sorted(t for t in kept if t and t.strip()) == sorted(" ".join(w) for w in base) and len(kept) == 9


def bench_brute(docs, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for j, u in items:
            p = words(u)
            m = min(n, len(p))
            wins = {tuple(p[k : k + m]) for k in range(len(p) - m + 1)} if p else set()
            for s in range(len(w) - m + 1) if m else ():
                if tuple(w[s : s + m]) in wins:
                    hit |= set(range(s, s + m))
                    found.add(str(j))
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("pass_bytes", [1 << 20, 150])
def test_decontamination(spark, odd, empty, pass_bytes):
    bench = spark.createDataFrame([(1, "x y z"), (2, None), (3, "")], "item_id long, text string")
    assert decontamination.find_benchmark(empty, bench).count() == 0
    assert decontamination.find_benchmark(odd, bench.limit(0)).where("size(items) > 0").count() == 0
    out = decontamination.judged(decontamination.find_benchmark(odd, bench)).select("src.doc_id", "items", "contaminated").collect()
    assert len(out) == 9 and sorted((r.doc_id is None, r.doc_id) for r in out if r.contaminated) == [(False, 7), (True, None)]
    rng = random.Random(3)
    pool = [[f"q{rng.randint(0, 60)}" for _ in range(k)] for k in (1, 2, 5, 12, 13, 14, 30, 30)]
    items = [(i, " ".join(p).title()) for i, p in enumerate(pool)] + [(10, " ".join(pool[6])), (11, "A-b"), (2, "zz")]
    docs = []
    for i in range(80):
        w = [f"q{rng.randint(0, 60)}" for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(pool)
            a = rng.randint(0, max(0, len(p) - 13))
            w += p[a : a + rng.randint(10, 20)] + ["!"]
        docs.append((i, ", ".join(w)))
    found = decontamination.judged(decontamination.find_benchmark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), pass_bytes=pass_bytes))
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found.select("src.doc_id", "n_words", "n_hit", "items").collect()}
    assert got == bench_brute(docs, items)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_brute(t):
    return [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], t or "") if good(k, m.group())]


def test_personal_data(spark, odd, empty):
    assert personal_data.find_personal_data(empty).count() == 0
    assert personal_data.find_personal_data(odd).where("size(spans) > 0").count() == 0
    rng = random.Random(5)
    parts = ["a.b@c.de", "x@y", "@", "a@b.com_c@d.org", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "12 34", "5 -7", "+1 (212) 555-0100", "+49 30 1234", "+", "é😀", "\n", " ", "  ", "-", ".", "79927398713", "0004111111111111111", "a" * 30, "9" * 40]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(150)] + ["".join(rng.choice(parts) for _ in range(8)) for _ in range(150)]
    texts += [" ".join("7" * 9000), "1." * 9000, "a@b" + ".c" * 9000, "%" * 20000]
    out = personal_data.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("src.doc_id", "spans").collect()
    for r in out:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base] == base_brute(texts[r.doc_id])
        assert [(personal_data.KINDS.index(s.kind), s.start) for s in r.spans] == sorted((personal_data.KINDS.index(s.kind), s.start) for s in r.spans)


def test_added_spans(spark):
    plain = ["call me at +1 (212) 555-0100 now", "card 4111 1111 1111 1111 ok", "mail a@b.org now"] * 20
    near = ["phone +1 (826) 555-4081 190.137.2.33 end", "see 123 4567 there"]
    out = personal_data.find_personal_data(spark.createDataFrame(list(enumerate(plain + near)), "doc_id long, text string")).select("src.doc_id", "spans").collect()
    by = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in out}
    assert ("phone", 6, 23) in by[60] and ("ip", 24, 36) in by[60]
    assert by[61] == []


def test_span_classifier(spark):
    """It learns from spans with words around them, and says of spans without any what their shape says; spans never meet."""
    rng = random.Random(9)
    number = lambda sep: sep.join("".join(rng.choice("23456789") for _ in range(k)) for k in (3, 3, 4))
    learned = [f"please call {number('-')} today" for _ in range(150)] + [f"see version {number('.')}/x of it" for _ in range(150)]
    held_out = [f"blue {number('-')} sky" for _ in range(20)] + [f"blue {number('.')}/ sky" for _ in range(20)]
    texts = learned + held_out + ["mail 555-123-4567 [at] host.com", "+1 (826) 555-4081 a@b.org 190.137.2.33 4111 1111 1111 1111", None]
    out = personal_data.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("src.doc_id", "spans").collect()
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in out}
    assert [len(got[300 + i]) for i in range(40)] == [1] * 20 + [0] * 20
    assert [k for k, _, _ in got[341]] == ["email", "ip", "card", "phone"]
    for spans in got.values():
        assert all(a[2] <= b[1] or b[2] <= a[1] for a in spans for b in spans if a != b)


def em_brute(rows, labelers, steps=100):
    """Posteriors of a two-class model by one pass over all rows a step."""
    start = [[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]]
    p = [[list(start[c]) for _ in range(labelers)] for c in (0, 1)]
    share, post = 0.5, []
    for _ in range(steps):
        post = []
        for r in rows:
            like = [1 - share, share]
            for c in (0, 1):
                for k, v in enumerate(r):
                    like[c] *= p[c][k][v]
            post.append(like[1] / (like[0] + like[1]))
        share = (sum(post) + 2) / (len(rows) + 4)
        for c in (0, 1):
            for k in range(labelers):
                w = [10 * start[c][v] + sum(q if c else 1 - q for r, q in zip(rows, post) if r[k] == v) for v in range(3)]
                p[c][k] = [x / sum(w) for x in w]
    return post


def test_estimate():
    rng = random.Random(12)
    n = personal_data.LABELERS
    rows = []
    for _ in range(300):
        real = rng.random() < 0.4
        rows.append(tuple(rng.choices([0, 1, 2], [1, 2, 6] if real else [5, 3, 1])[0] for _ in range(n)))
    counts = {}
    for r in rows:
        key = sum(v * 3**k for k, v in enumerate(r))
        counts[key] = counts.get(key, 0) + 1
    patterns, post = personal_data.estimate(counts)
    got = dict(zip(patterns.tolist(), post))
    for r, q in zip(rows, em_brute(rows, n)):
        assert abs(got[sum(v * 3**k for k, v in enumerate(r))] - q) < 1e-5


def test_digests(spark, tmp_path):
    """The registered queries derive their digests from the operators' outputs."""
    docs = [(1, "a b c\nmail x@y.org"), (2, None), (3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.doc_id: r for r in personal_data.op8_personal_data(spark, str(tmp_path)).collect()}
    assert got[2].base_sha256 == empty and got[2].spans == "" and got[1].n_email == 1 and got[1].spans == "email:11:18"
    assert {r.doc_id: r.kept_sha256 for r in line_dedup.op10_line_dedup(spark, str(tmp_path)).collect()}[2] == empty
