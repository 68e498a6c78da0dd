"""The prefix tree, periodic runs and token counts against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import periodic_runs, prefix_tree, token_counts

WORD = r"[^\x20\x09-\x0D]+"
CONVERSATION = "conv_id long, turn long, role string, text string"


def tree_brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = set()

    def below(node):
        leaves = 0 if children[node] else 1
        saved = (len(members[node]) - 1) * (len(re.findall(WORD, node[-1][1])) if node else 0)
        for child in children[node]:
            more, most = below(child)
            leaves, saved = leaves + more, saved + most
        ends = ",".join(str(c) for c in sorted(members[node]) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        below(())
    return out


def tree(df):
    turns, members = prefix_tree.with_shared_start(prefix_tree.turns_of(df))
    got = prefix_tree.prefix_tree(turns, members).collect()
    places = sorted(r.place for r in got)
    assert places == list(range(1, len(got) + 1)) and all(r.place <= r.last_place <= len(got) for r in got)
    return [tuple(r)[:-2] for r in got]


def conversations(seed, n, words=2, longest=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 200), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "a", "a b", "ä\tb c"][: words + 2])))
    return rows


@pytest.mark.parametrize("rows", [conversations(1, 60, 1, 4), conversations(2, 200), [(7, 0, "u", "x y")] * 5, [(c, t, "u", "same words here") for c in range(60) for t in range(7)], [(3, None, None, None), (4, 1, "a", None), (None, 1, "u", "nobody's")]])
def test_prefix_tree(spark, rows):
    got = tree(spark.createDataFrame(rows, CONVERSATION))
    assert len(got) == len(set(got)) and set(got) == tree_brute(rows)


def test_prefix_tree_hot_rows(spark, monkeypatch):
    """A first turn that all share, copies of one conversation, and one conversation of most rows; small chunks, other columns."""
    monkeypatch.setattr(prefix_tree, "CHUNK", 3)
    rows = [(c, t, "u", f"turn {t}" if t == 0 or c % 3 else f"own {c} {t}") for c in range(100) for t in range(5)] + [(20, 5 + i, "u", f"long {i % 7}") for i in range(700)]
    df = spark.createDataFrame(rows, CONVERSATION).withColumns({"one": F.lit("x"), "at": F.lit("y"), "n1": F.lit(None), "words": F.lit(0)})
    assert set(tree(df)) == tree_brute(rows)


def test_prefix_tree_texts_that_start_alike(spark):
    """Rows of one turn and role stand in the order of their whole texts, wherever these part."""
    rng = random.Random(4)
    starts = ["w " * n for n in (0, 40, 700)]
    rows = [(c, rng.choice([None, 1, 2]), "u", rng.choice(starts) + rng.choice("abcdef")) for c in range(40) for _ in range(6)]
    assert set(tree(spark.createDataFrame(rows, CONVERSATION))) == tree_brute(rows)


def test_prefix_tree_empty(spark):
    assert tree(spark.createDataFrame([], CONVERSATION)) == []


def test_running_spreads_a_hot_group(spark):
    """One group of nearly all rows takes several stretches, and its sums run through them."""
    from lectern.operators.scan import running

    df = spark.range(4000).select(F.when(F.col("id") % 50 == 0, F.col("id")).alias("k"), F.col("id").alias("o"), F.lit(2).cast("long").alias("v"))
    got = running(df.repartition(4), ["k"], ["o"], {"n": "v"}).collect()
    hot = sorted(r.o for r in got if r.k is None)
    assert {r.o: r.n for r in got if r.k is None} == {o: 2 * (i + 1) for i, o in enumerate(hot)}
    assert all(r.n == 2 for r in got if r.k is not None)


def runs_brute(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(w[x] == w[x + k] for x in range(i, i + n - k)) for k in range(1, q)):
                out.add((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts():
    rng = random.Random(5)
    for _ in range(3000):
        n, k = rng.randint(0, rng.choice([12, 40, 150])), rng.choice([1, 2, 3, 9])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n >= 8 else 0):
            p, a = rng.randint(1, n // 3), rng.randrange(n)
            for i in range(a + p, min(n, a + p * rng.randint(3, 7) + rng.randint(0, p))):
                w[i] = w[i - p]
        yield w


def test_runs_against_brute_force():
    found = 0
    for w in periodic_texts():
        want = runs_brute(w)
        found += len(want)
        assert periodic_runs.find_runs(np.array(w, np.int64)) == want
    assert found > 1000


def test_long_periods_and_blocks():
    """Periods over the automaton's key length, in texts that can't be had by brute force in time."""
    rng = random.Random(6)
    period = [rng.randrange(1000) for _ in range(3000)]
    head, tail = [2000] * 10, [2001]
    w = head + period * 4 + period[:17] + tail
    assert (10, 12017, 3000) in periodic_runs.find_runs(np.array(w, np.int64))
    assert periodic_runs.find_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    stairs = ([0] * 700 + [1]) * 9
    assert periodic_runs.find_runs(np.array(stairs, np.int64)) == sorted([(0, len(stairs), 701)] + [(701 * i, 700, 1) for i in range(9)], key=lambda r: (r[0], r[2]))


def op12_brute(i, text):
    words = re.findall(WORD, text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
    runs = runs_brute(words)
    kept = [w for j, w in enumerate(words) if not any(s + q <= j < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


def test_op12(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", " \t\n", "x", "ä " * 40, "a b\xa0c " * 9, "\x00 " * 7] + [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 90))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a a a a a a"), (3, "x"), (3, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("src", F.lit(1)).withColumn("crc", F.lit("c")).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((op12_brute(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 20
    assert periodic_runs.periodic_runs(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)).count() == 0
    whole = periodic_runs.periodic_runs(spark.read.parquet(f"{tmp_path}/documents.parquet"), id_col="doc_id")
    assert whole.where("src.doc_id IS NULL").first().runs[0].asDict() == {"start": 0, "length": 6, "period": 1}
    assert whole.select("src.src", "src.crc").distinct().count() == 1


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def awkward_texts():
    rng = random.Random(8)
    letters = "ab  \n\t'sdtrevml l19é漢😀.,\x00\x1c\x85\xa0​"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    points = [chr(i) for i in range(0, 0x30000, 7) if not 0xD800 <= i < 0xE000]
    out += [f"a{x}b 1{x}2 .{x}! {x}{x} {x}" for x in points]
    return out + ["x<|endoftext|>y <|endoftext|><|endoftext|>  <|endof", "", "a" * 30_000, "ab" * 9_000, " " * 5_000, "".join(rng.choice("abcdefghij") for _ in range(20_000))]


def test_token_counts_equal_the_library():
    texts = awkward_texts()
    counter = token_counts.Counter(token_counts.merges_of(token_counts.VOCABULARY))
    assert counter(texts) == library()(texts)
    rng = random.Random(9)
    for _ in range(200):
        word = "".join(rng.choice("abetion") for _ in range(rng.randint(1, 300))).encode()
        assert counter.merges.count_long(word) == int(counter.merges.counts([word])[0])


def test_op13(spark, tmp_path):
    texts = awkward_texts()[:800] + ["word " * 600]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, None), (5, None), (6, "twice"), (6, "twice")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"src": F.lit(1), "n_tokens": F.lit("c")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = token_counts.op13_token_counts(spark, str(tmp_path)).collect()
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, library()([t or "" for _, t in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and any(r.over_limit for r in got)
    whole = token_counts.token_counts(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert whole.columns == ["src", "n_bytes", "n_tokens"] and whole.select("src.n_tokens").distinct().count() == 1
    assert token_counts.token_counts(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)).count() == 0
