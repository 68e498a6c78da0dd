"""Substring deduplication by prefix-partitioned suffix trees, in array form and cut at the window length.

Suffixes that matter are those of at least ``window`` words. A window's anchor
is the least hash among the word runs in it, so equal windows have equal anchors,
and the suffixes that start in a stretch of windows with one anchor travel as one
path of words, from the first start to the end of the last window. Paths are
split into groups by anchor; equal paths are one, with the smallest and largest
document that has them, before any group is gathered.

Where an anchor has several paths, a task sorts the suffixes of its group by
their first ``window`` words, word by word; the deep internal nodes, intervals
with so long a common prefix, are the repeats, each with its smallest document.
An anchor with more than GROUP paths is a prefix too short: it is lengthened to
the whole window, and its nodes come from a grouping with partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import WordHashes, mix, powers, signed, table, with_fields

WINDOW = 50
#: Words of the runs from which anchors are taken.
RUN = 12
#: Paths of a group at most, and words of groups that a task sorts at a time.
GROUP, SORTED = 2_000, 200_000
#: Stands for a null id, below all others.
NO_ID = -(1 << 63)
BASE = 0x5851F42D4C957F2D


def span_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The hash of each h[first:end], from prefix sums of a polynomial modulo 2**64."""
    n = len(h)
    up = powers(base, n)
    down = powers(pow(base, -1, 1 << 64), n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up, out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchors(h: np.ndarray, window: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch of window starts that share an anchor: the anchor, the first and the last start.

    The anchor depends on the window's words alone, so equal windows have equal anchors.
    """
    run = min(run, window)
    n_starts = len(h) - window + 1
    at = np.arange(len(h) - run + 1)
    g = span_hashes(h, at, at + run, BASE)
    width = window - run + 1
    pick = np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1) + np.arange(n_starts)
    edge = np.flatnonzero(np.diff(pick)) + 1
    first = np.concatenate(([0], edge))
    last = np.concatenate((edge, [n_starts])) - 1
    return pick[first], first, last


def prefixes_of(window: int):
    def run(batches):
        word = WordHashes()
        for batch in batches:
            ids, marks, keys, paths, firsts, lasts = [], [], [], [], [], []
            for i, m, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                w = (value.as_py() or b"").split()
                if len(w) < window:
                    continue
                h = word(w)
                at, first, last = anchors(h, window)
                run = min(RUN, window)
                keys.append(span_hashes(h, at, at + run, BASE))
                paths.append(span_hashes(h, first, last + window, BASE + 2))
                firsts.append(first)
                lasts.append(last)
                ids.append(np.full(len(at), i, np.int64))
                marks.append(np.full(len(at), m, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids)), pa.array(np.concatenate(marks)), pa.array(signed(np.concatenate(keys))), pa.array(signed(np.concatenate(paths))), pa.array(np.concatenate(firsts).astype(np.int32)), pa.array(np.concatenate(lasts).astype(np.int32))],
                    names=["id", "mark", "anchor", "path", "first", "last"],
                )

    return run


PATH = "anchor long, path long, least long, most long, big boolean"


def stretches(batches):
    """The words of the paths that a document stands for."""
    for batch in batches:
        out: list[tuple] = []
        for value, held in zip(batch.column(0), batch.column(1).to_pylist()):
            w = (value.as_py() or b"").split()
            out += [(p["anchor"], p["path"], p["least"], p["most"], p["big"], w[p["first"] : p["end"]]) for p in held]
        columns = list(zip(*out)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.list_(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "path", "least", "most", "big", "words"])


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of ``ids`` by their first ``depth`` values, for those that have as many: equal prefixes, equal ranks."""
    rank, size = ids.astype(np.int64), 1
    while size < depth:
        step = min(size, depth - size)
        n = len(rank) - step
        if n < 1:
            return np.zeros(0, np.int64)
        _, rank = np.unique(rank[:n] * (int(rank.max()) + 1) + rank[step : step + n], return_inverse=True)
        size += step
    return rank


def node_runs(words: list[list[bytes]], group: np.ndarray, least: np.ndarray, most: np.ndarray, window: int) -> list[list[dict]]:
    """Of each path its stretches of starts ``a`` to ``b`` with the smallest document of their node, where the path has larger ones.

    ``group`` numbers the groups; suffixes of one are never equal to another's.
    """
    known: dict[tuple, int] = {}
    size = np.array([len(w) for w in words])
    ids = np.fromiter((known.setdefault((g, x), len(known)) for g, w in zip(group.tolist(), words) for x in w), np.int64, int(size.sum()))
    begin = np.cumsum(size) - size
    path = np.repeat(np.arange(len(words)), size)
    rank = suffix_order(ids, window)
    at = np.flatnonzero(path[: len(rank)] == path[window - 1 :])
    node = rank[at]
    smallest = np.full(len(rank) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, node, least[path[at]])
    low = smallest[node]
    # a run ends where its path or its smallest document changes
    edge = np.flatnonzero(np.diff(path[at], prepend=-1) | np.diff(low, prepend=low[:1] - 1 if len(low) else 0))
    out: list[list[dict]] = [[] for _ in words]
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(at)]):
        k = int(path[at[a]])
        if low[a] < most[k]:
            out[k].append({"a": int(at[a] - begin[k]), "b": int(at[b - 1] - begin[k]), "least": int(low[a])})
    return out


RUNS = "array<struct<a: int, b: int, least: bigint>>"
RUNS_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("least", pa.int64())]))


def subtrees(window: int):
    """The nodes of groups that come in the order of their anchors; whole groups are sorted together, some SORTED words at a time."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        _, group = np.unique(rows["anchor"].to_numpy(), return_inverse=True)
        runs = node_runs(rows["words"].to_pylist(), group, rows["least"].to_numpy(), rows["most"].to_numpy(), window)
        return pa.RecordBatch.from_arrays([rows["anchor"].combine_chunks(), rows["path"].combine_chunks(), pa.array(runs, RUNS_TYPE)], names=["anchor", "path", "runs"])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            for first in range(0, batch.num_rows, 2_000):
                part = pa.Table.from_batches([batch.slice(first, 2_000)])
                held = part if held is None else pa.concat_tables([held, part])
                if len(held) * window < SORTED:
                    continue
                last = int(np.searchsorted(held["anchor"].to_numpy(), held["anchor"][-1].as_py()))
                if last:
                    yield solve(held.slice(0, last))
                    held = held.slice(last)
        if held is not None and len(held):
            yield solve(held)

    return run


def lengthened(window: int):
    """The paths of too big a group as their windows: two hashes of each, and its place in the path."""

    def run(batches):
        word = WordHashes()
        for batch in batches:
            rows, n1, n2, starts = [], [], [], []
            for r, w in enumerate(batch.column("words").to_pylist()):
                h = word(w)
                at = np.arange(len(h) - window + 1)
                n1.append(span_hashes(h, at, at + window, BASE + 4))
                n2.append(span_hashes(h, at, at + window, BASE + 6))
                starts.append(at)
                rows.append(np.full(len(at), r))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(take) for c in ("anchor", "path", "least", "most")], pa.array(signed(np.concatenate(n1))), pa.array(signed(np.concatenate(n2))), pa.array(np.concatenate(starts).astype(np.int32))],
                    names=["anchor", "path", "least", "most", "n1", "n2", "at"],
                )

    return run


def cut_of(window: int, text_col: str):
    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for value, spans in zip(batch.column(0).field(text_col).cast(pa.binary()), batch.column(1).to_pylist()):
                w = (value.as_py() or b"").split()
                if spans:
                    gone = np.zeros(len(w) + 1, np.int32)
                    for s in spans:
                        gone[s["first"]] += 1
                        gone[s["last"] + window] -= 1
                    stays = np.cumsum(gone[:-1]) == 0
                    rest = [x for x, keep in zip(w, stays.tolist()) if keep]
                else:
                    rest = w
                n_words.append(len(w))
                n_removed.append(len(w) - len(rest))
                kept.append(b" ".join(rest).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["src", "n_words", "n_removed", "kept"])

    return run


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``id, mark, spans``: stretches of window starts whose windows also start in a document with a smaller id.

    ``mark`` hashes the text: rows that repeat an id with other texts stay apart.
    """
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id")
    mark = F.xxhash64(F.col(text_col)).alias("mark")
    texts = docs.where(F.col(text_col).isNotNull()).select(ident, mark, F.col(text_col).cast("binary").alias("text"))
    paths = table(texts.mapInArrow(prefixes_of(window), "id long, mark long, anchor long, path long, first int, last int"))

    # one row a path, with one of the documents that have it
    distinct = table(paths.groupBy("anchor", "path").agg(F.min(F.struct("id", "mark", "first", "last")).alias("one"), F.max("id").alias("most")))
    groups = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.min("one.id").alias("low"), F.max("most").alias("high")).where("low < high").select("anchor", "n")
    of_interest = table(distinct.join(table(groups), "anchor").select("anchor", "path", "one", "most", "n"))
    # a path without others is a leaf: all of it repeats
    alone = of_interest.where("n = 1").select("anchor", "path", F.array(F.struct(F.lit(0).alias("a"), (F.col("one.last") - F.col("one.first")).alias("b"), F.col("one.id").alias("least"))).alias("runs"))

    held = F.struct("anchor", "path", F.col("one.id").alias("least"), "most", (F.col("n") > group).alias("big"), F.col("one.first").alias("first"), (F.col("one.last") + window).alias("end"))
    opened = of_interest.where("n > 1").groupBy(F.col("one.id").alias("id"), F.col("one.mark").alias("mark")).agg(F.collect_list(held).alias("held"))
    # a row that repeats id and text gives its paths again: one is enough
    words = texts.join(opened, ["id", "mark"]).select("text", "held").mapInArrow(stretches, f"{PATH}, words array<binary>").dropDuplicates(["anchor", "path"])
    words = table(words)
    trees = words.where("NOT big").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(subtrees(window), f"anchor long, path long, runs {RUNS}")
    windows = table(words.where("big").mapInArrow(lengthened(window), "anchor long, path long, least long, most long, n1 long, n2 long, at int"))
    deep = windows.groupBy("n1", "n2").agg(F.min("least").alias("low"), F.max("most").alias("high")).where("low < high").select("n1", "n2", "low")
    run = F.struct(F.col("at").alias("a"), F.col("at").alias("b"), F.col("low").alias("least"))
    # a path has no more windows than an anchor has places in one
    long_ones = windows.join(table(deep), ["n1", "n2"]).where("most > low").groupBy("anchor", "path").agg(F.collect_list(run).alias("runs"))
    nodes = table(alone.unionByName(trees.where(F.size("runs") > 0)).unionByName(long_ones))

    seen = paths.join(nodes, ["anchor", "path"]).select("id", "mark", F.transform(F.filter("runs", lambda r: r["least"] < F.col("id")), lambda r: F.struct((F.col("first") + r["a"]).alias("first"), (F.col("first") + r["b"]).alias("last"))).alias("spans"))
    return seen.where(F.size("spans") > 0).groupBy("id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def drop_repeated_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``src, n_words, n_removed, kept`` per row of ``docs``; ``src`` holds its columns.

    Words are ``[^\\x20\\x09-\\x0D]+``; every word in a window of ``window`` words
    whose sequence also starts in a document with a smaller id goes, judged on
    the input. Kept words are joined by one space. Null and empty texts have no
    words; null ids are one id below all others; rows that repeat an id do not
    remove from each other. An empty table gives an empty one.
    """
    spans = repeats(docs, window, id_col, text_col).select(F.col("id").alias("span_id"), F.col("mark").alias("span_mark"), "spans")
    rows = docs.select(F.struct("*").alias("src"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"))
    rows = rows.join(spans, (F.col("id") == F.col("span_id")) & (F.col("mark") == F.col("span_mark")), "left").select("src", "spans")
    return rows.mapInArrow(cut_of(window, text_col), with_fields(rows, "src", "n_words long, n_removed long, kept string"))


def op5_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_substrings(docs)
    return out.select(F.col("src.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS k FROM doc, unnest(range(1, length(w) - 48)) AS u(i)
), least AS (
  SELECT k, min(doc_id) AS first_id FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, j FROM win JOIN least USING (k), unnest(range(i, i + 50)) AS u(j) WHERE doc_id > first_id
), word AS (
  SELECT doc_id, j, w[j] AS x FROM doc, unnest(range(1, length(w) + 1)) AS u(j)
), cut AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.j) FILTER (gone.j IS NULL) AS kept, count(gone.j) AS n_removed
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.j = gone.j GROUP BY word.doc_id
)
SELECT doc_id, length(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id)
"""
