"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of the benchmark items (shorter items are one
pattern). A table of word pairs says how far a scan may skip; at a pair that
ends some pattern, the bucket of that suffix selects the candidates, and direct
comparison decides.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.shared import table, with_fields

WINDOW = 13
#: Benchmark text that one pass over the documents takes to every executor; more goes in further passes. A process needs some 30 bytes for each of them.
PASS_BYTES = 8 << 20
#: Windows of a piece of an item.
PIECE = 100_000
FOUND = "n_words bigint, spans array<struct<first: int, end: int>>, items array<string>"
#: Bytes outside words become spaces; A-Z become a-z; bytes of other scripts stay.
FOLD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def fold_words(text: bytes | None) -> list[bytes]:
    """The lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return text.translate(FOLD).split() if text else []


class WuManber:
    """All patterns of one length ``m``, in words.

    Patterns are places in one list of words, not texts of their own. Equal patterns are one, with the items of all.
    """

    def __init__(self, words: list[bytes], starts: np.ndarray, items: np.ndarray, m: int):
        self.m, self.block, self.words = m, min(2, m), words
        self.skip = m - self.block + 1
        self.mask = (1 << max(10, (8 * len(starts)).bit_length())) - 1
        key = np.fromiter((hash(tuple(words[s : s + m])) for s in starts.tolist()), np.int64, len(starts))
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        first_of = starts[first][inverse]
        for k in np.flatnonzero(first_of != starts).tolist():
            # equal hashes of other words: a pattern of its own
            if words[first_of[k] : first_of[k] + m] != words[starts[k] : starts[k] + m]:
                first_of[k] = starts[k]
        order = np.lexsort((items, first_of))
        self.items = items[order]
        self.at, self.begin = np.unique(first_of[order], return_index=True)
        self.begin = np.append(self.begin, len(order))
        # the least distance from a block's slot to a pattern's end, and the patterns that end with it
        shift = np.full(self.mask + 1, min(self.skip, 255), np.uint8)
        for end in range(self.block, m + 1):
            slots = self._slots(self.at + end - self.block)
            np.minimum.at(shift, slots, np.uint8(min(m - end, 255)))
        self.shift = shift.tobytes()
        ends = self._slots(self.at + m - self.block)
        self.ending = np.argsort(ends, kind="stable")
        self.ends = ends[self.ending]

    def _slots(self, at: np.ndarray) -> np.ndarray:
        w, mask = self.words, self.mask
        if self.block == 2:
            return np.fromiter((hash((w[k], w[k + 1])) & mask for k in at.tolist()), np.int64, len(at))
        return np.fromiter((hash((w[k],)) & mask for k in at.tolist()), np.int64, len(at))

    def find(self, w: list[bytes]):
        """(first word, numbers of the items) of each occurrence in ``w``."""
        m, n, shift, mask, two = self.m, len(w), self.shift, self.mask, self.block == 2
        at = m - 1
        while at < n:
            slot = (hash((w[at - 1], w[at])) if two else hash((w[at],))) & mask
            step = shift[slot]
            if step:
                at += step
                continue
            first = at - m + 1
            mine = w[first : at + 1]
            for k in self.ending[np.searchsorted(self.ends, slot) : np.searchsorted(self.ends, slot, "right")].tolist():
                p = int(self.at[k])
                # the first word sorts out most; then all are compared
                if self.words[p] == mine[0] and self.words[p : p + m] == mine:
                    yield first, self.items[self.begin[k] : self.begin[k + 1]]
            at += 1


class Patterns:
    """The windows of benchmark items; the search tables are made once in each process."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.items, self.window, self.made = items, window, None

    def searchers(self) -> list[WuManber]:
        if self.made is None:
            known: dict[bytes, bytes] = {}
            words: list[bytes] = []
            starts: dict[int, list[np.ndarray]] = defaultdict(list)
            owners: dict[int, list[np.ndarray]] = defaultdict(list)
            for i, (_, text) in enumerate(self.items):
                w = [known.setdefault(x, x) for x in fold_words(text)]
                m = min(self.window, len(w))
                if m:
                    starts[m].append(np.arange(len(words), len(words) + len(w) - m + 1))
                    owners[m].append(np.full(len(w) - m + 1, i, np.int32))
                    words += w
            self.made = [WuManber(words, np.concatenate(starts[m]), np.concatenate(owners[m]), m) for m in sorted(starts)]
        return self.made


def pieces(window: int):
    """Items as pieces of at most about PIECE words, each window whole in one of them."""

    def run(batches):
        for batch in batches:
            names, texts = [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = fold_words(value.as_py())
                for first in range(0, max(1, len(w) - window + 1), PIECE) if w else ():
                    names.append(name)
                    texts.append(b" ".join(w[first : first + PIECE + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["item", "text"])

    return run


def scan_with(shared, text_col: str):
    def scan(batches):
        tables, names = shared.value.searchers(), [name for name, _ in shared.value.items]
        for batch in batches:
            texts = batch.column(0).field(text_col).cast(pa.binary())
            sizes, spans, found = [], [], []
            for value in texts:
                w = fold_words(value.as_py())
                hits, items = [], set()
                for t in tables:
                    for first, numbers in t.find(w):
                        hits.append((first, first + t.m))
                        items.update(numbers.tolist())
                merged: list[list[int]] = []
                for a, b in sorted(hits):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                sizes.append(len(w))
                spans.append([{"first": a, "end": b} for a, b in merged])
                found.append(sorted({names[k] for k in items}))
            span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))],
                names=["src", "n_words", "spans", "items"],
            )

    return scan


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``src, n_words, spans, items`` per row of ``docs``: word spans inside benchmark windows, and the items they are of.

    Spans are disjoint, in order, and count words; items are sorted as strings,
    a null item id being the empty string. Null and empty texts have no words,
    on either side. ``src`` holds the columns of ``docs``; repeated rows are
    judged each, repeated items are one. Texts and items of any length are
    searched whole. A benchmark of more than ``pass_bytes`` is searched in parts
    of about that size, one pass each. Empty tables give empty ones, or no hits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("src"))
    schema = with_fields(rows, "src", FOUND)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("binary").alias("text")).where("text IS NOT NULL")
    items = table(items.mapInArrow(pieces(WINDOW), "item string, text binary"))
    total = items.agg(F.sum(F.length("text") + F.length("item"))).first()[0] or 0
    parts = max(1, math.ceil(total / pass_bytes))

    def part(k: int):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        return spark.sparkContext.broadcast(Patterns([(r.item, bytes(r.text)) for r in mine.toLocalIterator()]))

    if parts == 1:
        return rows.mapInArrow(scan_with(part(0), text_col), schema)
    numbered = table(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("nr")))
    asked = numbered.select(F.struct("nr", F.col("row").getField(text_col).alias("text")).alias("src"))
    found = []
    for k in range(parts):  # one after the other: a pass's patterns are gone before the next one's are made
        patterns = part(k)
        hits = asked.mapInArrow(scan_with(patterns, "text"), T.StructType.fromDDL(f"src struct<nr: bigint, text: string>, {FOUND}"))
        found.append(table(hits.select("src.nr", "n_words", "spans", "items")))
        patterns.destroy()
    # one row for each row and pass: a group holds as many rows as there are passes
    merged = reduce(DataFrame.unionByName, found).groupBy("nr").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.mapInArrow(joined, merged.schema)
    return numbered.join(merged, "nr").select(F.col("row").alias("src"), "n_words", "spans", "items")


def joined(batches):
    """Sorted spans with those that meet made one."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            one: list[dict] = []
            for s in spans:
                if one and one[-1]["end"] >= s["first"]:
                    one[-1]["end"] = max(one[-1]["end"], s["end"])
                else:
                    one.append(s)
            out.append(one)
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def judged(found: DataFrame) -> DataFrame:
    """``found`` with n_hit and contaminated: a twentieth of the words or more lie in benchmark windows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def op7_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judged(find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select(
        F.col("src.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP7_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pattern AS (
  SELECT DISTINCT item_id, least(13, length(w)) AS m, array_to_string(w[i : i + least(13, length(w)) - 1], ' ') AS p
  FROM item, unnest(range(1, length(w) - least(13, length(w)) + 2)) AS u(i) WHERE length(w) > 0
), hit AS (
  SELECT DISTINCT o.doc_id, o.i, o.m, p.item_id
  FROM (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS p
        FROM doc, (SELECT DISTINCT m FROM pattern), unnest(range(1, length(w) - m + 2)) AS u(i)) o
  JOIN pattern p ON o.p = p.p AND o.m = p.m
), words_hit AS (
  SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM hit, unnest(range(i, i + m)) AS u(j) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, length(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= length(w) AS contaminated
FROM doc LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""
