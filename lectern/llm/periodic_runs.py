"""Periodic runs of words: maximal repetitions of four periods or more.

A run of period q from b up to 2b - 1, b a power of two, has at least 4q words, so
an aligned block of b words (one that starts at a multiple of b) and its copy q
words further on both lie in it. At each scale b an automaton holds the aligned
blocks as sequences of word numbers and finds them all over the document; a find
at a distance that fits the scale seeds a period, and the stretch around the two
is extended word by word, both ways, as far as the period holds.

Before that, one pass rules out what no run can reach: in a run each word but
those of the last period comes again within 2b words, for 3q words on end. Blocks
are searched only in such stretches, which ordinary text hardly has.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import with_fields

#: A run has at least so many words, and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words of a block that the automaton holds; the extension compares the rest.
KEY = 256
#: Words compared at first when a stretch is extended; then twice as many each time.
STEP = 32


def next_places(ids: np.ndarray) -> np.ndarray:
    """How far on each word comes again (the length of the text, if it doesn't)."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), len(ids), np.int64)
    again = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][again]] = np.diff(order)[again]
    return gap


def stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of the runs of true values that are ``least`` or longer."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    first, end = edge[::2], edge[1::2]
    long = end - first >= least
    return list(zip(first[long].tolist(), end[long].tolist()))


def agreeing(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from places a < b on are equal, going right (``step`` 1) or left (-1)."""
    n, width, room = 0, STEP, len(ids) - b if step > 0 else a + 1
    while n < room:
        width = min(width, room - n)
        if step > 0:
            differ = ids[a + n : a + n + width] != ids[b + n : b + n + width]
        else:
            differ = (ids[a - n - width + 1 : a - n + 1] != ids[b - n - width + 1 : b - n + 1])[::-1]
        if differ.any():
            return n + int(differ.argmax())
        n += width
        width *= 2
    return n


def divisors(q: int) -> list[int]:
    """q over each of its prime factors."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return out + ([q // rest] if rest > 1 else [])


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of a text of word numbers, by start, then period."""
    import ahocorasick

    n, runs = len(ids), set()
    if n < MIN_WORDS:
        return []
    gap = next_places(ids)
    known = np.zeros(n, np.int64)  # end of the furthest run of a smaller scale that covers a place
    b = 1
    while MIN_PERIODS * b <= n:
        found: dict[int, list[tuple[int, int]]] = {}
        size = min(b, KEY)
        for lo, hi in stretches(gap < 2 * b, max((MIN_PERIODS - 1) * b, MIN_WORDS - 2 * b + 1)):
            blocks = np.arange(-(-lo // b) * b, hi - b + 1, b)
            # where a run covers all of a block's distances at this scale, they are multiples of its smaller period
            blocks = blocks[known[blocks] < blocks + 3 * b - 1]
            if not len(blocks):
                continue
            places: dict[tuple, set[int]] = {}
            for p in blocks.tolist():
                places.setdefault(tuple(ids[p : p + size].tolist()), set()).add(p)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for block, at in places.items():
                automaton.add_word(block, at)
            automaton.make_automaton()
            for some in np.split(blocks, np.flatnonzero(np.diff(blocks) > 2 * b) + 1):
                first, end = int(some[0]) + b, min(n, int(some[-1]) + 3 * b - 1)
                for last, at in automaton.iter(tuple(ids[first:end].tolist())):
                    copy = first + last - size + 1
                    p = copy // b * b - b  # the only aligned place from which this one is b to 2b - 1 on
                    d = copy - p
                    if p not in at or copy + b > n or known[p] >= copy + b or any(s <= p and copy + b <= e for s, e in found.get(d, ())[-2:]):
                        continue
                    stop = copy + agreeing(ids, p, copy, 1)
                    if stop >= copy + b:  # the whole block
                        found.setdefault(d, []).append((p - (agreeing(ids, p - 1, copy - 1, -1) if p else 0), stop))
        for d, spans in found.items():
            for s, e in set(spans):
                if e - s >= max(MIN_WORDS, MIN_PERIODS * d) and not any((ids[s : s + d] == ids[s + k : s + k + d]).all() for k in divisors(d)):
                    runs.add((s, e - s, d))
                    known[s:e] = np.maximum(known[s:e], e)
        b *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repeated(ids: np.ndarray, crc: int) -> np.ndarray:
    """The contract's planted periods: of a tenth of the documents, words from place a on become those of the period that begins at a."""
    n, g = len(ids), crc // 10
    if crc % 10 or not n:
        return np.arange(n)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _row(words: list[bytes], crc: int | None) -> tuple:
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if crc is not None:
        at = repeated(ids, crc)
        if not crc % 10:
            ids, words = ids[at], [words[i] for i in at.tolist()]
    runs = find_runs(ids)
    if runs:
        gone = np.zeros(len(ids) + 1, np.int64)
        for s, n, q in runs:
            gone[s + q] += 1
            gone[s + n] -= 1
        words = [w for w, k in zip(words, (np.cumsum(gone[:-1]) == 0).tolist()) if k]
        s, n, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]))
        best = (s, n, q, 1000 * n // q)
    else:
        best = (None,) * 4
    return runs, *best, b" ".join(words).decode("utf-8", "replace")


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
FOUND = "runs array<struct<start: bigint, length: bigint, period: bigint>>, start bigint, length bigint, period bigint, exponent_milli bigint, kept string"
KINDS = [SPANS, *[pa.int64()] * 4, pa.string()]
NAMES = ["runs", "start", "length", "period", "exponent_milli", "kept"]


def _find(batches):
    for batch in batches:
        texts, crcs = batch.column("text"), batch.column("crc").to_pylist()
        rows = [_row((t.as_py() or b"").split(), c) for t, c in zip(texts, crcs)]
        columns = list(zip(*rows)) or [()] * len(NAMES)
        spans = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in columns[0]]
        yield pa.RecordBatch.from_arrays([batch.column("src"), *[pa.array(c, k) for c, k in zip((spans, *columns[1:]), KINDS)]], names=["src", *NAMES])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row ``src, runs, start, length, period, exponent_milli, kept`` per row of ``docs``; ``src`` holds its columns, or those in ``keep``.

    A run is a stretch of words with smallest period q, of 6 words and 4q at
    least, that the words beside it don't continue. ``runs`` has all of them by
    start, then period; the next four columns the longest (ties: smallest start,
    then period), null where there is none. ``kept`` are the words without those
    that lie in a run after its first period, joined by one space.

    ``plant`` makes a tenth of the texts periodic first, by the checksum of their
    id (a null id: never). Null and empty texts have no words and no runs; texts
    are whole, whatever their length; equal rows get equal results; an empty
    table gives an empty one.
    """
    src = F.struct(*(keep if keep is not None else ["*"])).alias("src")
    crc = F.crc32(F.col(id_col).cast("string").cast("binary")) if plant else F.lit(None)
    rows = docs.select(src, F.col(text_col).cast("binary").alias("text"), crc.cast("long").alias("crc"))
    return rows.mapInArrow(_find, with_fields(rows, "src", FOUND))


def op12_periodic_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic_runs(docs, plant=True, keep=["doc_id"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select(
        F.col("src.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", "exponent_milli",
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))) AS bits
  FROM documents
), hashed AS (
  SELECT doc_id, w, len(w) AS n, xor(list_reduce(bits, lambda x, y: xor(xor(x, y) // 2, 3988292384::BIGINT * (xor(x, y) % 2))), 4294967295::BIGINT) AS h FROM docs
), planted AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM hashed
), words AS (
  SELECT doc_id, n, i, w[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END + 1] AS word
  FROM planted, unnest(range(0, n)) AS u(i)
), again AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM again) t
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT r.* FROM stretches r WHERE NOT EXISTS (SELECT 1 FROM stretches s WHERE s.doc_id = r.doc_id AND s.q < r.q AND s.start <= r.start AND s.start + s.length >= r.start + r.length)
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS text FROM runs GROUP BY doc_id
), longest AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, q) = 1
), gone AS (
  SELECT DISTINCT doc_id, u.i FROM runs, unnest(range(start + q, start + length)) AS u(i)
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, m.start::BIGINT AS start, m.length::BIGINT AS length, m.q::BIGINT AS period, (1000 * m.length // m.q)::BIGINT AS exponent_milli,
       sha256(coalesce(l.text, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN longest m ON m.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
