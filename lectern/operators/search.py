"""Search within bodies: an index that rules bodies out, and the exact match."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.scalars import IMAGE, let, paragraphs

BEFORE, AFTER = 72, 112
BLOOM_BITS, BLOOM_HASHES, MOST_GRAMS = 16 * 1024 * 8, 3, 100_000


def first_match(body: Column, title: Column, variants: list[str], separator: str = "\n\n") -> Column:
    """``paragraph, match_start, snippet`` of the first paragraph with any variant, at its earliest place; else of the title.

    Image paragraphs are skipped. White space is collapsed; places count code
    points. Null where nothing matches.
    """
    vs = [v.lower() for v in variants]

    def at(text: Column) -> Column:
        found = [F.locate(v, F.lower(text)) for v in vs]
        hits = [F.when(f > 0, f) for f in found]
        return reduce(F.least, hits) if len(hits) > 1 else hits[0]

    if not any(c.isspace() for v in vs for c in v):  # what no white space can make is there or isn't, before any paragraph is looked at
        body = F.when(reduce(lambda a, b: a | b, [F.lower(body).contains(v) for v in vs]), body).otherwise("")
    tidy = F.transform(paragraphs(body, separator), lambda p, i: F.struct(i.alias("i"), F.when(~p.rlike(IMAGE), F.btrim(F.regexp_replace(p, r"\s+", " "))).alias("p")))
    hit = F.get(F.filter(tidy, lambda s: at(s["p"]).isNotNull()), F.lit(0))

    def shown(text: Column, index: Column) -> Column:
        return let(at(text) - 1, lambda place: around(text, index, place))

    def around(text: Column, index: Column, place: Column) -> Column:
        start = F.greatest(F.lit(0), place - BEFORE)
        end = F.least(F.length(text), place + AFTER)
        lead, tail = F.when(start > 0, "…").otherwise(""), F.when(end < F.length(text), "…").otherwise("")
        return F.struct(index.alias("paragraph"), (place - start + F.length(lead)).alias("match_start"), F.concat(lead, F.substring(text, start + 1, end - start), tail).alias("snippet"))

    name = F.btrim(F.regexp_replace(title, r"\s+", " "))
    return let(hit, lambda h: F.when(h.isNotNull(), shown(h["p"], h["i"])).when(at(name).isNotNull(), shown(name, F.lit(0))))


def _slots(text: str) -> np.ndarray:
    a = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    if len(a) < 3:
        return np.zeros((0, BLOOM_HASHES), np.int64)
    g = np.unique(a[:-2] << np.uint64(32) | a[1:-1] << np.uint64(16) | a[2:])
    h = (g[:, None] + np.arange(1, BLOOM_HASHES + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(47)).astype(np.int64) % BLOOM_BITS


#: Before the bits: what the bytes are, and a checksum of the bits.
MAGIC = b"BIX1"


def _sealed(bits: bytes) -> bytes:
    return MAGIC + zlib.crc32(bits).to_bytes(4, "big") + bits


def _opened(raw: bytes | None) -> np.ndarray | None:
    """The bits of an index; None for one that is missing, of another kind or size, or damaged."""
    if raw is None or len(raw) != BLOOM_BITS // 8 + 8 or raw[:4] != MAGIC or zlib.crc32(raw[8:]).to_bytes(4, "big") != raw[4:8]:
        return None
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8))


#: Bodies whose indexes a task holds at a time.
AT_A_TIME = 64


@F.arrow_udf(T.BinaryType())
def body_index(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A Bloom filter over trigrams; all ones for a body with too many."""

    def build(text):
        bits = np.zeros(BLOOM_BITS, bool)
        slots = _slots(text or "")
        bits[slots.ravel()] = True
        if len(slots) > MOST_GRAMS:
            bits[:] = True
        return _sealed(np.packbits(bits).tobytes())

    for batch in bodies:
        for at in range(0, len(batch), AT_A_TIME):
            yield pa.array([build(t.as_py()) for t in batch.slice(at, AT_A_TIME)], pa.binary())


def may_contain(index: Column, variants: list[str]) -> Column:
    """False only if no variant can be in the body. Variants under three characters, and broken indexes, rule nothing out."""
    if any(len(v) < 3 for v in variants):
        return F.lit(True)
    wanted = [_slots(v) for v in variants]

    @F.pandas_udf("boolean")
    def test(s: pd.Series) -> pd.Series:
        def one(raw):
            bits = _opened(raw)
            return bits is None or any(bits[w.ravel()].all() for w in wanted)

        return s.map(one)

    return test(index)


def search_book(chapters: DataFrame, variants: list[str], limit: int = 50, start: int = 0, separator: str = "\n\n") -> DataFrame:
    """The next hits of one book from chapter ``start`` on, in order, one more than ``limit`` if there are more.

    ``chapters``: position, title, body, and body_index if there is one.
    """
    rows = chapters.where(F.col("position") >= start)
    if "body_index" in chapters.columns:
        title = reduce(lambda a, b: a | b, [F.lower("title").contains(v.lower()) for v in variants])
        rows = rows.where(may_contain(F.col("body_index"), variants) | title)
    hits = rows.withColumn("m", first_match(F.col("body"), F.col("title"), variants, separator)).where("m IS NOT NULL")
    return hits.select("position", "title", "m.*").orderBy("position").limit(limit + 1)


def _check(filter_: str, revision: str, at: int, shown: int) -> str:
    return hashlib.sha256(json.dumps([1, filter_, revision, at, shown]).encode()).hexdigest()[:32]


def search_cursor(filter_: str, revision: str, at: int, shown: int) -> str:
    """Where the next page of a search begins: the chapter's place, how many hits were shown, for which search and version of the book."""
    body = {"v": 1, "f": filter_, "r": revision, "n": at, "s": shown, "check": _check(filter_, revision, at, shown)}
    return base64.urlsafe_b64encode(json.dumps(body).encode()).decode().rstrip("=")


def read_search_cursor(raw: str, filter_: str, revision: str, chapters: int) -> tuple[int, int]:
    """Place and shown hits of a cursor; ValueError says why it can't be used."""
    try:
        got = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4))) if len(raw) <= 2048 else None
        at, shown = got["n"], got["s"]
        whole = all(type(x) is int and 0 <= x < 1 << 53 for x in (at, shown))
        if got["v"] != 1 or not whole or got["check"] != _check(got["f"], got["r"], at, shown):
            raise ValueError
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("invalid_cursor") from e
    if got["f"] != filter_:
        raise ValueError("cursor_filter_mismatch")
    if got["r"] != revision:
        raise ValueError("search_version_changed")
    if at >= chapters or shown > chapters:
        raise ValueError("invalid_cursor")
    return at, shown
