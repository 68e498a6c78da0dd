"""Index-first search in bodies: an inverted index of trigrams, and bodies read for its candidates only.

The index is a folder of tables. ``postings`` has a gram's bodies in lists of at most
LISTED keys, ``counts`` how many bodies a gram has, ``bodies`` the texts, ``indexed``
the keys that are in the index. All but the last are in slices (a checksum of gram
or key) and sorted, so that a look-up opens the slices of its grams or keys and,
by Parquet's statistics, few pages of those. No list holds all bodies of a gram,
however common it is.

A body is immutable under its key: adding bodies appends. ``indexed`` is written
last, so that bodies of an unfinished addition count as not indexed, and those are
read and matched like any candidate: an index may be behind, never wrong.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.search import first_match, read_search_cursor, search_cursor
from lectern.stored import table

SLICES = 64
#: Code points of a text that are cut into grams at a time.
STRETCH = 100_000
#: Keys of a list of bodies at most, and grams with their bodies that a task gathers lists of at a time.
LISTED, GATHERED = 1_024, 1 << 20
#: Grams of a variant that are looked up, the rarest ones; the matcher sees to the rest.
MOST_GRAMS = 12
#: Candidates whose bodies are read together at first, and at most: their keys are what a page's search holds at the driver.
FEW, MANY = 64, 1_024


def normal(text: Column) -> Column:
    """As the matcher compares: lower case, runs of white space one space."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def slices_of(values: list, slices: int = SLICES) -> list[int]:
    return sorted({zlib.crc32(str(v).encode()) % slices for v in values})


def codes_of(text: str, stretch: int) -> np.ndarray:
    """The distinct runs of three code points of ``text``, 21 bits each, taken stretch by stretch."""
    found = []
    for at in range(0, len(text) - 2, stretch):
        a = np.frombuffer(text[at : at + stretch + 2].encode("utf-32-le"), np.uint32).astype(np.uint64)
        found.append(np.unique((a[:-2] << np.uint64(42)) | (a[1:-1] << np.uint64(21)) | a[2:]))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def listed(keys: pa.Array, codes: list[np.ndarray]) -> pa.RecordBatch:
    """``gram, keys`` of the bodies ``keys``, whose grams are ``codes``."""
    row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    gram, begin = np.unique(code[order], return_index=True)
    chars = np.stack([gram >> np.uint64(42), (gram >> np.uint64(21)) & np.uint64((1 << 21) - 1), gram & np.uint64((1 << 21) - 1)], 1)
    text = chars.astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(code)), pa.int32()), keys.take(pa.array(row[order])))
    return pa.RecordBatch.from_arrays([pa.array([text[k : k + 3] for k in range(0, len(text), 3)], pa.string()), lists], names=["gram", "keys"])


def gram_lists(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """``gram, keys``: the bodies that hold a gram, those of some LISTED bodies together; no list repeats a key that ``bodies`` has once."""
    stretch = STRETCH

    def run(batches):
        for batch in batches:
            codes, first, n = [], 0, 0
            for i, value in enumerate(batch.column(1), 1):
                codes.append(codes_of(value.as_py(), stretch))
                n += len(codes[-1])
                if n >= GATHERED or len(codes) == LISTED or i == batch.num_rows:
                    yield listed(batch.column(0).slice(first, len(codes)), codes)
                    codes, first, n = [], i, 0

    text = bodies.select(F.col(key).alias("key"), normal(F.col(body)).alias("t")).where(F.length("t") >= 3)
    return text.mapInArrow(run, T.StructType().add("gram", "string").add("keys", T.ArrayType(text.schema["key"].dataType)))


def grams_of(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """``gram, key``: the distinct runs of three code points of each text."""
    return gram_lists(bodies, key, body).select(F.explode("keys").alias("key"), "gram").select("gram", "key").distinct()


#: Schemas of the tables that were read, by their path.
SCHEMAS: dict[str, T.StructType] = {}


@dataclass(frozen=True)
class GramIndex:
    """An index in the folder ``path``; it keeps the number of slices it was made with."""

    spark: SparkSession
    path: str
    slices: int = SLICES

    def _slice(self, column: str) -> Column:
        return (F.crc32(F.col(column).cast("string").cast("binary")) % self.slices).cast("int").alias("slice")

    def _in_slice(self, column: str, values: list) -> Column:
        return F.col("slice").isin(slices_of(values, self.slices)) & F.col(column).isin(values)

    def add(self, bodies: DataFrame, key: str = "key", body: str = "body") -> GramIndex:
        """Index the bodies whose keys aren't in yet; of rows that repeat a key one counts, and a null key is no body's. A null body is empty."""
        new = bodies.where(F.col(key).isNotNull()).dropDuplicates([key])
        if self._has("indexed"):
            new = new.join(self.read("indexed").withColumnRenamed("key", key), key, "left_anti")
        new = table(new.select(F.col(key).alias("key"), F.coalesce(F.col(body), F.lit("")).alias("body")))
        # ranges of (slice, gram, first key): a gram of very many bodies spreads over tasks
        grams = table(gram_lists(new, "key", "body").select("*", self._slice("gram")))
        self._append("postings", grams, ["slice", "gram", F.get("keys", F.lit(0))])
        self._append("counts", grams.groupBy("slice", "gram").agg(F.sum(F.size("keys")).alias("n")), ["slice", "gram"])
        self._append("bodies", new.select("*", self._slice("key")), ["slice", "key"])
        new.select("key").write.mode("append").parquet(f"{self.path}/indexed")
        return self

    def _append(self, name: str, rows: DataFrame, order: list[str | Column]) -> None:
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("slice").option("parquet.block.size", 4 << 20).parquet(f"{self.path}/{name}")

    def _has(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str) -> DataFrame:
        """A table of the index; its schema is looked up once a process, since it never changes."""
        at = f"{self.path}/{name}"
        if at not in SCHEMAS:
            SCHEMAS[at] = self.spark.read.parquet(at).schema
        return self.spark.read.schema(SCHEMAS[at]).parquet(at)

    def postings(self, grams: list[str]) -> DataFrame:
        """``gram, key`` of the bodies that hold one of ``grams``."""
        return self.read("postings").where(self._in_slice("gram", grams)).select("gram", F.explode("keys").alias("key"))

    def bodies(self, keys: list) -> DataFrame:
        """The texts of ``keys``, from their slices alone."""
        return self.read("bodies").where(self._in_slice("key", keys)).select("key", "body")

    def candidates(self, variants: list[str]) -> DataFrame | None:
        """Keys of the indexed bodies that may hold one of ``variants``; None if that is any (a variant of under three characters)."""
        asked = [v.lower() for v in variants]
        if not asked or any(len(v) < 3 for v in asked):
            return None
        return reduce(DataFrame.union, map(self._holding, asked)).distinct()

    def _holding(self, variant: str) -> DataFrame:
        grams = sorted({variant[i : i + 3] for i in range(len(variant) - 2)})
        counts = self.read("counts").where(self._in_slice("gram", grams))
        # a row for each gram of a query, which has at most a hundred
        known = {r.gram: r.n for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        rarest = sorted(grams, key=lambda g: (known.get(g, 0), g))[:MOST_GRAMS]
        # postings of an unfinished addition may repeat
        found = self.postings(rarest[:1]).select("key").distinct()
        if len(rarest) == 1:
            return found
        others = self.postings(rarest[1:]).join(found, "key", "left_semi").select("key", "gram").distinct()
        return others.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest) - 1).select("key")


def search_page(chapters: DataFrame, index: GramIndex, variants: list[str], limit: int = 50, start: int = 0, bodies: DataFrame | None = None, separator: str = "\n\n") -> DataFrame:
    """The next hits of one book from chapter ``start`` on, in order, one more than ``limit`` if there are more.

    ``chapters``: position, title, key (positions are unique in a book). A body
    is read if its chapter's key is a candidate or isn't indexed (then from
    ``bodies``: key, body); of other chapters the title alone can match. Bodies
    are read some candidates at a time, until the page is full. A chapter
    without a key, or whose body nobody has, is matched by its title.
    """
    rows = chapters.where(F.col("position") >= start).select("position", "title", "key")
    may = index.candidates(variants)
    indexed = index.read("indexed").distinct()
    title = reduce(lambda a, b: a | b, [F.lower(F.regexp_replace("title", r"\s+", " ")).contains(v.lower()) for v in variants])
    if may is None:
        told = rows.join(indexed.withColumn("known", F.lit(True)), "key", "left").withColumn("may", F.col("known"))
    else:
        told = rows.join(indexed.withColumn("known", F.lit(True)), "key", "left").join(may.withColumn("may", F.lit(True)), "key", "left")
    told = told.withColumns({"known": F.coalesce("known", F.lit(False)), "may": F.coalesce("may", F.lit(False))})
    told = told.where(F.col("may") | ~F.col("known") | title)
    kind = rows.schema
    out = T.StructType([kind["position"], kind["title"], *T.StructType.fromDDL("paragraph int, match_start int, snippet string").fields])

    found: list[Row] = []
    after, width = None, FEW
    while len(found) <= limit:
        # at most MANY rows without their bodies, and of their hits the snippets
        some = (told if after is None else told.where(F.col("position") > after)).orderBy("position").limit(width).collect()
        if not some:
            break
        held = index.bodies([r.key for r in some if r.may])
        rest = [r.key for r in some if not r.known and r.key is not None]
        if rest and bodies is not None:
            held = held.unionByName(bodies.where(F.col("key").isin(rest)).dropDuplicates(["key"]).select("key", "body"))
        asked = index.spark.createDataFrame([(r.position, r.title, r.key) for r in some], kind)
        hit = first_match(F.coalesce("body", F.lit("")), F.col("title"), variants, separator)
        hits = asked.join(held, "key", "left").withColumn("m", hit).where("m IS NOT NULL").select("position", "title", "m.*")
        found += sorted(hits.collect(), key=lambda r: r.position)
        if len(some) < width:
            break
        after, width = some[-1].position, min(4 * width, MANY)
    return index.spark.createDataFrame(found[: limit + 1], out)


def search_next(chapters: DataFrame, index: GramIndex, variants: list[str], asked: str, revision: str, cursor: str | None = None, limit: int = 50, bodies: DataFrame | None = None, separator: str = "\n\n") -> tuple[DataFrame, str | None]:
    """A page of at most ``limit`` hits and the cursor of the next one, None after the last.

    ``asked`` and ``revision`` name the search and the version of the book; a
    cursor of another is refused (ValueError says why).
    """
    start, shown = read_search_cursor(cursor, asked, revision, chapters.count()) if cursor else (0, 0)
    # one row more than a page
    page = search_page(chapters, index, variants, limit, start, bodies, separator)
    shown_rows = page.collect()
    if len(shown_rows) <= limit:
        return page, None
    return index.spark.createDataFrame(shown_rows[:limit], page.schema), search_cursor(asked, revision, shown_rows[limit].position, shown + limit)
