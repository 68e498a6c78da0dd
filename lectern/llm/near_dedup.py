"""MinHash near-duplicate detection with tensored banding.

A table key pairs one of m half keys from a first collection of minhashes with
one of m from a second, so m * m tables cost 2 * m * ROWS minhashes. Half keys
that only one text has can't make a shared table key and are dropped before any
pair is formed. Links are confirmed on the full shingle sets.

Within a table bucket, members are compared with a pivot, not with each other:
texts found to be in one component need no further comparison. Shingles that
only one text has bound its similarity to any other; the bound is exact and rules
most pairs out unseen. What pivots leave open, the texts of half keys that several
components still share, meets at rare shingles: only shingles that more than one
component has can be common to a pair across components, and of two linked texts
each has one of the pair's common shingles among its first few, in the order of
their rarity (the prefix filter). Places in that order bound the rest. So no link
that a bucket shows is lost, and no two texts of a bucket meet just for being there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import WordHashes, drop, mix, runs, signed, table

SHINGLE = 4
PERCENT = 80
#: m half keys of ROWS minhashes each, from either collection: two texts with
#: 80% of shingles in common share no table key once in 48,000 times.
HALVES, ROWS = 16, 3
#: Rounds of pivots before the rest meets at rare shingles.
PIVOT_ROUNDS = 2
#: Words of 64 bits in the map that sifts texts before a join.
SIFT = 1 << 18
NO_ID = -(1 << 63)


def shingle_set(text: bytes | None, word: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of fewer words, the whole sequence's one."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    return np.unique(runs(word(w), min(n, len(w))))


#: A column each; 32 bits, which numpy multiplies several at a time. Chance agreements only add candidates.
_SEEDS = mix(np.arange(1, 2 * HALVES * ROWS + 1, dtype=np.uint64)).astype(np.uint32)[:, None]
_ODD = mix(np.arange(1, 2 * HALVES * ROWS + 1, dtype=np.uint64) + np.uint64(1 << 32)).astype(np.uint32)[:, None] | np.uint32(1)


def half_keys(s: np.ndarray) -> np.ndarray:
    """2 * HALVES hashes; bit 0 tells the collection."""
    s = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_SEEDS), np.uint32(0xFFFFFFFF))
    for i in range(0, len(s), 1024):
        part = s[i : i + 1024] ^ _SEEDS
        part *= _ODD
        np.minimum(least, part.min(axis=1), out=least)
    grouped = least.reshape(2 * HALVES, ROWS).astype(np.uint64)
    key = np.arange(2 * HALVES, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x5851F42D4C957F2D) + grouped[:, r])
    side = (np.arange(2 * HALVES) >= HALVES).astype(np.uint64)
    return (key & ~np.uint64(1)) | side


def signatures(n: int):
    def run(batches):
        word = WordHashes()
        for batch in batches:
            sizes, f1, f2, keys = [], [], [], []
            for value in batch.column(2).cast(pa.binary()):
                s = shingle_set(value.as_py(), word, n)
                sizes.append(len(s))
                f1.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                f2.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x51ED270B))).astype(np.int64)) if len(s) else 0)
                keys.append(signed(half_keys(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "mark", "n_shingles", "f1", "f2", "halves"],
            )

    return run


def confirm(n: int, percent: int):
    """Keeps pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        word = WordHashes()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("text_a").cast(pa.binary()).to_pylist(), batch.column("text_b").cast(pa.binary()).to_pylist()):
                s, t = shingle_set(a, word, n), shingle_set(b, word, n)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])

    return run


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, comp``: the smallest id reachable over ``edges (a, b)``. Labels take the least of their neighbours' and then their label's label, until none changes."""
    both = table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = table(nodes.select("id", F.col("id").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        hooked = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("comp", F.coalesce("near", "comp")).alias("comp"), F.col("comp").alias("was"))
        hooked = table(hooked)
        up = hooked.select(F.col("id").alias("up_id"), F.col("comp").alias("up"))
        jumped = table(hooked.join(up, F.col("comp") == F.col("up_id"), "left").select("id", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "was"))
        changed = jumped.where("comp <> was").limit(1).count()
        drop(labels)
        drop(hooked)
        labels = jumped.select("id", "comp")
        if not changed:
            drop(both)
            return labels


def shingles_of(n: int):
    def run(batches):
        word = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, word, n) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(signed(np.concatenate(sets)) if sets else [], pa.int64())], names=["id", "s"])

    return run


def rare_meetings(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b``: pairs of ``texts (id, text, size, least, comp)`` in different components that may have 100 * intersection >= percent * union; all that do are there.

    A partner has ``least`` shingles or more, and ``percent`` of the text's own
    number. So much gives a number of shingles, ``enough``, that a linked pair
    has in common at least; one of a text's first ``size - enough + 1``, in any
    one order of all shingles, is then common to both and among the other's
    first ones too. The order: what only one component has, which no pair
    shares, then from rare to frequent.
    """
    grams = table(texts.select("id", "text").mapInArrow(shingles_of(n), "id long, s long").join(texts.select("id", "comp"), "id"))
    across = grams.groupBy("s").agg(F.count("*").alias("n"), F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select("s", "n")
    shared = table(grams.join(across, "s"))
    partner = F.greatest(F.col("least") * 100, F.col("size") * percent)
    enough = F.ceil((F.col("size") * 100 + partner) * percent / (100 * (100 + percent)))
    counted = texts.select("id", "size", "least").join(shared.groupBy("id").agg(F.count("*").alias("common")), "id").where(F.col("common") >= enough)
    place = F.row_number().over(Window.partitionBy("id").orderBy("n", "s"))
    first = shared.join(counted, "id").withColumn("place", place).where(F.col("place") <= F.col("common") - enough + 1)
    first = table(first.select("s", "id", "comp", "size", "common", "place"))
    # of two texts of different components one is not in the shingle's main one, whose many texts don't meet each other
    main = first.groupBy("s", "comp").agg(F.count("*").alias("n")).groupBy("s").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("s", F.col("m.comp").alias("main"))
    met = table(first.join(table(main), "s"))
    # where a pair meets for the first time, what is common to both comes there or later
    rest = F.least(F.col("x.common") - F.col("x.place"), F.col("y.common") - F.col("y.place")) + 1
    pairs = met.where("comp <> main").alias("x").join(met.alias("y"), "s").where((F.col("x.comp") != F.col("y.comp")) & (rest * (100 + percent) >= (F.col("x.size") + F.col("y.size")) * percent))
    return pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def linked(texts: DataFrame, tables: DataFrame, sizes: DataFrame, n: int, percent: int) -> DataFrame:
    """``id, comp`` of the ids in ``tables (key, u, id)`` that can have links.

    ``own`` counts the shingles that no other text in ``tables`` has. They are in
    no intersection, so own and size bound the similarity of any pair, and with
    nothing but own and size most texts turn out to have no partner at all.
    """
    ids = table(tables.select("id").distinct())
    held = table(texts.join(ids, "id").join(sizes, "id").select("id", "text", "n_shingles"))
    alone = held.select("id", "text").mapInArrow(shingles_of(n), "id long, s long").groupBy("s").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count("*").alias("own"))
    most = 100 + percent
    facts = table(sizes.join(ids, "id").join(alone, "id", "left").select("id", F.col("n_shingles").alias("size"), F.coalesce("own", F.lit(0)).alias("own")).where((F.col("size") - F.col("own")) * 100 >= F.col("size") * percent))
    rows = table(tables.join(facts, "id"))
    least = table(rows.groupBy("key").agg(F.min("size").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    partner = F.greatest(F.col("least") * 100, F.col("size") * percent)
    rows = table(rows.join(least, "key").where((F.col("size") - F.col("own")) * most * 100 >= percent * (F.col("size") * 100 + partner)).drop("least"))

    def possible(a: str, b: str):
        """Whether the bounds of two rows allow a link."""
        common = F.least(F.col(f"{a}.size") - F.col(f"{a}.own"), F.col(f"{b}.size") - F.col(f"{b}.own"))
        return common * most >= (F.col(f"{a}.size") + F.col(f"{b}.size")) * percent

    def check(pairs: DataFrame) -> DataFrame:
        left = held.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        right = held.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        return table(pairs.join(left, "a").join(right, "b").mapInArrow(confirm(n, percent), "a long, b long"))

    # the text with the fewest shingles of its own is nearest to the middle of its group
    middle = table(rows.groupBy("key").agg(F.min(F.struct("own", "id", "size")).alias("p"), F.count("*").alias("n")).where("n > 1").select("key", "p"))
    nearest = rows.alias("x").join(middle.select("key", "p.*").alias("p"), "key").where((F.col("x.id") != F.col("p.id")) & possible("x", "p"))
    edges = check(table(nearest.groupBy(F.col("x.id").alias("b")).agg(F.min(F.struct("p.own", "p.id")).alias("p")).select(F.col("p.id").alias("a"), "b")))
    comps = components(facts, edges)
    for turn in range(PIVOT_ROUNDS):
        placed = table(rows.join(comps, "id"))
        rank = F.col("own") if turn == 0 else F.xxhash64(F.lit(turn), F.col("id"))
        pick = F.struct(rank.alias("rank"), F.col("id"), F.col("size"), F.col("own"), F.col("comp"))
        split = placed.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.min(pick).alias("pivot")).where("p <> q")
        split = table(split.select("key", "pivot.id", "pivot.size", "pivot.own", "pivot.comp"))
        if split.isEmpty():
            return comps
        placed = table(placed.join(split.select("key"), "key"))
        rows = placed.drop("comp")
        if turn == 0:
            met = placed.alias("x").join(split.alias("y"), "key")
        else:
            # what shares a table key shares its first half key. A half key each, another text for each: a text meets several members of its group
            by_half = table(placed.drop("key").distinct())
            pick = F.struct(F.xxhash64(F.lit(turn), "id", "u").alias("rank"), "id", "size", "own", "comp")
            # a table: the join meets plain exchanges, which adaptive execution can split where a half key is hot
            pivots = table(by_half.groupBy("u").agg(F.min(pick).alias("p")).select("u", "p.*"))
            met = by_half.alias("x").join(pivots.alias("y"), "u")
        met = met.where((F.col("x.comp") != F.col("y.comp")) & possible("x", "y"))
        found = check(table(met.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()))
        if not found.isEmpty():
            edges = table(edges.unionByName(found))
            comps = components(facts, edges)
    placed = table(rows.join(comps, "id"))
    split = placed.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.min("size").alias("least")).where("p <> q").select("key", "least")
    left = table(placed.join(split, "key").groupBy("id", "size", "comp").agg(F.min("least").alias("least")))
    if left.isEmpty():
        return comps
    found = check(table(rare_meetings(left.join(held.select("id", "text"), "id"), n, percent)))
    return comps if found.isEmpty() else components(facts, edges.unionByName(found))


def sifted(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without most of those that ``wanted`` has no match for, so that a join with it needn't shuffle their texts.

    A map of SIFT words of 64 bits, a row a word, tells which hashes occur: its
    size is bounded whatever the tables', and no match is lost.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(64 * SIFT))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = wanted.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    there = (F.floor(place / 64) == F.col("word")) & (F.col("bits").bitwiseAND(bit) != 0)
    return rows.join(F.broadcast(table(words)), there, "left_semi")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, mark, n_shingles, component_id, kept, component``, a row per row of ``docs``; ``mark`` is xxhash64 of the text.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Texts without words
    (null and empty ones too) are linked with nothing. ``kept`` rows have the
    smallest id of their component. A null id is an id of its own below all
    others; rows that repeat an id get the component of their own text.
    ``component`` tells components apart that have one smallest id; it is null
    for texts without words. An empty table gives an empty one.
    """
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id")
    texts = docs.select(ident, F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    per_row = table(texts.mapInArrow(signatures(shingle), "id long, mark long, n_shingles long, f1 long, f2 long, halves array<long>"))
    # equal sets are one class with a number of its own: ids may be null or repeat
    kind = ["f1", "f2", "n_shingles"]
    filled = per_row.where("n_shingles > 0")
    classes = table(filled.groupBy(*kind).agg(F.min(F.struct("id", "mark")).alias("one"), F.first("halves").alias("halves")).select(*kind, F.col("one.id").alias("least"), F.col("one.mark").alias("mark"), "halves", F.monotonically_increasing_id().alias("id")))
    halves = classes.select("id", F.explode("halves").alias("half"))
    shared = table(halves.groupBy("half").agg(F.min("id").alias("p"), F.max("id").alias("q")).where("p <> q").select("half"))
    even = F.col("half").bitwiseAND(1) == 0
    mine = halves.join(shared, "half").groupBy("id").agg(F.collect_set(F.when(even, F.col("half"))).alias("u"), F.collect_set(F.when(~even, F.col("half"))).alias("v"))
    keys = table(mine.select("id", F.explode("u").alias("u"), "v").select("id", "u", F.explode("v").alias("v")).select(F.xxhash64("u", "v").alias("key"), "u", "id"))
    buckets = table(keys.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("q")).where("p <> q").select("key"))
    tables = table(keys.join(buckets, "key"))
    # one text of each class stands for it
    met = table(classes.join(tables.select("id").distinct(), "id", "left_semi").select("id", F.col("least").alias("of"), "mark"))
    stand = sifted(texts.withColumnRenamed("id", "of"), met, ["of", "mark"]).join(met, ["of", "mark"]).dropDuplicates(["of", "mark"]).select("id", "text")
    comps = linked(stand, tables, classes.select("id", "n_shingles"), shingle, percent)

    grouped = table(classes.join(comps, "id", "left").select(*kind, "least", F.coalesce("comp", "id").alias("comp")))
    named = grouped.groupBy("comp").agg(F.min("least").alias("smallest"))
    classed = table(grouped.join(named, "comp").select(*kind, "comp", "smallest"))
    comp = F.coalesce("smallest", "id")
    shown = F.when(comp != NO_ID, comp)
    return per_row.join(classed, kind, "left").select("id", "mark", "n_shingles", shown.alias("component_id"), (F.col("id") == comp).alias("kept"), F.col("comp").alias("component"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of ``docs`` for each component, and every row without words, with their columns.

    Of the rows of a component that have its smallest id, one stays: that of the
    least ``mark``, and of equal rows any.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings).where("kept AND component IS NOT NULL")
    copies = found.groupBy("component", "id", "mark").agg(F.count("*").alias("n"))
    kept = table(copies.groupBy("component").agg(F.min(F.struct("id", "mark", "n")).alias("k")).select("k.*"))
    rows = docs.select(F.struct("*").alias("src"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"))
    words = F.coalesce(F.col(f"src.{text_col}").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    filled = rows.where(words)
    once = filled.join(table(kept.where("n = 1")), ["id", "mark"], "left_semi")
    repeated = filled.join(table(kept.where("n > 1")), ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    return once.unionByName(repeated).unionByName(rows.where(~words)).select("src.*")


def op6_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM docs, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT c.a, c.b FROM common c JOIN sizes p ON p.doc_id = c.a JOIN sizes q ON q.doc_id = c.b WHERE 100 * c.n >= 80 * (p.n + q.n - c.n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM docs d JOIN least l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
