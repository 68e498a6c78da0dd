"""The prefix tree of all conversations, by preorder intervals.

A node is a distinct sequence of first turns. Conversations are ranked in the
tree's lexicographic order, so that the members of a node are an interval of
ranks, and the nodes, ordered by first rank and depth, stand in preorder: a
subtree is the interval of places from its top to the last node that starts at
the node's last rank. Leaves and savings of a subtree are then the difference of
two prefix sums over all nodes.

Nothing is recursive, and nothing needs a conversation, a node's members or a
level of the tree in one task: places in a conversation, hashes of prefixes and
the preorder sums are segmented prefix scans (``scan.running``), counts are
partial aggregates, and ids of the conversations that end at a node are hashed
as a stream of chunks.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.mixing import n_words
from lectern.llm.shared import table
from lectern.operators.scan import running

#: Conversations that share a base, and the most turns they take from it, as the contract states them.
SHARED_BY, BORROWED = 20, 4
#: Ids in one chunk of a node's hashed list.
CHUNK = 4_096
#: Code points of a text that rows of one turn are dealt out by, and further ones of texts that start alike.
HEAD, NEXT = 64, 1_024
NODE = ["n1", "n2"]
LANES = [f"s{i}" for i in range(4)]


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, at, t1, t2, words`` per turn: its place from 1 in its conversation, a 128-bit digest, its words.

    Turns come in the order of ``turn``, null first; rows of the same turn by
    role, then text. A null role or text is empty. Rows that repeat others are
    turns of their own. Rows without conversation belong to none and are left
    out. Texts end here: what follows carries digests. The order needs a whole
    text only where several of one turn and role start alike: rows are dealt out
    by its first code points, and those that are still alike are sorted by it.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.substring(text, 1, HEAD).alias("head"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(7), role, text).alias("t2"), n_words(text).alias("words"), F.lit(1).cast("long").alias("one"), text.alias("text"),
    ).withColumn("slot", F.xxhash64("conv_id", "turn", "role", "head"))
    alike = table(rows.groupBy("slot").agg(F.min("t1").alias("least"), F.max("t1").alias("most")).where("least < most").select("slot", F.lit(True).alias("alike")))
    if alike.isEmpty():
        return running(table(rows.drop("slot", "text")), ["conv_id"], ["turn", "role", "head"], {"at": "one"}).select("conv_id", "at", "t1", "t2", "words")
    whole = F.when(F.col("alike"), F.col("text")).otherwise("")
    rows = rows.join(alike, "slot", "left").withColumns({"next": F.substring(whole, HEAD + 1, NEXT), "text": whole}).drop("slot", "alike")
    return running(table(rows), ["conv_id"], ["turn", "role", "head", "next"], {"at": "one"}, ["text"]).select("conv_id", "at", "t1", "t2", "words")


def with_shared_start(turns: DataFrame, shared_by: int = SHARED_BY, most: int = BORROWED) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt over a common start: their turns with place ``depth`` and the conversation's new ``length``; and ``conv_id, length`` of all.

    Of conversation c the first h turns are those of conversation c - c % 20
    (all, if it has fewer; none, if there is no such conversation), h being
    crc32 of the decimal id modulo 4; then come its own after its first h.
    """
    turns = table(turns)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    known = sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % shared_by, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    known = known.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    known = table(known.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    own = turns.join(known, "conv_id").where("at > h").withColumn("depth", F.col("at") - F.col("h") + F.col("taken"))
    # at most three turns of a base meet the conversations of its twenty ids
    starts = turns.where((F.col("at") < most) & (F.col("conv_id") % shared_by == 0)).withColumnRenamed("conv_id", "base")
    lent = starts.join(known, "base").where("at <= taken").withColumn("depth", F.col("at"))
    columns = ["conv_id", "depth", "length", "t1", "t2", "words"]
    return own.select(*columns).unionByName(lent.select(*columns)), known.select("conv_id", "length")


def _node(depth: Column, lanes: list[Column]) -> list[Column]:
    return [F.xxhash64(depth, *lanes).alias("n1"), F.xxhash64(F.lit(7), depth, *lanes).alias("n2")]


def with_nodes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, words, last, n1, n2, p1, p2`` per turn: the node it leads to and that node's parent, each a 128-bit name.

    A prefix's name comes from sums, over its turns, of hashes of place and
    turn, kept in four lanes of 32 bits: sums of so short values don't overflow
    within 2**31 turns, and can be had by a scan however long a conversation is.
    """
    a, b = F.xxhash64("depth", "t1", "t2"), F.xxhash64(F.lit(7), "depth", "t1", "t2")
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    lanes = [low(a), F.shiftrightunsigned(a, 32), low(b), F.shiftrightunsigned(b, 32)]
    rows = turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "words", (F.col("depth") == F.col("length")).alias("last"), *[x.alias(f"v{i}") for i, x in enumerate(lanes)])
    summed = running(rows, ["conv_id"], ["depth"], {s: f"v{i}" for i, s in enumerate(LANES)})
    one = F.lit(1).cast("long")
    parent = _node(F.col("depth") - one, [F.col(s) - F.col(f"v{i}") for i, s in enumerate(LANES)])
    return summed.select("conv_id", "depth", "words", "last", *_node(F.col("depth"), [F.col(s) for s in LANES]), parent[0].alias("p1"), parent[1].alias("p2"))


def _chunks(batches):
    """Ids that come sorted by node, as comma-joined pieces of a node's list."""
    for batch in batches:
        n1, n2, ids = (batch.column(c).to_pylist() for c in ("n1", "n2", "conv_id"))
        out = []
        for (a, b), places in groupby(range(len(ids)), lambda i: (n1[i], n2[i])):
            places = list(places)
            for first in range(0, len(places), CHUNK):
                piece = [ids[i] for i in places[first : first + CHUNK]]
                out.append((a, b, piece[0], ",".join(map(str, piece))))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=["n1", "n2", "first", "piece"])


def _digests(batches):
    """SHA-256 of each node's pieces, which come in order: only the hash under way is held."""
    node, sha = None, None
    for batch in batches:
        done = []
        for a, b, piece in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "piece"))):
            if (a, b) != node:
                if node:
                    done.append((*node, sha.hexdigest()))
                node, sha = (a, b), hashlib.sha256(piece.encode())
            else:
                sha.update(b"," + piece.encode())
        yield _digest_rows(done)
    if node:
        yield _digest_rows([(*node, sha.hexdigest())])


def _digest_rows(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["n1", "n2", "ends_sha256"])


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``n1, n2, ends_sha256``: of the ids (conv_id) that end at a node, ascending, comma-joined.

    The list of a node with very many is made in pieces by the tasks that hold
    its ranges of ids; one task then hashes the pieces in order, as a stream.
    """
    pieces = table(ends.repartitionByRange("n1", "n2", "conv_id").sortWithinPartitions("n1", "n2", "conv_id").mapInArrow(_chunks, "n1 long, n2 long, first long, piece string"))
    return pieces.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "first").select("n1", "n2", "piece").mapInArrow(_digests, "n1 long, n2 long, ends_sha256 string")


def prefix_tree(turns: DataFrame, members: DataFrame) -> DataFrame:
    """All nodes of the tree of ``turns`` (conv_id, depth from 1, length, t1, t2, words); ``members`` lists all conv_ids, turnless ones too.

    Per node: conv_id, its smallest member; depth; parent_conv_id, the parent's
    conv_id (root: null); n_convs, members; n_children; n_leaves, childless nodes
    in its subtree; saved_tokens, summed over the subtree, words of a node's last
    turn times members less one; ends_sha256, of the members that end there;
    place, in preorder from 1, and last_place, where its subtree ends. Without
    members there is no node, not even the root.
    """
    rows = table(with_nodes(turns))
    zero = F.lit(0).cast("long")
    root = _node(zero, [zero] * 4)
    no_parent = F.lit(None).cast("long")
    top = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    top = top.select(*root, "conv_id", zero.alias("depth"), zero.alias("words"), "n_convs", no_parent.alias("p1"), no_parent.alias("p2"))
    met = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.count("*").alias("n_convs"), F.min(F.struct("p1", "p2")).alias("p"))
    nodes = table(met.select(*NODE, "conv_id", "depth", "words", "n_convs", "p.p1", "p.p2").unionByName(top))

    above = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"))
    children = nodes.where("p1 IS NOT NULL").groupBy("p1", "p2").agg(F.count("*").alias("n_children")).select(F.col("p1").alias("n1"), F.col("p2").alias("n2"), "n_children")
    nodes = nodes.join(above, ["p1", "p2"], "left").join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = table(nodes.select(*NODE, "conv_id", "depth", "words", "n_convs", "parent_conv_id", "n_children", (F.col("n_convs") < F.col("parent_convs")).alias("parts")))

    # conversations of the same turns end at the same node: one of them stands for all
    ends = table(rows.where("last").select(*NODE, "conv_id").unionByName(members.where("length = 0").select(*root, "conv_id")))
    stands = table(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id")).select("conv_id"))
    own = table(rows.select("conv_id", "depth", *NODE).join(stands, "conv_id", "left_semi"))
    # the sort key of a sequence: its nodes with fewer members than their parent. Elsewhere all members go the same way
    digits = F.concat(F.lpad(F.hex("n1"), 16, "0"), F.lpad(F.hex("n2"), 16, "0"))
    forks = own.join(nodes.where("parts").select(*NODE), NODE).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", digits.alias("name")))).alias("forks"))
    keys = stands.join(forks, "conv_id", "left").select("conv_id", F.coalesce(F.array_join("forks.name", ""), F.lit("")).alias("path"), F.lit(1).cast("long").alias("one"))
    ranked = table(running(keys, [], ["path"], {"rank": "one"}).select("conv_id", "rank"))

    spans = own.join(ranked, "conv_id").groupBy(*NODE).agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    spans = spans.unionByName(ranked.agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first IS NOT NULL").select(*root, "first", "last"))
    placed = nodes.join(spans, NODE).withColumns({"one": F.lit(1).cast("long"), "leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    placed = table(running(placed, [], ["first", "depth"], {"place": "one", "leaves_to": "leaf", "saved_to": "saved"}))
    # every rank starts at least one node, so the largest sums at the last rank are those at the subtree's end
    upto = placed.groupBy(F.col("first").alias("last")).agg(F.max("place").alias("last_place"), F.max("leaves_to").alias("leaves_end"), F.max("saved_to").alias("saved_end"))
    out = placed.join(upto, "last").join(hashed_ends(ends), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_end") - F.col("leaves_to") + F.col("leaf")).alias("n_leaves"), (F.col("saved_end") - F.col("saved_to") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "place", "last_place",
    )


def op11_prefix_tree(spark, sf_dir):
    turns, members = with_shared_start(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_tree(turns, members).drop("place", "last_place")


OP11_SQL = r"""
WITH numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nr,
         md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS mark,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT conv_id, count(*) AS own FROM numbered GROUP BY conv_id
), bits AS (
  SELECT conv_id, own, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))) AS b
  FROM sizes
), hashed AS (
  SELECT conv_id, own, conv_id - conv_id % 20 AS base,
         xor(list_reduce(b, lambda x, y: xor(xor(x, y) // 2, 3988292384::BIGINT * (xor(x, y) % 2))), 4294967295::BIGINT) % 4 AS h
  FROM bits
), known AS (
  SELECT k.conv_id, k.base, k.h, least(k.h, coalesce(s.own, 0)) AS taken FROM hashed k LEFT JOIN sizes s ON s.conv_id = k.base
), rebuilt AS (
  SELECT k.conv_id, n.nr - k.h + k.taken AS depth, n.mark, n.words FROM known k JOIN numbered n ON n.conv_id = k.conv_id WHERE n.nr > k.h
  UNION ALL
  SELECT k.conv_id, n.nr, n.mark, n.words FROM known k JOIN numbered n ON n.conv_id = k.base WHERE n.nr <= k.taken
), steps AS (
  SELECT conv_id, depth, words, string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
         depth = max(depth) OVER (PARTITION BY conv_id) AS is_end
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM known
), nodes AS (
  SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, min(words) AS words, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM steps GROUP BY path
), family AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND starts_with(c.path, n.path)) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)
)
SELECT v.conv_id, v.depth::BIGINT AS depth, v.parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
       count(*) FILTER (w.n_children = 0)::BIGINT AS n_leaves, sum((w.n_convs - 1) * w.words)::BIGINT AS saved_tokens, v.ends_sha256
FROM family v JOIN family w ON starts_with(w.path, v.path)
GROUP BY ALL
"""
