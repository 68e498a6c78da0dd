"""Approximate nearest neighbours by largest inner product: balanced posting lists.

Balanced clustering of a bounded sample gives the lists; every vector goes to
its nearest list and, near a boundary, to others too; a query walks a graph of
the centroids in memory and takes the lists within a ratio of the nearest
distance. Lists that follow each other in the clustering's tree share a shelf. A
query comes to a shelf once, with the numbers of the lists there that it probes,
and streams past the shelf's vectors: a task holds one shelf, of bounded size, and
queries are not repeated for each list, of which one without clusters to go by
probes half.

The centroids in memory have a bound. Beyond it each list is cut into sublists by
centroids of its own, which stay in Spark tables and grow in number with the
vectors: sublists keep their size. A query meets the nearest sublists of its
nearest lists first; what they give bounds the rest, and a sublist whose centroid
and radius can't reach that bound is left out, exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import matrix, table

#: Vectors meant for a list, lists at most, rows of the sample that lists are fit on for each list, and such rows at least.
PER_LIST, MAX_LISTS, SAMPLE_PER_LIST, LEAST_SAMPLE = 256, 4_096, 24, 20_000
#: Lists that a vector goes to at most, and how much farther than the nearest they may be.
COPIES, COPY_RATIO = 2, 1.10
#: Edges of a centroid to its nearest, and to any; nodes a walk starts from, and steps that it takes at least.
NEIGHBOURS, LONG, STARTS, BEAM = 20, 6, 64, 32
#: Vectors, and queries, that are compared at a time; queries whose lists are looked up at a time, and by one task.
BLOCK, LOOKED_UP, ASKED_A_TASK = 1_024, 256, 512
#: Shelves from which on lists share one, and lists (or sublists) of a shelf at most; bytes of vectors, as doubles, of a shelf's part.
SHELVES, SHELF, PART_BYTES = 256, 16, 32 << 20
#: Numbers of a matrix of distances or products, and rows that a task hands on at a time.
CELLS, HANDED = 1 << 20, 1 << 15
#: Rows of the sample that a list's sublists are fit on, for each sublist; and sublists of a list at most, which bounds the row that holds their centroids.
SAMPLE_PER_SUBLIST, MAX_SUBLISTS = 24, 1 << 14
#: Rows of a query's nearest lists that are compared first.
FIRST = 2_048
#: Recall on the sample that the probing ratio is set for.
AIM = 0.95


@dataclass
class Lists:
    centroids: np.ndarray
    graph: np.ndarray
    longest: float
    ratio: float = 0.1
    sizes: np.ndarray | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        """One more component gives all vectors the longest one's length; the nearest are then those of largest inner product."""
        rest = np.maximum(self.longest**2 - (x * x).sum(1), 0)
        return np.column_stack([x, np.sqrt(rest)])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every copy: near a boundary, lists hardly farther than the nearest are taken too."""
        c = self.centroids
        rows, lists = [], []
        width = min(COPIES, len(c))
        step = max(1, CELLS // len(c))
        for i in range(0, len(x), step):
            y = self.lift(x[i : i + step])
            d = np.maximum((y**2).sum(1)[:, None] - 2 * y @ c.T + (c**2).sum(1), 0)
            near = np.argpartition(d, width - 1, axis=1)[:, :width] if width < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
            near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)
            dist = np.take_along_axis(d, near, 1)
            r, k = np.nonzero(dist <= COPY_RATIO**2 * dist[:, :1])
            rows.append(i + r)
            lists.append(near[r, k])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(lists)

    def probe(self, q: np.ndarray, least_rows: int) -> np.ndarray:
        """Lists for a query, nearest first: a best-first walk over the graph, at least BEAM nodes long, gives those within the ratio of the nearest, and more until enough rows are at hand.

        All nodes within the ratio that a step has reached are left in the next one together.
        """
        y = np.append(q, 0.0)
        c = self.centroids
        away, seen = np.full(len(c), np.inf), np.zeros(len(c), bool)

        def reach(nodes):
            nodes = np.unique(nodes[~seen[nodes]])
            seen[nodes] = True
            away[nodes] = ((c[nodes] - y) ** 2).sum(1) ** 0.5
            return nodes

        def rows(nodes):
            return least_rows * len(nodes) if self.sizes is None else int(self.sizes[nodes].sum())

        edge = reach(np.arange(0, len(c), max(1, len(c) // STARTS)))
        walked, held = np.zeros(0, np.int64), 0
        while len(edge):
            limit = (1 + self.ratio) * away.min() + 1e-12
            near = away[edge] <= limit
            if not near.any():
                if len(walked) >= BEAM and held >= least_rows:
                    break
                near = np.arange(len(edge)) == away[edge].argmin()
            go = edge[near]
            walked, held = np.append(walked, go), held + rows(go)
            edge = np.append(edge[~near], reach(self.graph[go].ravel()))
            if not len(edge) and held < least_rows:
                edge = reach(np.flatnonzero(~seen))
        walked = walked[np.lexsort((walked, away[walked]))]
        within = away[walked] <= limit
        if self.sizes is not None:
            within |= np.cumsum(self.sizes[walked]) - self.sizes[walked] < least_rows
        return walked[within]


def balanced(y: np.ndarray, leaf: int, random: np.random.Generator) -> list[np.ndarray]:
    """Centroids of a recursive k-means whose leaves have about ``leaf`` rows; equal rows stay in one leaf."""
    out, todo = [], [np.arange(len(y))]
    while todo:
        rows = todo.pop()
        k = min(8, -(-len(rows) // leaf))
        if k < 2:
            out.append(y[rows].mean(0))
            continue
        x = y[rows]
        c = x[random.choice(len(x), k, replace=False)]
        load = np.zeros(k)
        for _ in range(8):
            d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
            mine = (d + load * d.mean() / len(x)).argmin(1)
            n = np.bincount(mine, minlength=k)
            load = 0.5 * load + 0.5 * np.maximum(n - len(x) / k, 0)
            for j in np.flatnonzero(n):
                c[j] = x[mine == j].mean(0)
        parts = [rows[mine == j] for j in range(k) if (mine == j).any()]
        if len(parts) == 1:
            out.append(x.mean(0))
        else:
            todo += parts
    return out


def top_rows(score: np.ndarray, k: int) -> np.ndarray:
    """Of each row of ``score``, which entries can be among its k largest once scores are exact."""
    if score.shape[1] <= k:
        return np.ones(score.shape, bool)
    edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    return score >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None]


def top_ids(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """As :func:`top_rows`, for the k ids of largest score: an id can have several rows."""
    found, of = np.unique(ids, return_inverse=True)
    if len(found) == len(ids):
        return top_rows(score, k)
    order = np.argsort(of, kind="stable")
    best = np.maximum.reduceat(score[:, order], np.searchsorted(of[order], np.arange(len(found))), axis=1)
    return top_rows(best, k)[:, of]


def fit(x: np.ndarray, longest: float, n_lists: int, k: int, seed: int = 3) -> Lists:
    """Lists from the sample ``x``; the probing ratio is the least that has recall AIM on the sample."""
    random = np.random.default_rng(seed)
    model = Lists(np.zeros((1, x.shape[1] + 1)), np.zeros((1, 1), np.int64), longest)
    c = np.array(balanced(model.lift(x), max(1, len(x) // n_lists), random)) if len(x) else model.centroids
    # row by row: no square of the lists is held
    graph = np.array([((c - one) ** 2).sum(1).argsort(kind="stable")[1 : NEIGHBOURS + 1] for one in c]) if len(c) > 1 else np.zeros((1, 1), np.int64)
    graph = np.column_stack([graph, random.integers(0, len(c), (len(c), LONG))])
    model = Lists(c, graph, longest)
    if len(c) > 1:
        tried = random.choice(len(x), min(200, len(x)), replace=False)
        rows, lists = model.assign(x)
        lists = lists[np.argsort(rows, kind="stable")]
        edges = np.searchsorted(np.sort(rows), np.arange(len(x) + 1))
        needed = []
        for t in tried:
            score = x @ x[t]
            score[t] = -np.inf
            far = ((c - np.append(x[t], 0.0)) ** 2).sum(1) ** 0.5
            # how much farther than the nearest list is the nearest that holds it
            needed += [far[lists[edges[j] : edges[j + 1]]].min() / max(far.min(), 1e-12) - 1 for j in np.argpartition(-score, min(k, len(x) - 1))[:k]]
        model.ratio = float(np.quantile(needed, AIM, method="higher"))
    return model


def meet(kept: DataFrame, passing: DataFrame, work, schema: str, most: int = 0) -> DataFrame:
    """``work`` gets the rows of one ``shelf`` after the other, the kept ones first, for :func:`shelves`; what it yields has ``schema``.

    A shelf of more than ``most`` kept rows is cut into parts, if ``most`` is given, and the passing rows come to each.
    """
    part = first = F.lit(0)
    if most:
        # a row for each ``most`` vectors at most, and only for shelves that outgrew the others
        crowded = F.broadcast(kept.groupBy("shelf").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1"))
        kept, passing = (df.join(crowded, "shelf", "left") for df in (kept, passing))
        parts = F.coalesce("parts", F.lit(1))
        part, first = F.pmod(F.xxhash64("id", "v"), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
    both = kept.withColumn("part", part).withColumn("passes", F.lit(False)).unionByName(passing.withColumn("part", first).withColumn("passes", F.lit(True)), allowMissingColumns=True)
    return both.repartition("shelf", "part").sortWithinPartitions("shelf", "part", "passes").mapInArrow(work, schema)


def shelves(batches):
    """The kept rows of a shelf, or of a part, with each batch of the rows that pass them; the same object for all of them."""
    at, kept, whole = None, [], None
    for b in batches:
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in ("shelf", "part", "passes")]
        edges = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), b.num_rows]
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            here = int(keys[0][i]), int(keys[1][i])
            if here != at:
                at, kept, whole = here, [], None
            if not keys[2][i]:
                kept.append(b.slice(i, j - i))
            elif kept:
                whole = pa.Table.from_batches(kept).combine_chunks() if whole is None else whole
                yield whole, b.slice(i, j - i)


def probing(asking: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Which row probes which list: the array in ``lists`` of every row, laid flat."""
    lists = asking.column("lists")
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()


def by_list(asking: pa.RecordBatch):
    """(list, the rows that probe it)"""
    rows, lists = probing(asking)
    order = np.argsort(lists, kind="stable")
    names, starts = np.unique(lists[order], return_index=True)
    return zip(names.tolist(), np.split(rows[order], starts[1:]))


def lists_of(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def to_shelves(asking: pa.RecordBatch, rows: np.ndarray, lists: np.ndarray, a_shelf: int) -> pa.RecordBatch:
    """A row for each row of ``asking`` and each shelf of ``a_shelf`` lists: the lists that it probes there. ``lists`` ascend within a row."""
    shelf = lists // a_shelf
    starts = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (shelf[1:] != shelf[:-1]))[: len(rows)])
    at = pa.array(rows[starts])
    probed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(lists)), pa.int32()), pa.array(lists.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(shelf[starts].astype(np.int32)), *[asking.column(c).take(at) for c in ("id", "v", "floor")], probed], names=["shelf", "id", "v", "floor", "lists"])


class Sublists:
    """Lists cut by centroids of their own. ``postings`` (list, id, v) numbers the parts list * MAX_SUBLISTS + part."""

    def __init__(self, postings: DataFrame, longest: float, dim: int, kind: str, n_subs: int, a_shelf: int):
        lift = Lists(np.zeros((1, dim + 1)), np.zeros((1, 1), np.int64), longest).lift
        self.dim, self.kind, self.a_shelf = dim, kind, a_shelf

        def cut(rows: pa.Table) -> pa.Table:
            c = np.array(balanced(lift(matrix(rows["v"].combine_chunks(), dim)), SAMPLE_PER_SUBLIST, np.random.default_rng(7)))[:MAX_SUBLISTS]
            return pa.table({"list": rows["list"][:1], "centroids": pa.array([c.ravel()], pa.list_(pa.float64()))})

        def place(batches):
            for of, held in shelves(batches):
                c = of["centroids"].combine_chunks().flatten().to_numpy().reshape(-1, dim + 1)
                step = max(1, CELLS // len(c))
                for i in range(0, held.num_rows, step):
                    h = held.slice(i, step)
                    y = lift(matrix(h.column("v"), dim))
                    sub = ((c**2).sum(1) - 2 * y @ c.T).argmin(1)
                    # how far a vector is from its centroid, a little rounded up: the radius has to hold
                    away = np.sqrt(((y - c[sub]) ** 2).sum(1)) * (1 + 1e-9) + 1e-9
                    yield pa.RecordBatch.from_arrays([h.column("shelf"), pa.array(sub.astype(np.int32)), h.column("id"), h.column("v"), pa.array(away)], names=["list", "sub", "id", "v", "away"])

        nth = F.row_number().over(Window.partitionBy("list").orderBy(F.xxhash64("id"), "id"))
        sample = postings.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_PER_SUBLIST * n_subs).select("list", "v")
        centroids = table(sample.groupBy("list").applyInArrow(cut, "list int, centroids array<double>"))
        shelf = F.col("list").alias("shelf")
        placed = table(meet(centroids.select(shelf, "centroids"), postings.select(shelf, "id", "v"), place, f"list int, sub int, id long, v array<{kind}>, away double"))
        sizes = placed.groupBy("list", "sub").agg(F.max("away").alias("radius"), F.count("*").alias("n")).groupBy("list").agg(F.array_sort(F.collect_list(F.struct("sub", "radius", "n"))).alias("subs"))
        # a row a list, with MAX_SUBLISTS centroids at most
        self.bounds = table(centroids.join(sizes, "list"))
        self.postings = placed.select((F.col("list") * MAX_SUBLISTS + F.col("sub")).alias("list"), "id", "v")

    def probed(self, probes: DataFrame, nearest_ones: bool) -> DataFrame:
        """``list, id, v, floor``: of the probed lists (shelf, id, v, floor, lists; first) the nearest sublists, FIRST rows of a ``first`` list; or else the others that can reach the floor."""
        dim = self.dim

        def pick(batches):
            for bounds, asking in shelves(batches):
                places = {one: i for i, one in enumerate(bounds["list"].to_pylist())}
                for one, probing_it in by_list(asking):
                    if one not in places:
                        continue
                    flat, held = (bounds[c][places[one]].values for c in ("centroids", "subs"))
                    sub, radius, n = (held.field(f).to_numpy() for f in ("sub", "radius", "n"))
                    c = flat.to_numpy().reshape(-1, dim + 1)[sub]
                    step = min(LOOKED_UP, max(1, CELLS // len(sub)))
                    for i in range(0, len(probing_it), step):
                        a = asking.take(pa.array(probing_it[i : i + step]))
                        q = matrix(a.column("v"), dim)
                        product = q @ c[:, :dim].T
                        order = ((c**2).sum(1) - 2 * product).argsort(axis=1, kind="stable")
                        before = np.cumsum(n[order], axis=1) - n[order]
                        near = np.zeros(product.shape, bool)
                        np.put_along_axis(near, order, before < FIRST, axis=1)
                        near &= a.column("first").to_numpy(zero_copy_only=False)[:, None].astype(bool)
                        most = product + np.sqrt((q * q).sum(1))[:, None] * radius
                        rows, subs_of = np.nonzero(near if nearest_ones else ~near & (most >= a.column("floor").to_numpy()[:, None]))
                        for m in range(0, len(rows), HANDED):
                            at = pa.array(rows[m : m + HANDED])
                            numbers = pa.array(one * MAX_SUBLISTS + sub[subs_of[m : m + HANDED]], pa.int32())
                            yield pa.RecordBatch.from_arrays([numbers, *[a.column(f).take(at) for f in ("id", "v", "floor")]], names=["list", "id", "v", "floor"])

        bounds = self.bounds.withColumn("shelf", F.floor(F.col("list") / self.a_shelf).cast("int"))
        return meet(bounds, probes, pick, f"list int, id long, v array<{self.kind}>, floor double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", per_list: int = PER_LIST) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its ``k`` nearest rows of ``vectors`` found, itself excepted.

    Scores are inner products of the vectors as they are, in double precision;
    ties go to the smaller id. Vectors that are null, zero, of another length
    than most, or hold null or non-finite components, and rows with a null id,
    take no part. Of equal vectors the k + 1 smallest ids are candidates: no
    others can be among anyone's nearest. A row given twice counts once; an id
    with several vectors has the score of its best, as vector and as query. With
    few candidates all are returned; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == queries.schema[vector_col].dataType.simpleString() == "array<float>" else "double"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast(f"array<{kind}>")
        bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
        return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad & F.exists(v, lambda e: e != 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    good = usable(vectors)
    dims = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["dim"]
    of_equal = Window.partitionBy("v").orderBy("id")
    index = table(good.where(F.size("v") == dim).dropDuplicates(["id", "v"]).withColumn("nth", F.row_number().over(of_equal)).where(F.col("nth") <= k + 1).drop("nth"))
    asked = table(usable(queries).where(F.size("v") == dim).dropDuplicates(["id", "v"]))
    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    n_total, longest = index.agg(F.count("*"), F.max(F.sqrt(square))).first()
    n_lists = int(np.clip(n_total // per_list, 1, MAX_LISTS))
    picked = index.orderBy(F.xxhash64("id"), "id").limit(max(LEAST_SAMPLE, SAMPLE_PER_LIST * n_lists)).select("v").toArrow()  # SAMPLE_PER_LIST * MAX_LISTS rows at most
    model = fit(matrix(picked["v"].combine_chunks(), dim), float(longest or 0), n_lists, k)
    shared = spark.sparkContext.broadcast(model)

    def post(batches):
        for b in batches:
            rows, lists = shared.value.assign(matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *[c.take(pa.array(rows)) for c in b.columns]], names=["list", "id", "v"])

    postings = table(index.mapInArrow(post, f"list int, id long, v array<{kind}>"))
    sizes = postings.groupBy("list").count().toArrow()  # some MAX_LISTS rows at most
    model.sizes = np.bincount(sizes["list"].to_numpy(), sizes["count"].to_numpy(), len(model.centroids)).astype(np.int64)
    sized = spark.sparkContext.broadcast(model)
    enough = COPIES * (k + 1)

    def ask(batches):
        for b in batches:
            for i in range(0, b.num_rows, LOOKED_UP):
                a = b.slice(i, LOOKED_UP)
                lists = [sized.value.probe(x, enough) for x in matrix(a.column(1), dim)]
                # the nearest lists, as far as FIRST rows go and one at least
                first = [int((np.cumsum(sized.value.sizes[p]) - sized.value.sizes[p] < FIRST).sum()) for p in lists]
                near, far = (lists_of([np.sort(p[cut]) for p, cut in zip(lists, cuts)]) for cuts in ([slice(n) for n in first], [slice(n, None) for n in first]))
                yield pa.RecordBatch.from_arrays([*a.columns, near, far], names=["id", "v", "near", "far"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-asked.count() // ASKED_A_TASK))
    probes = table(asked.repartition(tasks).mapInArrow(ask, f"id long, v array<{kind}>, near array<int>, far array<int>"))
    a_shelf = int(np.clip(len(model.centroids) // SHELVES, 1, SHELF))

    def deal(batches):
        for b in batches:
            for i in range(0, b.num_rows, step := max(1, HANDED // len(sized.value.centroids))):
                a = b.slice(i, step)
                yield to_shelves(a, *probing(a), a_shelf)

    def dealt(rows: DataFrame, lists: str) -> DataFrame:
        return rows.select("id", "v", "floor", F.col(lists).alias("lists")).mapInArrow(deal, f"shelf int, id long, v array<{kind}>, floor double, lists array<int>")

    n_subs = min(MAX_SUBLISTS, n_total // (per_list * n_lists))
    if n_subs > 1:
        subs = Sublists(postings, model.longest, dim, kind, n_subs, a_shelf)
        postings = subs.postings
    of_shelf = F.floor(F.col("list") / (SHELF if n_subs > 1 else a_shelf)).cast("int").alias("shelf")
    held = postings.select(of_shelf, "list", "id", "v")

    def compare(batches):
        last, out, n_out = None, [], 0
        for shelf, asking in shelves(batches):
            if shelf is not last:
                last, on, ids = shelf, shelf["list"].to_numpy(), shelf["id"].to_numpy()
                order = np.argsort(on, kind="stable")
                on, ids, x = on[order], ids[order], matrix(shelf["v"].combine_chunks(), dim)[order]
            for i in range(0, asking.num_rows, BLOCK):
                a = asking.slice(i, BLOCK)
                qids, floor, q = a.column("id").to_numpy(), a.column("floor").to_numpy(), matrix(a.column("v"), dim)
                for one, rows in by_list(a):
                    start, end = np.searchsorted(on, [one, one + 1])
                    for j in range(start, end, BLOCK):
                        some = slice(j, min(j + BLOCK, end))
                        score = q[rows] @ x[some].T
                        may = score >= floor[rows][:, None]
                        if may.sum() > (k + 1) * len(rows):
                            may &= top_ids(score, ids[some], k + 1)
                        qi, xi = np.nonzero(may & (qids[rows][:, None] != ids[some][None]))
                        qi, xi = rows[qi], j + xi
                        for m in range(0, len(qi), step := max(1, CELLS // dim)):
                            of, to = qi[m : m + step], xi[m : m + step]
                            out.append((qids[of], ids[to], (q[of] * x[to]).sum(1)))
                            n_out += len(of)
                            if n_out >= HANDED:
                                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])
                                out, n_out = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def search(asking: DataFrame) -> DataFrame:
        if n_subs > 1:
            asking = asking.select(of_shelf, "id", "v", "floor", F.array("list").alias("lists"))
        found = meet(held, asking, compare, "query_id long, vec_id long, score double", max(BLOCK, PART_BYTES // (8 * dim)))
        # a vector is found in several lists
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    # what the nearest lists give is a bound for the rest
    none = F.lit(float("-inf")).alias("floor")
    first = dealt(probes.withColumn("floor", none), "near")
    near = table(top(search(subs.probed(first.withColumn("first", F.lit(True)), True) if n_subs > 1 else first)))
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), (F.col("score") - 1e-9 * (1 + F.abs("score"))).alias("floor"))
    bounded = probes.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", none))
    rest = dealt(bounded, "far")
    if n_subs > 1:
        rest = subs.probed(rest.withColumn("first", F.lit(False)).unionByName(dealt(bounded, "near").withColumn("first", F.lit(True))), False)
    found = near.drop("rank").unionByName(search(rest)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return top(found).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op4_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
