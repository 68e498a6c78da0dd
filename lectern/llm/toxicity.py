"""Toxicity by class-conditional Kneser-Ney models over characters.

Expressions of six characters are counted in toxic and in ordinary labelled
texts. Either class backs off through its own continuation counts of five and
four characters to one shared model of three, whose continuation counts come
from every document, so that an expression rare in both classes is smoothed
alike and leans to neither. A text is judged by its length-normalised
log-likelihoods: the difference over the whole text, over its worst stretches,
and the share of such stretches, weighed by a logistic curve.

Where the classes have no count of an expression, what is left of their
difference is that of the back-off weights; so four tables of the labelled
sample's own expressions, joined from DataFrames, score any text exactly. The
counts that are gathered from the corpus stay in Spark and grow with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import matrix, mix, signed, table, with_fields

ORDER = 6
DISCOUNT = 0.75
#: Labelled texts to learn from: so many of either class at most, those with the least hash, and of these as many as have so many characters of a class together (the first one whole).
MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 4_000, 8_000, 24_000_000
#: Characters of a stretch.
STRETCH = 10
#: Characters that a task counts at a time.
CHUNK = 1 << 20


def code_points(text: str | None) -> np.ndarray:
    """Lower-cased code points with two blanks around each word, so that a word's first four characters are an expression of their own."""
    return np.frombuffer(f"  {'  '.join((text or '').lower().split())}  ".encode("utf-32-le", "surrogatepass"), np.uint32)


def threes_of(a: np.ndarray) -> np.ndarray:
    """Every run of three code points as one number, 21 bits each."""
    a = a.astype(np.uint64)
    return (a[:-2] << np.uint64(42)) | (a[1:-1] << np.uint64(21)) | a[2:]


def keys_of(three: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys of the runs of ``n`` code points (3 to 6), from their first and their last three."""
    if n == 3:
        return mix(three)
    return mix(mix(three[: 3 - n]) * np.uint64(2 * n + 1) + three[n - 3 :])


def chunks(texts, size: int = CHUNK):
    """The code points of whole texts, about ``size`` at a time; texts without a run of four are left out."""
    held, n = [], 0
    for value in texts:
        a = code_points(value.as_py())
        if len(a) >= 4:
            held.append(a)
            n += len(a)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def count_shared(batches):
    """The distinct runs of four characters of a task, by key, with their last three; what the task has just given is not given again."""
    given = np.zeros(1 << 18, np.uint64)
    for batch in batches:
        for held in chunks(batch.column(0)):
            four, last = [], []
            for three in map(threes_of, held):
                k = keys_of(three, 4)
                at = k >> np.uint64(46)
                new = np.flatnonzero(given[at] != k)
                given[at[new]] = k[new]
                four.append(k[new])
                last.append(three[1:][new])
            four, first = np.unique(np.concatenate(four), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(four)), pa.array(signed(np.concatenate(last)[first]))], names=["four", "three"])


#: Keys of a six's parts: its contexts (without the last character) and what it backs off to (without the first).
PARTS = {"ctx5": (5, 0), "ctx4": (4, 1), "ctx3": (3, 2), "five": (5, 1), "four": (4, 2)}


def count_classes(batches):
    """Runs of six characters by key and class with their parts, and how often each is."""
    for batch in batches:
        for toxic in (0, 1):
            mine = batch.column(0).filter(pa.array([t == toxic for t in batch.column(1).to_pylist()], pa.bool_()))
            for held in chunks(mine):
                held = [threes_of(a) for a in held if len(a) >= ORDER]
                if not held:
                    continue
                six, first, n = np.unique(np.concatenate([keys_of(t, ORDER) for t in held]), return_index=True, return_counts=True)
                part = {}
                for name, (size, skip) in PARTS.items():
                    part[name] = np.concatenate([keys_of(t, size)[skip : skip + len(t) - 3] for t in held])[first]
                three = np.concatenate([t[3:] for t in held])[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(six)), *[pa.array(signed(v)) for v in part.values()], pa.array(signed(three)), pa.array(np.full(len(six), toxic, np.int32)), pa.array(n.astype(np.int64))],
                    names=["six", *PARTS, "three", "toxic", "n"],
                )


def shared_model(docs: DataFrame, text_col: str) -> DataFrame:
    """``three, p_low``: the shared probability of a character after two others, from the continuation counts of all documents."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count_shared, "four long, three long")
    fours = found.groupBy("four").agg(F.min("three").alias("three"))
    threes = table(fours.groupBy("three").agg(F.count("*").alias("cont")).withColumn("two", F.shiftright("three", 21)))
    # one row: how many characters there are
    kinds = threes.agg(F.count_distinct(F.col("three").bitwiseAND((1 << 21) - 1)).alias("chars"))
    twos = threes.groupBy("two").agg(F.sum("cont").alias("total"), F.count("*").alias("types"))
    return threes.join(twos, "two").crossJoin(F.broadcast(kinds)).select("three", ((F.col("cont") - DISCOUNT + DISCOUNT * F.col("types") / F.col("chars")) / F.col("total")).alias("p_low"))


def weights(rows: DataFrame, context: str, count: str) -> DataFrame:
    """By context: each class's total and the weight that its discounts leave to the lower order; without counts that is all."""
    sums = []
    for c in "01":
        n = F.col(f"{count}{c}")
        sums += [F.sum(n).alias(f"total{c}"), F.count(F.when(n > 0, 1)).alias(f"types{c}")]
    out = rows.groupBy(context).agg(*sums)
    left = [F.when(F.col(f"total{c}") > 0, DISCOUNT * F.col(f"types{c}") / F.col(f"total{c}")).otherwise(1.0).alias(f"left{c}") for c in "01"]
    return out.select(context, "total0", "total1", *left)


def level(rows: DataFrame, lower: DataFrame, key: str, context: str, below: str, count: str) -> tuple[DataFrame, DataFrame]:
    """``key, p0, p1`` of one order from ``below, p0, p1`` of the next, and the contexts' weights."""
    given = weights(rows, context, count)
    p = []
    for c in "01":
        seen = F.greatest(F.col(f"{count}{c}") - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"total{c}"), F.lit(1))
        p.append((seen + F.col(f"left{c}") * F.col(f"p{c}")).alias(f"p{c}"))
    return rows.join(given, context).join(lower, below).select(key, *p), given.select(F.col(context).alias("key"), F.log(F.col("left1") / F.col("left0")).alias("left"))


def differences(sample: DataFrame, docs: DataFrame, text_col: str = "text") -> dict[int, DataFrame]:
    """By order 6 to 3: ``key, seen, left``. ``seen`` is log P(c | toxic) - log P(c | ordinary) of an expression that either class
    has, null otherwise; ``left`` that of the back-off weights where the expression is a context, zero if in neither class.

    ``sample`` has ``text, toxic``. No table has more rows than the sample has characters.
    """
    counted = sample.select("text", "toxic").mapInArrow(count_classes, "six long, " + "".join(f"{p} long, " for p in PARTS) + "three long, toxic int, n long")
    by_class = [F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    sixes = table(counted.groupBy("six").agg(*[F.min(p).alias(p) for p in (*PARTS, "three")], *by_class))
    types = lambda n, to: [F.count(F.when(F.col(f"{n}{c}") > 0, 1)).alias(f"{to}{c}") for c in "01"]
    fives = table(sixes.groupBy("five").agg(*[F.min(p).alias(p) for p in ("ctx4", "four", "ctx3", "three")], *types("n", "m")))
    fours = table(fives.groupBy("four").agg(*[F.min(p).alias(p) for p in ("ctx3", "three")], *types("m", "k")))
    low = shared_model(docs, text_col).select("three", F.col("p_low").alias("p0"), F.col("p_low").alias("p1"))
    four, left3 = level(fours, low, "four", "ctx3", "three", "k")
    four = table(four)
    five, left4 = level(fives, four, "five", "ctx4", "four", "m")
    five = table(five)
    six, left5 = level(sixes, five, "six", "ctx5", "five", "n")
    out = {3: left3.select("key", F.lit(None).cast("double").alias("seen"), "left")}
    none = F.lit(0.0).alias("left")
    for order, rows, left in ((6, six, None), (5, five, left5), (4, four, left4)):
        seen = rows.select(F.col(rows.columns[0]).alias("key"), F.log(F.col("p1") / F.col("p0")).alias("seen"))
        # an expression can be one that ends a longer one, a context, or both
        out[order] = seen.select("*", none) if left is None else seen.join(left, "key", "full").select("key", "seen", F.coalesce("left", F.lit(0.0)).alias("left"))
    return out


class Lookup:
    """Values by 64-bit key: keys in order, and where those of each leading bits begin."""

    def __init__(self, keys: np.ndarray, seen: np.ndarray, left: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.seen, self.left = keys[order], seen[order].astype(np.float32), left[order].astype(np.float32)
        self.start = None

    @classmethod
    def of(cls, rows: DataFrame) -> Lookup:
        t = rows.select("key", F.col("seen").cast("float").alias("seen"), F.col("left").cast("float").alias("left")).toArrow()
        return cls(t["key"].to_numpy().view(np.uint64), t["seen"].to_numpy(), t["left"].to_numpy())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each key is, -1 for one that isn't there."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        if self.start is None:
            self.bits = np.uint64(64 - max(1, len(self.keys).bit_length()))
            edges = np.arange((1 << int(64 - self.bits)) + 1, dtype=np.uint64)
            self.start = np.searchsorted(self.keys >> self.bits, edges).astype(np.int32)
        at = self.start[h >> self.bits].astype(np.int64)
        last = len(self.keys) - 1
        todo = np.flatnonzero(self.keys[np.minimum(at, last)] < h)
        while len(todo):
            at[todo] += 1
            todo = todo[at[todo] <= last]
            todo = todo[self.keys[at[todo]] < h[todo]]
        at[self.keys[np.minimum(at, last)] != h] = -1
        at[at > last] = -1
        return at


def log_ratios(three: np.ndarray, tables: dict[int, Lookup]) -> np.ndarray:
    """The difference of the classes' log-probabilities at each run of six."""
    out = np.zeros(max(0, len(three) - 3), np.float32)
    todo = np.arange(len(out))
    for order in (6, 5, 4):
        # the expression of this order that ends at the same character
        held, context = tables[order], tables[order - 1]
        at = held.find(at_keys(three, order, todo + 6 - order))
        seen = np.where(at >= 0, held.seen[at], np.nan) if len(held.keys) else np.full(len(todo), np.nan, np.float32)
        hit = ~np.isnan(seen)
        out[todo[hit]] += seen[hit]
        todo = todo[~hit]
        if not len(todo):
            break
        at = context.find(at_keys(three, order - 1, todo + 6 - order))
        out[todo] += np.where(at >= 0, context.left[at], 0) if len(context.keys) else 0
    return out


def at_keys(three: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """:func:`keys_of` for the runs that begin at ``at``."""
    if n == 3:
        return mix(three[at])
    return mix(mix(three[at]) * np.uint64(2 * n + 1) + three[at + n - 3])


N_FEATURES = 6


def features(text: str | None, tables: dict[int, Lookup]) -> np.ndarray:
    """Length-normalised log-likelihood differences of a text; zeros for one too short to have any."""
    out = np.zeros(N_FEATURES)
    a = code_points(text)
    if len(a) < ORDER:
        return out
    d = log_ratios(threes_of(a), tables)
    run = np.zeros(len(d) + 1)
    np.cumsum(d, dtype=np.float64, out=run[1:])
    width = min(STRETCH, len(d))
    local = (run[width:] - run[:-width]) / width
    out[0] = d.mean()
    out[1] = local.max()
    # the worst stretch of each block: how many blocks are bad, and how bad the worst few are
    blocks = np.maximum.reduceat(local, np.arange(0, len(local), STRETCH))
    top = np.sort(blocks)[::-1]
    out[2] = top[: min(3, len(top))].mean()
    out[3] = top[: min(8, len(top))].mean()
    out[4] = (blocks > 0.6).mean()
    out[5] = np.sqrt((blocks > 1.0).mean())
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) by Newton's method with a ridge."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = np.append(np.full(z.shape[1] - 1, ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep) + 1e-9 * np.eye(len(w)), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def featured(docs: DataFrame, tables, text_col: str, schema) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [features(v.as_py(), tables.value).tolist() for v in batch.column(0).field(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names, "found"])

    return docs.mapInArrow(run, schema)


def fold(ident: Column) -> Column:
    """crc32 of the id's text modulo 5; 0 is held out. A null id counts as the text 'null'."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("null")).cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: dict[int, int], max_chars: int) -> DataFrame:
    """``id, text, toxic``: of either class the ``most`` rows of least hash, as far as their characters go."""
    usable = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("toxic")).where((fold(F.col("label_id")) != 0) & F.col("toxic").isin(0, 1)).groupBy("label_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = table(usable)
    chosen = [usable.where(F.col("toxic") == toxic).orderBy(F.xxhash64("label_id"), "label_id").limit(n) for toxic, n in most.items()]
    chosen = table(chosen[0].unionByName(chosen[1]))
    # at most max_toxic + max_ordinary rows of two numbers; a repeated id has one text
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    texts = table(texts.groupBy("id", "toxic").agg(F.max("text").alias("text")))
    # a window over as many rows, of numbers only
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    within = texts.select("id", "toxic", F.coalesce(F.length("text"), F.lit(0)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < max_chars)
    return table(texts.join(F.broadcast(within.select("id")), "id"))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_chars: int = MAX_CHARS
) -> DataFrame:
    """``src, held_out, score`` per row of ``docs``; ``src`` holds its columns.

    Learns from labelled rows outside the held-out fold, a bounded number of
    either class and of characters. Counts come from folds 1 to 3, the logistic
    curve from fold 4, or from the counted texts themselves where fold 4 has one
    class only. Labels other than 0 and 1, and labels of no document, teach
    nothing; where either class is empty every score is 0. Null and empty texts
    are scored like others, very long ones whole. Rows that repeat an id are
    scored each by its own text; as a teacher the id has the greatest of its
    texts. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("src"), F.col(id_col).alias("id"))
    held_out = (fold(F.col("id")) == 0).alias("held_out")
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, {1: max_toxic, 0: max_ordinary}, max_chars)
    learning, calibration = (sample.where(fold(F.col("id")) != 4), sample.where(fold(F.col("id")) == 4))
    both = lambda df: df.select("toxic").distinct().count() == 2
    if not both(learning):
        return rows.select("src", held_out, F.lit(0.0).alias("score"))
    if not both(calibration):
        calibration = learning
    # of the size of the labelled sample, whatever the corpus
    tables = spark.sparkContext.broadcast({order: Lookup.of(d) for order, d in differences(learning, docs, text_col).items()})

    calibration = calibration.select(F.struct("text").alias("src"), F.col("toxic"))
    seen = featured(calibration, tables, "text", "src struct<text: string>, toxic int, found array<double>").select("toxic", "found").toArrow()
    x, y = matrix(seen["found"].combine_chunks(), N_FEATURES), seen["toxic"].to_numpy().astype(float)
    out = featured(rows.select("src", held_out), tables, text_col, with_fields(rows, "src", "held_out boolean, found array<double>"))
    mean, scale, w = fit_logistic(x, y)
    logit = F.lit(float(w[-1] - (w[:-1] * mean / scale).sum()))
    for k in range(N_FEATURES):
        logit = logit + F.get("found", F.lit(k)) * float(w[k] / scale[k])
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    return out.select("src", "held_out", score.alias("score"))


def op2_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select(F.col("src.doc_id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
