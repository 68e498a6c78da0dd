"""Quality by a sparse rule ensemble.

Statistics of a text are Spark columns. Shallow trees are grown on the labelled
sample; every node's path is a rule, a conjunction of threshold tests; a
logistic regression with a lasso penalty keeps few of them; and those become one
Spark column expression, so scoring runs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import LOWER, UPPER, table
from lectern.llm.toxicity import fold

#: Labelled texts to learn from at most, those with the least hash.
MAX_LABELLED = 20_000
N_TREES, DEPTH, MIN_LEAF = 40, 3, 12
LASSO, STEPS = 0.002, 400


#: Characters that are counted, by statistic; the first stands for its class.
CLASSES = {"upper": UPPER, "lower": LOWER, "symbols": "%&*$#@=<>{}[]~^_\\", "bars": "|", "shouts": "!?", "stops": ".", "commas": ",;:", "digits": "0123456789", "lines": "\n"}


def measured(docs: DataFrame, text: Column) -> tuple[DataFrame, list[str]]:
    """``docs`` with one double column a statistic, each named ``q_...``, and the names.

    Shares of characters, the number, length and variety of words, and of words
    that the next repeats. One pass maps every counted character to its class's
    first, which is then counted in bytes.
    """
    text = F.coalesce(text, F.lit(""))
    mapped = F.translate(text, "".join(CLASSES.values()), "".join(c[0] * len(c) for c in CLASSES.values()))
    words = F.split(F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " ")
    out = docs.select("*", F.length(text).cast("double").alias("q_chars"), mapped.alias("_mapped"), words.alias("_words"))
    size, w, n = F.greatest(F.col("q_chars"), F.lit(1.0)), F.col("_words"), F.size("_words")
    count = lambda c: F.octet_length("_mapped") - F.octet_length(F.replace("_mapped", F.lit(c)))
    out = out.select(
        *[c for c in out.columns if c not in ("_mapped", "_words")],
        *[(count(c[0]) / size).alias(f"q_{k}") for k, c in CLASSES.items()],
        n.cast("double").alias("q_words"),
        (F.col("q_chars") / n).alias("q_word_length"),
        (F.size(F.array_distinct(w)) / n).alias("q_distinct"),
        (F.size(F.filter(F.zip_with(w, F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)) / n).alias("q_same_as_next"),
    )
    return out, [c for c in out.columns if c.startswith("q_")]


@dataclass
class Rule:
    """A conjunction of (feature, is_above, threshold)."""

    tests: tuple
    weight: float = 0.0

    def on(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, t in self.tests:
            out &= (x[:, k] > t) if above else (x[:, k] <= t)
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for k, above, t in self.tests:
            out = out & ((F.col(names[k]) > t) if above else (F.col(names[k]) <= t))
        return out


@dataclass
class Ensemble:
    names: list[str]
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        """The score: a logistic curve over the weights of the rules that hold."""
        z = F.lit(float(self.intercept))
        for r in self.rules:
            z = z + F.when(r.column(self.names), F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def grow(x: np.ndarray, r: np.ndarray, rows: np.ndarray, cols: np.ndarray, tests: tuple, depth: int, out: list[tuple], leaf: np.ndarray) -> None:
    """Least-squares splits of the residuals ``r``; the path to every node but the root goes to ``out``."""
    if tests:
        out.append(tests)
    best = (1e-9, None)
    if depth and len(rows) >= 2 * MIN_LEAF:
        total, n = r[rows].sum(), len(rows)
        for k in cols:
            order = rows[np.argsort(x[rows, k], kind="stable")]
            v, s = x[order, k], np.cumsum(r[order])
            i = np.flatnonzero(v[1:] > v[:-1]) + 1
            i = i[(i >= MIN_LEAF) & (i <= n - MIN_LEAF)]
            if len(i):
                gain = s[i - 1] ** 2 / i + (total - s[i - 1]) ** 2 / (n - i) - total**2 / n
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], (k, (v[i[j] - 1] + v[i[j]]) / 2))
    if best[1] is None:
        leaf[rows] = r[rows].mean() if len(rows) else 0.0
        return
    k, t = best[1]
    above = x[rows, k] > t
    grow(x, r, rows[~above], cols, (*tests, (int(k), False, float(t))), depth - 1, out, leaf)
    grow(x, r, rows[above], cols, (*tests, (int(k), True, float(t))), depth - 1, out, leaf)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 5) -> Ensemble:
    """Boosted trees for the rules, then a lasso over all of them. One class, or none, or no rule: the share of ones is the score."""
    n = len(y)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    model = Ensemble(names, float(np.log(share / (1 - share))))
    if not 0 < y.sum() < n:
        return model
    random = np.random.default_rng(seed)
    z, paths = np.full(n, model.intercept), []
    for _ in range(N_TREES):
        rows = np.sort(random.choice(n, max(1, n // 2), replace=False))
        cols = np.sort(random.choice(x.shape[1], max(2, 2 * x.shape[1] // 3), replace=False))
        leaf = np.zeros(n)
        found: list[tuple] = []
        grow(x, y - 1 / (1 + np.exp(-z)), rows, cols, (), DEPTH, found, leaf)
        z += 2.0 * leaf
        paths += found
    rules = [Rule(p) for p in dict.fromkeys(paths)]
    if not rules:  # too few rows for a split, or statistics that don't vary
        return model
    r = np.column_stack([rule.on(x) for rule in rules]).astype(np.float64)
    mean = r.mean(0)
    scale = np.sqrt(mean * (1 - mean)) + 1e-6
    r = (r - mean) / scale
    # accelerated proximal gradient
    w, b = np.zeros(r.shape[1]), model.intercept
    v, c, t = w.copy(), b, 1.0
    top = np.linalg.norm(r, 2) ** 2 / (4 * n) + 0.25
    for _ in range(STEPS):
        g = 1 / (1 + np.exp(-np.clip(r @ v + c, -30, 30))) - y
        new = v - (r.T @ g) / n / top
        new = np.sign(new) * np.maximum(np.abs(new) - LASSO / top, 0)
        new_b = c - g.mean() / top
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    for rule, weight in zip(rules, w / scale):
        if abs(weight) > 1e-6:
            rule.weight = float(weight)
            model.rules.append(rule)
    model.intercept = float(b - (w * mean / scale).sum())
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``src, held_out, score`` per row of ``docs``; ``src`` holds its columns.

    Learns from at most ``max_labelled`` labelled rows outside the held-out fold.
    Labels other than 0 and 1, and labels of no document, teach nothing; without
    labels every score is a half. Null and empty texts are scored like others,
    very long ones whole. Rows that repeat an id are scored each; as a teacher
    the id has the greatest of its texts. Columns of ``docs`` named ``q_...``
    don't matter. An empty table gives an empty one.
    """
    usable = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label")).where((fold(F.col("label_id")) != 0) & F.col("label").isin(0, 1)).groupBy("label_id").agg(F.min("label").cast("int").alias("label"))
    # at most max_labelled rows of two numbers
    chosen = F.broadcast(table(usable.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)))
    rows = docs.select(F.struct("*").alias("src"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    taught = rows.join(chosen, F.col("id") == F.col("label_id")).groupBy("id", "label").agg(F.max("text").alias("text"))
    sample, names = measured(taught.select("text", "label"), F.col("text"))
    # one row of numbers for each of the chosen ids
    seen = sample.select("label", *names).toPandas()
    model = fit(seen[names].to_numpy(float), seen["label"].to_numpy(float), names)
    out, _ = measured(rows.select("src", (fold(F.col("id")) == 0).alias("held_out"), "text"), F.col("text"))
    return out.select("src", "held_out", model.column().alias("score"))


def op3_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select(F.col("src.doc_id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
