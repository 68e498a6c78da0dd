"""A training corpus from raw documents: toxicity, repeated lines, near copies, benchmark text, mixture.

Each stage works on all rows that its predecessor kept, and but for the last
returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.decontamination import find_benchmark, judged
from lectern.llm.line_dedup import drop_repeated_lines
from lectern.llm.mixing import mixed
from lectern.llm.near_dedup import keep_one_of_each
from lectern.llm.shared import table
from lectern.llm.toxicity import score_toxicity
from lectern.stored import drop, temporary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("score < 0.5").select("src.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a text that loses lines has a new n_chars, if the documents have that column."""
    out = drop_repeated_lines(docs)
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}

    def column(name: str):
        old = F.col("src").getField(name)
        return (F.when(changed, new[name].cast(docs.schema[name].dataType)).otherwise(old) if name in new else old).alias(name)

    return out.select(*map(column, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, a similarity of 0.8)."""
    return keep_one_of_each(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    found = judged(find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.where("NOT contaminated").select("src.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their weights: the documents taken, with ``repeats``, how often (underscores go before it where the documents have such a column). Documents without words go."""
    name, there = "repeats", {c.lower() for c in docs.columns}
    while name in there:
        name = f"_{name}"
    return mixed(docs).select("src.*", F.col("repeats").alias(name))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: Scores of a trained model can't be had in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of what they write on the way only the last one's rows stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with temporary(spark) as keep:
            after = keep(table(stage(spark, docs, sf_dir)))
        drop(docs)
        docs = after
    return docs
