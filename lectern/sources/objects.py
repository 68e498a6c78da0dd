"""Content-addressed objects in a shared folder: bodies with their search index, images, manifests.

A folder of Parquet stands for the store; keys are ``xx/<hash>.<ending>``, from
the content, so a repeated write adds nothing new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.search import body_index

KEY = r"^[0-9a-f]{2}/[0-9a-f-]{36,64}\.[a-z0-9]{1,8}$"


def object_key(content: Column, ending: str) -> Column:
    digest = F.sha2(content.cast("binary"), 256)
    return F.concat(F.left(digest, F.lit(2)), F.lit("/"), digest, F.lit(f".{ending}"))


def put_bodies(bodies: DataFrame, folder: str) -> DataFrame:
    """Store ``body`` texts once each, with their search index; gives ``bodies`` with ``content_key``."""
    keyed = bodies.withColumn("content_key", object_key(F.col("body"), "txt"))
    new = keyed.select("content_key", "body").dropDuplicates(["content_key"])
    held = stored(bodies.sparkSession, folder)
    if held is not None:
        new = new.join(held.select("content_key"), "content_key", "left_anti")
    new.select("content_key", "body", body_index("body").alias("body_index"), F.octet_length("body").alias("size"), F.current_timestamp().alias("modified_at")).write.mode("append").parquet(folder)
    return keyed


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """All objects of a store; None before the first write."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(folder)


def get(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys (content_key)`` with their objects, nulls where one is gone; malformed keys reach nothing."""
    return keys.join(objects.where(F.col("content_key").rlike(KEY)), "content_key", "left")


def listing(objects: DataFrame) -> DataFrame:
    """``key, size, modified_at`` of well-formed keys."""
    return objects.where(F.col("content_key").rlike(KEY)).select(F.col("content_key").alias("key"), "size", "modified_at")


def without(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """The store after deletion of ``keys (key)``; a key that isn't there is no error. Write it to a new folder and swap."""
    return objects.join(keys.select(F.col("key").alias("content_key")), "content_key", "left_anti")


ENDINGS, MOST_UPLOAD = ("txt", "epub"), 100 << 20


def uploads(files: DataFrame) -> DataFrame:
    """Source files from ``spark.read.format("binaryFile")``: hash, size, ending and why one is refused. Identical bytes are jobs of their own."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    error = F.when(~ending.isin(*ENDINGS), "unsupported_format").when(F.col("length") == 0, "empty_file").when(F.col("length") > MOST_UPLOAD, "file_too_large")
    return files.select("path", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size_bytes"), ending.alias("ending"), error.alias("error"))
