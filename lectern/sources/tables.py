"""Named Parquet tables under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as written, zone-less timestamps turned into instants (the session runs in UTC).

    Watermarks and session windows need instants; the cast costs nothing in UTC.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df
