"""The Spark session the library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings come by keyword, dots as ``__``."""
    builder = (
        SparkSession.builder.master(master)
        .appName("lectern")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
