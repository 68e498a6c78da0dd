"""Tables between jobs, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, one of our own if the session is a single process; a cluster has to name one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_lectern_folder", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        sc._lectern_folder = folder
    return folder.rstrip("/")


#: The paths that tables were written to, for each :func:`temporary` under way.
_MADE: list[list[str]] = []


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _MADE:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a :func:`table`, or of a selection from one, that no later job reads; other frames' files stay."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lectern")
    home = root.getFileSystem(conf).makeQualified(root).toString()
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.toString().startswith(f"{home}/"):
            path.getFileSystem(conf).delete(path, True)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark: SparkSession):
    """Tables written within are deleted at its end, but for those given to the function it yields.

    For whoever has written a result and reads nothing else of how it was made.
    """
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._lectern_path)
        return df

    _MADE.append(made)
    try:
        yield keep
    finally:
        _MADE.remove(made)
        for path in made:
            if path not in kept:
                _delete(spark, path)
