"""Rows that are written once to the folder that all executors share, and read from there.

The folder is ``spark.checkpoint.dir`` of the session; only in local mode, as in tests, a temporary
one is taken where it is unset.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-scratch-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table; what reads it doesn't depend on how the rows were dealt out."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what was written so far; results that read it must be written before."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(conf).delete(at, True)
