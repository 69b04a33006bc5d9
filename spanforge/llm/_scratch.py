"""Intermediate results in the folder that all executors share.

``spark.checkpoint.dir`` is read from the session.  Only where neither it nor the
context's checkpoint folder is set, a temporary folder is taken in local mode (as in tests);
on a cluster that is an error, because other machines could not read it.
"""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-scratch-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the checkpoint folder (small rows)."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: What was written: tables by name, and folders.
_made: list[tuple[str | None, str]] = []
_own: contextvars.ContextVar[list[tuple[str | None, str]] | None] = contextvars.ContextVar("own", default=None)


@contextlib.contextmanager
def gathered() -> Iterator[list[tuple[str | None, str]]]:
    """A list of what this thread writes inside, for ``clear``."""
    own: list[tuple[str | None, str]] = []
    token = _own.set(own)
    try:
        yield own
    finally:
        _own.reset(token)


def _noted(table: str | None, path: str) -> None:
    _made.append((table, path))
    if (own := _own.get()) is not None:
        own.append((table, path))


def clear(spark: SparkSession, made: list[tuple[str | None, str]] | None = None) -> None:
    """Drops the tables and deletes the folders that were written so far, or those of a list; results that read them must be written before."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    todo = _made if made is None else made
    while todo:
        table, path = todo.pop()
        if made is not None and (table, path) in _made:
            _made.remove((table, path))
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a compressed Parquet table in the shared folder (wide rows, texts)."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _noted(None, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """The rows of df in a table bucketed by key, so that later joins on key leave it in place."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{folder(spark).rstrip('/')}/{table}"
    _noted(table, path)
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table)
    return spark.table(table)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is planned and run inside: a batch of wide rows is in memory as a whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
