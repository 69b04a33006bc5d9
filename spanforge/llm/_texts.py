"""Distinct texts of a corpus in a bucketed table, so that later joins leave them in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frame import narrow
from ._scratch import bucketed


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, h, m): the text as bytes (null: empty), a 64-bit hash of it and its md5."""
    rows = narrow(docs, id_col, text_col)
    t = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return rows.select(F.col(id_col).alias("id"), t.alias("t")).withColumn("h", F.xxhash64("t")).withColumn("m", F.md5("t"))


def distinct_texts(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(u, h, m, t) of the distinct texts of rows (id, t, h, m), bucketed by u.

    u is h, or another hash for the second and later texts of one h.  The partial aggregation
    leaves one row of a text in each task, so copies of one text meet as one row for each task.
    """
    found = rows.where(F.length("t") >= least_bytes).groupBy("h").agg(F.array_sort(F.collect_set(F.struct("m", "t"))).alias("x"))
    each = found.select("h", F.posexplode("x").alias("i", "x"))
    u = F.when(F.col("i") == 0, F.col("h")).otherwise(F.xxhash64("h", "i"))
    return bucketed(each.select(u.alias("u"), "h", "x.m", "x.t"), "texts", "u")
