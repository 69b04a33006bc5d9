"""Look-ups by keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import parts


def lookup(rows: DataFrame, by: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """rows joined with by on keys; by has one row a key, and ``count`` says how many rows of rows have it.

    Keys with more than a quarter of a task's even share are fewer than four times the tasks, so
    they are broadcast; the other rows meet their keys in a shuffle.
    """
    total = by.agg(F.sum(count).alias("n")).first().n or 0
    hot = F.col(count) > max(1000, total // (4 * parts(rows.sparkSession)))
    frequent = F.broadcast(by.where(hot))
    rest = rows.join(frequent.select(*keys), keys, "left_anti").join(by.where(~hot), keys)
    return rows.join(frequent, keys).unionByName(rest)
