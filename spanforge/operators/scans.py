"""Row numbers, running values, neighbours and runs along series of any length.

A series is cut into pieces (column ``_p``) that rise with its order: stretches of a given width, or
ranges of about equal numbers of rows that Spark samples.  Windows run within a key's piece;
what a piece needs from those before it (a count, a sum, a maximum, the last row) is aggregated to one row for
each piece and carried on by a window over these few rows.  So one long series is worked on by as
many tasks as it has pieces, and rows of a key move once, whatever is computed along them.

Ranges are written once to the shared folder before anything refers to their numbers: bounds that
are sampled anew would give other pieces.  Rows that are equal in keys and order stay in one piece.
Null keys are keys like any other; a null order belongs to the first piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

Keys = list[str]


def pieces(s: DataFrame, keys: Keys, order: str, width: float = 0) -> DataFrame:
    """s with the column _p: stretches of ``width`` of the order, or ranges of rows if it is 0."""
    if width:
        return s.withColumn("_p", F.coalesce(F.floor(F.col(order) / F.lit(width)), F.lit(-(2**62))))
    n = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is given isn't made smaller at run time
    ranged = s.repartitionByRange(n, *[F.col(k) for k in keys], F.col(order))
    return written(ranged.withColumn("_p", F.spark_partition_id().cast("long")), "pieces")


def _inside(keys: Keys, order: str):
    return Window.partitionBy(*keys, "_p").orderBy(order)


def _along(keys: Keys):
    """Over the pieces of a key, one row each; without keys over all pieces."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_p")


def _with(p: DataFrame, small: DataFrame, keys: Keys, how: str = "inner") -> DataFrame:
    """p with the columns of small, one row for each key's piece."""
    on = [*keys, "_p"]
    o = small.withColumnsRenamed({k: f"_on_{k}" for k in on})
    same = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on]
    return p.join(o, same, how).drop(*[f"_on_{k}" for k in on])


_COMBINED = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def carried(p: DataFrame, keys: Keys, value: Column, how: str, name: str) -> DataFrame:
    """(keys, _p, name): the sum, maximum or minimum of value over the key's earlier pieces; null in the first."""
    f = _COMBINED[how][0]
    small = p.groupBy(*keys, "_p").agg(f(value).alias("_sc_s"))
    up = _along(keys).rowsBetween(Window.unboundedPreceding, -1)
    return small.select(*keys, "_p", f("_sc_s").over(up).alias(name))


def running(p: DataFrame, keys: Keys, order: str, value: Column, name: str, how: str = "sum") -> DataFrame:
    """Column name: sum, maximum or minimum of value from the key's first row to this one."""
    f, both = _COMBINED[how]
    here = f("_sc_v").over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    rows = _with(p, carried(p, keys, value, how, "_sc_o"), keys).withColumn("_sc_v", value)
    total = F.when(F.col("_sc_o").isNull(), here).when(here.isNull(), F.col("_sc_o")).otherwise(both(here, F.col("_sc_o")))
    return rows.withColumn(name, total).drop("_sc_v", "_sc_o")


def numbered(p: DataFrame, keys: Keys, order: str, name: str = "_i", total: str | None = None) -> DataFrame:
    """Column name: the row's number in its key from 0, and the key's number of rows as ``total``."""
    small = p.groupBy(*keys, "_p").agg(F.count("*").alias("_sc_s"))
    w = _along(keys)
    up, all_ = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    extra = [F.sum("_sc_s").over(all_).alias(total)] if total else []
    small = small.select(*keys, "_p", F.coalesce(F.sum("_sc_s").over(up), F.lit(0)).alias("_sc_o"), *extra)
    return _with(p, small, keys).withColumn(name, (F.row_number().over(_inside(keys, order)) - 1 + F.col("_sc_o")).cast("long")).drop("_sc_o")


def neighbours(p: DataFrame, keys: Keys, order: str, columns: list[str]) -> DataFrame:
    """Columns _before and _after: the order and these columns of the rows next to each, as structs."""
    x = F.struct(order, *[c for c in columns if c != order])
    ends = p.groupBy(*keys, "_p").agg(F.min(x).alias("_sc_lo"), F.max(x).alias("_sc_hi"))
    w = _along(keys)
    ends = ends.select(*keys, "_p", F.lag("_sc_hi").over(w).alias("_sc_pe"), F.lead("_sc_lo").over(w).alias("_sc_ne"))
    inner = _inside(keys, order)
    rows = _with(p, ends, keys).withColumn("_sc_x", x)
    return rows.withColumn("_before", F.coalesce(F.lag("_sc_x").over(inner), "_sc_pe")).withColumn("_after", F.coalesce(F.lead("_sc_x").over(inner), "_sc_ne")).drop("_sc_x", "_sc_pe", "_sc_ne")


def filled(p: DataFrame, keys: Keys, order: str, column: str, name: str) -> DataFrame:
    """Column name: the last value of column that isn't null, up to this row."""
    last = p.where(F.col(column).isNotNull()).groupBy(*keys, "_p").agg(F.max(F.struct(order, column)).alias("_sc_x"))
    small = p.select(*keys, "_p").distinct()
    ends = _with(small, last, keys, "left").select(*keys, "_p", F.last("_sc_x", ignorenulls=True).over(_along(keys).rowsBetween(Window.unboundedPreceding, -1))[column].alias("_sc_o"))
    here = F.last(column, ignorenulls=True).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return _with(p, ends, keys).withColumn(name, F.coalesce(here, "_sc_o")).drop("_sc_o")


def islands(p: DataFrame, keys: Keys, order: str, flag: Column, value: Column) -> DataFrame:
    """(keys, first, last, best, n): longest runs of neighbouring rows where the flag holds, with the greatest value.

    Runs inside a piece are complete; those that touch an end of one, two a piece at most, are put
    together by their row numbers.
    """
    rows = p.withColumn("_sc_f", F.coalesce(flag, F.lit(False))).withColumn("_sc_v", value)
    w = _inside(keys, order)
    rows = rows.withColumn("_sc_n", F.row_number().over(w)).withColumn("_sc_g", F.sum(F.when(F.col("_sc_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = rows.where("_sc_f").groupBy(*keys, "_p", "_sc_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.max("_sc_v").alias("best"), F.count("*").alias("n"), F.min("_sc_n").alias("_sc_a"), F.max("_sc_n").alias("_sc_z"))
    size = p.groupBy(*keys, "_p").agg(F.count("*").alias("_sc_c"))
    size = size.select(*keys, "_p", "_sc_c", F.coalesce(F.sum("_sc_c").over(_along(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_sc_o"))
    own = _with(own, size, keys)
    edge = (F.col("_sc_a") == 1) | (F.col("_sc_z") == F.col("_sc_c"))
    out = [*keys, "first", "last", "best", "n"]
    by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_sc_from")
    open_ = own.where(edge).withColumn("_sc_from", F.col("_sc_a") + F.col("_sc_o")).withColumn("_sc_to", F.col("_sc_z") + F.col("_sc_o"))
    open_ = open_.withColumn("_sc_new", F.when(F.col("_sc_from") == F.lag("_sc_to").over(by) + 1, 0).otherwise(1)).withColumn("_sc_r", F.sum("_sc_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = open_.groupBy(*keys, "_sc_r").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("best").alias("best"), F.sum("n").alias("n"))
    return own.where(~edge).select(*out).unionByName(joined.select(*out))


def merged(iv: DataFrame, keys: Keys, width: float = 0, gap: int = 0) -> DataFrame:
    """(keys, start, stop): unions of intervals that overlap, touch or lie at most ``gap`` apart, in pieces by their starts.

    Each piece is merged on its own with the greatest stop before it in mind; of a piece only the
    part that reaches on from there is left to be put together with the pieces before.
    """
    p = pieces(iv, keys, "start", width)
    before = carried(p, keys, F.col("stop"), "max", "_sc_o")
    w = Window.partitionBy(*keys, "_p").orderBy("start", "stop")
    reach = F.greatest(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_sc_o"))
    rows = _with(p, before, keys).withColumn("_sc_new", F.when(F.col("start") <= reach + gap, 0).otherwise(1))
    rows = rows.withColumn("_sc_g", F.sum("_sc_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = rows.groupBy(*keys, "_p", "_sc_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    # island 0 of a piece goes on from an earlier piece: to the last island that began before it
    last = own.groupBy(*keys, "_p").agg(F.max("_sc_g").alias("_sc_l")).withColumn("_sc_m", F.when(F.col("_sc_l") > 0, F.struct("_p", "_sc_l")))
    last = last.select(*keys, "_p", F.last("_sc_m", ignorenulls=True).over(_along(keys).rowsBetween(Window.unboundedPreceding, -1)).alias("_sc_to"))
    at = _with(own, last, keys)
    of = F.when(F.col("_sc_g") == 0, F.col("_sc_to")).otherwise(F.struct(F.col("_p").alias("_p"), F.col("_sc_g").alias("_sc_l")))
    return at.withColumn("_sc_of", of).groupBy(*keys, "_sc_of").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select(*keys, "start", "stop")


def stretches(p: DataFrame, keys: Keys, order: str, begins: Column, *also: str) -> DataFrame:
    """(keys, first, last, n, also): rows from one that begins a stretch to the next such row.

    The numbers of stretches are running sums; ``also`` are columns that don't change within one.
    """
    rows = running(p, keys, order, F.when(begins, 1).otherwise(0), "_run")
    part = rows.groupBy(*keys, "_run", "_p", *also).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return part.groupBy(*keys, "_run", *also).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_run")


def stays(s: DataFrame, keys: Keys, order: str, column: str, width: float = 0) -> DataFrame:
    """(keys, column, start, stop): longest stretches of rows in which column keeps its value."""
    p = neighbours(pieces(s, keys, order, width), keys, order, [column])
    found = stretches(p, keys, order, F.col("_before").isNull() | ~F.col(column).eqNullSafe(F.col("_before")[column]), column)
    return found.select(*keys, column, F.col("first").alias("start"), F.col("last").alias("stop"))
