"""Joins of points and intervals that overlap, by cells whose width follows the intervals' lengths.

An interval is dealt to the cells of one level, whose width is the power of 16 that makes it cover two
to ten of them (one or two where it is shorter than any level above the least); so a very long interval
is a few cells and not millions, and short ones don't meet all that lies within hours of them.  A point goes to one cell
of every level that is in use, which one row, aggregated from the intervals, says.  All joins are
equi-joins on level and cell.  Cells depend on times through a rising function only, so rounding
can't lose a pair.  Times may be whole numbers or doubles of any unit.

Hot cells: Spark splits skewed partitions of these joins at run time; with ``most`` a cell with more
points than that is dealt to several rows of the join by a hash of the point, and its intervals to each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(start: Column, stop: Column) -> Column:
    """The least power of 16 of which the interval is at most eight long; 0 for an empty one."""
    length = (stop - start).cast("double")
    return F.when(length > 0, F.ceil(F.log2(length / 8) / 4)).otherwise(0).cast("int")


def cell(t: Column, at: Column) -> Column:
    return F.floor(t.cast("double") / F.pow(F.lit(16.0), at))


def _cells(start: Column, stop: Column, at: Column) -> Column:
    return F.explode(F.sequence(cell(start, at), cell(stop, at)))


def _levels(iv: DataFrame, at: Column) -> DataFrame:
    """One row: the levels that are in use, a few dozen at most."""
    return F.broadcast(iv.agg(F.collect_set(at).alias("_levels")))


def points_in(points: DataFrame, iv: DataFrame, closed_right: bool = False, most: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Each point (t, ...) with each interval (start, stop, ...) that holds it: start <= t < stop, or <= stop; with ``keys``,
    columns of both, only where they are equal."""
    start, stop = F.col("start"), F.col("stop")
    at = level(start, stop)
    cells = iv.withColumn("_l", at).withColumn("_c", _cells(start, stop, F.col("_l")))
    p = points.crossJoin(_levels(iv, at)).withColumn("_l", F.explode("_levels")).drop("_levels").withColumn("_c", cell(F.col("t"), F.col("_l")))
    on = [*(keys or []), "_l", "_c"]
    if most:
        hot = p.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*on, F.ceil(F.col("_n") / most).alias("_s"))
        p = p.join(hot, on, "left").withColumn("_k", F.pmod(F.xxhash64(*points.columns), F.coalesce("_s", F.lit(1)))).drop("_s")
        cells = cells.join(hot, on, "left").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_s", F.lit(1)) - 1))).drop("_s")
        on = [*on, "_k"]
    inside = (F.col("t") >= start) & (F.col("t") <= stop if closed_right else F.col("t") < stop)
    return p.join(cells, on).where(inside).drop("_l", "_c", "_k")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, stop, _s, _e): pairs with a.start < b.stop and b.start < a.stop, once for each pair of rows.

    A pair meets on the coarser of its two levels, in the cell where its overlap starts.
    """
    at, to = level(F.col("start"), F.col("stop")), level(F.col("_s"), F.col("_e"))
    o = b.select(*keys, F.col("start").alias("_s"), F.col("stop").alias("_e"))
    of_a, of_b = _levels(a, at), _levels(o, to)

    def dealt(df: DataFrame, own: Column, name: str, levels: DataFrame, lo: str, hi: str) -> DataFrame:
        coarser = F.array_distinct(F.transform("_levels", lambda x: F.greatest(x, F.col(name))))
        return (df.withColumn(name, own).crossJoin(levels).withColumn("_x", F.explode(coarser)).drop("_levels")
                .withColumn("_c", _cells(F.col(lo), F.col(hi), F.col("_x"))))

    pairs = dealt(a.select(*keys, "start", "stop"), at, "_la", of_b, "start", "stop").join(dealt(o, to, "_lb", of_a, "_s", "_e"), [*keys, "_x", "_c"])
    once = (F.col("_x") == F.greatest("_la", "_lb")) & (cell(F.greatest("start", "_s"), F.col("_x")) == F.col("_c"))
    return pairs.where("start < _e and _s < stop").where(once).select(*keys, "start", "stop", "_s", "_e")
