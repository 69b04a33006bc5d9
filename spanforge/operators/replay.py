"""Cyclic shuffles, scores against them, stacked windows, trained scaling and tracks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detect import runs


def hysteresis(s: DataFrame, keys: list[str], index: str, value: str, primary: float, secondary: float) -> DataFrame:
    """(keys, first, last, best): runs at or above ``secondary`` that reach ``primary``."""
    x = F.col(value)
    return runs(s, keys, index, x >= secondary, x).drop("n").where(F.col("best") >= primary)


def cycled(b: DataFrame, keys: list[str], shift: Column) -> DataFrame:
    """Bins of each group moved on by ``shift`` places; what leaves at the end comes back at the start."""
    n = F.max("bin_idx").over(Window.partitionBy(*keys)) + 1
    return b.withColumn("bin_idx", F.pmod(F.col("bin_idx") + shift, n).cast("int"))


def random_shift(seed: int, *cols: str) -> Column:
    """The same number at every run and in every partitioning, for shuffles that differ by the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1_000_003))


def pair_score(b: DataFrame, keys: list[str], v: str = "n") -> DataFrame:
    """(keys, score): sum of the products of neighbouring bins' populations over all series."""
    flat = b.groupBy(*keys, "bin_idx").agg(F.sum(v).alias("_n"))
    after = F.lead("_n").over(Window.partitionBy(*keys).orderBy("bin_idx"))
    return flat.withColumn("_p", F.col("_n") * after).groupBy(*keys).agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("score"))


def cycle_test(b: DataFrame, shuffles: int, shift: Column) -> DataFrame:
    """(interval_id, score, p): pair score and the share of unit-wise cyclic shuffles that reach it.

    ``shift`` may use series_id, interval_id and the shuffle's number ``k`` (from 1).
    """
    score = pair_score(b, ["interval_id"])
    many = b.select("series_id", "interval_id", "bin_idx", "n", F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("k"))
    null = pair_score(cycled(many, ["series_id", "interval_id", "k"], shift), ["interval_id", "k"]).withColumnRenamed("score", "_s")
    reached = F.sum(F.when(F.col("_s") >= F.col("score"), 1).otherwise(0))
    return score.join(null, "interval_id").groupBy("interval_id", "score").agg(((reached + 1) / (F.count("*") + 1)).alias("p"))


def longest_active(b: DataFrame) -> DataFrame:
    """(interval_id, n_consecutive): the most consecutive bins in which any series has events."""
    flat = b.groupBy("interval_id", "bin_idx").agg(F.sum("n").alias("n"))
    best = runs(flat, ["interval_id"], "bin_idx", F.col("n") > 0, F.col("n")).groupBy("interval_id").agg(F.max(F.col("last") - F.col("first") + 1).alias("m"))
    return flat.select("interval_id").distinct().join(best, "interval_id", "left").select("interval_id", F.coalesce("m", F.lit(0)).alias("n_consecutive"))


def stacked(b: DataFrame, before: int, after: int, stride: int = 1) -> DataFrame:
    """(series_id, interval_id, bin_idx, offset, n): each whole window of neighbouring bins, one row a bin."""
    w = Window.partitionBy("series_id", "interval_id")
    near = w.orderBy("bin_idx").rowsBetween(-before, after)
    rows = b.select("series_id", "interval_id", "bin_idx", F.collect_list("n").over(near).alias("x"), F.max("bin_idx").over(w).alias("m"))
    whole = rows.where((F.col("bin_idx") >= before) & (F.col("bin_idx") + after <= F.col("m")) & ((F.col("bin_idx") - before) % stride == 0))
    return whole.select("series_id", "interval_id", "bin_idx", F.posexplode("x").alias("offset", "n")).withColumn("offset", F.col("offset") - before)


def trained_scale(b: DataFrame, train: Column, keys: list[str], v: str = "n") -> DataFrame:
    """Column y: minus the mean and by the population deviation (0 counts as 1) of the training rows."""
    x = F.col(v).cast("double")
    fit = b.where(train).groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    return b.join(fit, keys).withColumn("y", (x - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def linearized(points: DataFrame, track: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Columns segment, lin and off: the nearest place on a track of straight segments, by its
    length from the start, and the distance to it; of equal ones the first segment."""
    best, at = [], 0.0
    for k, ((ax, ay), (bx, by)) in enumerate(zip(track, track[1:])):
        length = math.hypot(bx - ax, by - ay)
        ux, uy = (bx - ax) / length, (by - ay) / length
        along = F.least(F.greatest((F.col(x) - ax) * ux + (F.col(y) - ay) * uy, F.lit(0.0)), F.lit(length))
        off = F.sqrt(F.pow(F.col(x) - ax - along * ux, 2) + F.pow(F.col(y) - ay - along * uy, 2))
        best.append(F.struct(off.alias("off"), F.lit(k).alias("segment"), (along + at).alias("lin")))
        at += length
    one = F.array_min(F.array(*best))
    return points.withColumn("_b", one).withColumns({c: F.col("_b")[c] for c in ("segment", "lin", "off")}).drop("_b")
