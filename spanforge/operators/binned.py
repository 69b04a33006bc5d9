"""Dense bins (series_id, interval_id, bin_idx, n or v) and windows over them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .events import restrict

_GROUP = ["series_id", "interval_id"]


def grid(iv: DataFrame, ds: int) -> DataFrame:
    """(interval_id, bin_idx, bin_start): whole bins from each interval's start; the rest is dropped."""
    n = F.floor((F.col("stop") - F.col("start")) / ds).cast("int")
    return (iv.where(n > 0).withColumn("bin_idx", F.explode(F.sequence(F.lit(0), n - 1)))
            .select("interval_id", "bin_idx", (F.col("start") + F.col("bin_idx") * F.lit(ds).cast("long")).alias("bin_start")))


def grouped(f: Callable[[np.ndarray], float]):
    """A function of a bin's values, as an aggregate over Arrow batches."""
    @F.pandas_udf("double")
    def aggregate(v: pd.Series) -> float:
        return f(v.to_numpy())

    return aggregate


def bin_events(ev: DataFrame, iv: DataFrame, ds: int, aggregates: dict[str, Column | Callable[[np.ndarray], float]] | None = None, bucket: int | None = None,
               value: str = "value") -> DataFrame:
    """Every series, interval and bin with its aggregates (counts if none are given), zeros and nulls included.

    An aggregate is a column of aggregate functions, or a function that gets the bin's values of the
    column ``value`` and returns a number; such functions see bins that have an event.
    """
    inside = restrict(ev, iv, bucket).withColumn("bin_idx", F.floor((F.col("t") - F.col("start")) / ds).cast("int"))
    by, every = [*_GROUP, "bin_idx"], aggregates or {}
    some = inside.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in every.items() if isinstance(c, Column)])
    if own := {k: f for k, f in every.items() if not isinstance(f, Column)}:  # Spark doesn't mix both kinds in one aggregation
        some = some.join(inside.groupBy(*by).agg(*[grouped(f)(F.col(value).cast("double")).alias(k) for k, f in own.items()]), by)
    cells = ev.select("series_id").distinct().crossJoin(grid(iv, ds))
    return cells.join(some, [*_GROUP, "bin_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rebin(b: DataFrame, w: int) -> DataFrame:
    """Sums of w neighbouring bins of an interval; incomplete groups are dropped."""
    return (b.groupBy(*_GROUP, F.floor(F.col("bin_idx") / w).cast("int").alias("bin_idx"))
            .agg(F.sum("n").alias("n"), F.min("bin_start").alias("bin_start"), F.count("*").alias("_c")).where(F.col("_c") == w).drop("_c"))


def flatten(b: DataFrame) -> DataFrame:
    return b.groupBy("interval_id", "bin_idx", "bin_start").agg(F.sum("n").alias("n"))


def stats(b: DataFrame, v: str = "n") -> DataFrame:
    x = F.col(v).cast("double")
    return b.groupBy("series_id").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.median(x).alias("median"), F.sum(v).alias("total"), F.count("*").alias("n_bins"))


def scaled(b: DataFrame, center: bool, scale: bool, v: str = "n") -> DataFrame:
    """Column y: minus the series' mean and by its population deviation (0 counts as 1)."""
    x = F.col(v).cast("double")
    m = b.groupBy("series_id").agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    y = x - F.col("_m") if center else x
    y = y / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s")) if scale else y
    return b.join(m, "series_id").withColumn("y", y).drop("_m", "_s")


def active_per_bin(b: DataFrame) -> DataFrame:
    return b.groupBy("interval_id", "bin_idx", "bin_start").agg(F.sum(F.least("n", F.lit(1))).alias("n_active"))


def inside(b: DataFrame, iv: DataFrame, ds: int) -> DataFrame:
    """Bins that lie entirely in one of the intervals (start, stop) of the same interval_id."""
    o = iv.select("interval_id", F.col("start").alias("_s"), F.col("stop").alias("_e"))
    return b.join(o, "interval_id").where((F.col("bin_start") >= F.col("_s")) & (F.col("bin_start") + ds <= F.col("_e"))).drop("_s", "_e")


def rolling(b: DataFrame, before: int, after: int, v: str = "n", how: str = "sum") -> DataFrame:
    """Column y: sum or mean over neighbouring bins of the interval."""
    w = Window.partitionBy(*_GROUP).orderBy("bin_idx").rowsBetween(-before, after)
    return b.withColumn("y", getattr(F, how)(F.col(v).cast("double")).over(w))


def smooth(b: DataFrame, weights: list[float], keys: list[str], v: str = "n", reflect: bool = True) -> DataFrame:
    """Column y: convolution along bin_idx, from the values in a window around each bin.

    At the edges of its group, which is dense from 0 on, the index is folded back (``reflect``), or
    the sum is divided by the weights of the bins that are there.
    """
    r = len(weights) // 2
    w = F.array(*map(F.lit, weights))
    group = Window.partitionBy(*keys)
    near = F.collect_list(F.struct(F.col("bin_idx").alias("at"), F.col(v).cast("double").alias("v"))).over(group.orderBy("bin_idx").rangeBetween(-r, r))
    rows = b.withColumn("_w", near).withColumn("_n", F.max("bin_idx").over(group) + 1)
    at = F.col("bin_idx")
    zero = F.lit(0.0)
    if reflect:  # a period of 2 n, the second half mirrored
        def folded(k):
            m = F.pmod(at + k - r, 2 * F.col("_n"))
            return F.when(m < F.col("_n"), m).otherwise(2 * F.col("_n") - 1 - m)

        first = F.greatest(at - r, F.lit(0))
        y = F.aggregate(F.sequence(F.lit(0), F.lit(2 * r)), zero, lambda s, k: s + w[k] * F.coalesce(F.col("_w")[folded(k) - first]["v"], zero))
    else:
        there = F.filter("_w", lambda e: e["v"].isNotNull())
        y = (F.aggregate(there, zero, lambda s, e: s + w[e["at"] - at + r] * e["v"]) / F.aggregate(there, zero, lambda s, e: s + w[e["at"] - at + r]))
    return rows.withColumn("y", y).drop("_w", "_n")


def combined(a: DataFrame, b: DataFrame | float, op: str, v: str = "n") -> DataFrame:
    """Bins and a number, or bins of the same grid; x / 0 is null."""
    f = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / F.when(y != 0, y)}[op]
    if isinstance(b, DataFrame):
        return a.join(b.select(*_GROUP, "bin_idx", F.col(v).alias("_o")), [*_GROUP, "bin_idx"]).withColumn(v, f(F.col(v), F.col("_o"))).drop("_o")
    return a.withColumn(v, f(F.col(v).cast("double"), F.lit(float(b))))


def centers(b: DataFrame, ds: int) -> DataFrame:
    """(interval_id, n_bins, first, last, midpoint): midpoint counts the bins of all intervals before."""
    size = b.groupBy("interval_id").agg((F.max("bin_idx") + 1).alias("n_bins"), F.min("bin_start").alias("first"), (F.max("bin_start") + ds).alias("last"))
    up = scans.running(scans.pieces(size, [], "interval_id"), [], "interval_id", F.col("n_bins"), "_up")
    return up.select("interval_id", "n_bins", "first", "last", (F.col("_up") - F.col("n_bins") + (F.col("n_bins") - 1) / 2).alias("midpoint"))


def without_last(b: DataFrame) -> DataFrame:
    """Each interval without its last bin."""
    last = b.groupBy("interval_id").agg(F.max("bin_idx").alias("_m"))
    return b.join(last, "interval_id").where(F.col("bin_idx") < F.col("_m")).drop("_m")


def from_signal(s: DataFrame, iv: DataFrame, step: int, bucket: int | None = None) -> DataFrame:
    """Samples as bins one step wide: (series_id, interval_id, bin_idx, bin_start, n), n being the sample."""
    rows = restrict(s, iv, bucket)
    w = Window.partitionBy("series_id", "interval_id").orderBy("t")
    return rows.select("series_id", "interval_id", (F.row_number().over(w) - 1).cast("int").alias("bin_idx"), F.col("t").alias("bin_start"), F.col("y").alias("n"))


class Moments:
    """A scaler whose numbers of rows, sums and squares can be added to: fit on parts, then transform."""

    def __init__(self, keys: list[str], v: str = "n") -> None:
        self.keys, self.v, self.state = keys, v, None

    def partial_fit(self, b: DataFrame) -> Moments:
        x = F.col(self.v).cast("double")
        part = b.groupBy(*self.keys).agg(F.count(x).alias("_n"), F.sum(x).alias("_x"), F.sum(x * x).alias("_xx"))
        if self.state is not None:
            part = self.state.unionByName(part).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in ("_n", "_x", "_xx")])
        self.state = part
        return self

    def moments(self) -> DataFrame:
        mean = F.col("_x") / F.col("_n")
        sd = F.sqrt(F.greatest(F.col("_xx") / F.col("_n") - mean * mean, F.lit(0.0)))
        return self.state.select(*self.keys, mean.alias("mean"), F.when(sd < 1e-9, 1.0).otherwise(sd).alias("std"))

    def transform(self, b: DataFrame) -> DataFrame:
        return b.join(self.moments(), self.keys).withColumn("y", (F.col(self.v) - F.col("mean")) / F.col("std")).drop("mean", "std")

    def inverse_transform(self, b: DataFrame, y: str = "y") -> DataFrame:
        return b.join(self.moments(), self.keys).withColumn(self.v, F.col(y) * F.col("std") + F.col("mean")).drop("mean", "std")
