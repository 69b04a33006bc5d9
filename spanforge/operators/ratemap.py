"""Tuning curves: counts by a binned covariate over the time spent there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import places


def occupancy(bins: DataFrame, axes: list[str]) -> DataFrame:
    """bins: one row for each time bin with its covariate bins."""
    return bins.groupBy(*axes).agg(F.count("*").alias("occupancy"))


def rate_map(counts: DataFrame, bins: DataFrame, axes: list[str], floor: float = 0.0) -> DataFrame:
    """(series_id, axes, occupancy, rate) from counts (series_id, t_bin, n) and bins (t_bin, axes)."""
    n = counts.join(bins, "t_bin").groupBy("series_id", *axes).agg(F.sum("n").alias("n"))
    cells = counts.select("series_id").distinct().crossJoin(occupancy(bins, axes))
    rate = F.coalesce("n", F.lit(0)) / F.greatest("occupancy", F.lit(1))
    return cells.join(n, ["series_id", *axes], "left").select("series_id", *axes, "occupancy", F.greatest(rate, F.lit(floor)).alias("rate"))


def information(r: DataFrame) -> DataFrame:
    """(series_id, mean_rate, si, info_rate, selectivity, sparsity) of occupancy-weighted rates."""
    w = Window.partitionBy("series_id")
    p = F.col("occupancy") / F.sum("occupancy").over(w)
    rows = r.withColumn("p", p).withColumn("R", F.sum(F.col("p") * F.col("rate")).over(w))
    ratio = F.col("rate") / F.col("R")
    g = rows.withColumn("_i", F.when(F.col("rate") > 0, F.col("p") * ratio * F.log2(ratio)).otherwise(0.0)).groupBy("series_id").agg(
        F.max("R").alias("mean_rate"), F.sum("_i").alias("si"), F.max("rate").alias("_m"), F.sum(F.col("p") * F.col("rate") * F.col("rate")).alias("_q"))
    return g.select("series_id", "mean_rate", "si", (F.col("si") * F.col("mean_rate")).alias("info_rate"),
                    (F.col("_m") / F.col("mean_rate")).alias("selectivity"), (F.col("mean_rate") * F.col("mean_rate") / F.col("_q")).alias("sparsity"))


def peaks(r: DataFrame, axis: str) -> DataFrame:
    """(series_id, peak, place): the first bin of the highest rate and the series' order by it."""
    top = r.groupBy("series_id").agg(F.max(F.struct("rate", (-F.col(axis)).alias("b"))).alias("m")).select("series_id", (-F.col("m.b")).alias("peak"))
    at = places(top.select(F.struct("peak", "series_id").alias("k")), "k")
    return at.select("k.series_id", "k.peak", (F.col("place") + 1).cast("int").alias("place"))


def normalised(r: DataFrame) -> DataFrame:
    return r.withColumn("rate", F.col("rate") / F.max("rate").over(Window.partitionBy("series_id")))


def directional(lr: DataFrame, rl: DataFrame, axes: list[str], least_max: float, most_mean: float) -> DataFrame:
    """Curves of the series that pass in a direction (max above, mean below); lr goes first where both do."""
    def passing(r: DataFrame) -> DataFrame:
        ok = r.groupBy("series_id").agg(F.max("rate").alias("_m"), F.avg("rate").alias("_a")).where((F.col("_m") > least_max) & (F.col("_a") < most_mean))
        return r.join(ok.select("series_id"), "series_id", "left_semi")
    a = passing(lr).withColumn("direction", F.lit("lr"))
    b = passing(rl).withColumn("direction", F.lit("rl"))
    return a.unionByName(b.join(a.select("series_id").distinct(), "series_id", "left_anti")).select("series_id", "direction", *axes, "rate")


# --- curves over any number of axes ----------------------------------------------------------

def binned_axes(rows: DataFrame, axes: dict[str, tuple[float, float, int]], right_closed: bool = False) -> DataFrame:
    """Each axis's value as its bin of n equal ones between two ends; rows outside are left out.

    Bins are closed on the left and the last one on both sides, or all on the right
    (``right_closed``) and the first one on both.
    """
    for name, (lo, hi, n) in axes.items():
        x = (F.col(name) - lo) * n / (hi - lo)
        at = F.greatest(F.ceil(x) - 1, F.lit(0)) if right_closed else F.least(F.floor(x), F.lit(n - 1))
        rows = rows.where(F.col(name).between(lo, hi)).withColumn(name, at.cast("int"))
    return rows


def covered(r: DataFrame, dt: float, min_duration: float) -> DataFrame:
    """Rates of cells in which less than ``min_duration`` was spent are 0."""
    return r.withColumn("rate", F.when(F.col("occupancy") * dt < min_duration, 0.0).otherwise(F.col("rate")))


def smoothed(r: DataFrame, axes: list[str], weights: dict[str, list[float]]) -> DataFrame:
    """Gaussian smoothing along one axis after the other, with its own kernel each.

    Cells that aren't there count for nothing: the sum is divided by the weights that fell on cells.
    """
    out = r
    for axis, kernel in weights.items():
        half = len(kernel) // 2
        step = F.explode(F.array(*[F.struct(F.lit(k - half).alias("off"), F.lit(w).alias("w")) for k, w in enumerate(kernel)]))
        others = [a for a in axes if a != axis]
        want = out.select("series_id", *others, F.col(axis).alias("_at")).withColumn("k", step)
        want = want.select("series_id", *others, "_at", (F.col("_at") + F.col("k.off")).cast("int").alias(axis), F.col("k.w").alias("_w"))
        done = (want.join(out.select("series_id", *axes, F.col("rate").alias("_v")), ["series_id", *axes])
                .groupBy("series_id", *others, F.col("_at").alias(axis)).agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("_s")))
        out = out.join(done, ["series_id", *axes]).withColumn("rate", F.col("_s")).drop("_s")
    return out


def reduced(r: DataFrame) -> DataFrame:
    """(series_id, mean, max, min, std) over the cells, each counted once."""
    return r.groupBy("series_id").agg(F.avg("rate").alias("mean"), F.max("rate").alias("max"), F.min("rate").alias("min"), F.stddev_pop("rate").alias("std"))


def combined(a: DataFrame, b: DataFrame | float, op: str, axes: list[str]) -> DataFrame:
    """A curve and a number or another curve over the same cells; x / 0 is null."""
    f = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / F.when(y != 0, y)}[op]
    if isinstance(b, DataFrame):
        return a.join(b.select("series_id", *axes, F.col("rate").alias("_o")), ["series_id", *axes]).withColumn("rate", f(F.col("rate"), F.col("_o"))).drop("_o")
    return a.withColumn("rate", f(F.col("rate"), F.lit(float(b))))


class RateMap:
    """Rates (series_id, axes, rate) with what a fitted estimator needs; all methods return tables."""

    def __init__(self, rates: DataFrame, axes: list[str]) -> None:
        self.rates, self.axes = rates, axes

    @classmethod
    def fit(cls, counts: DataFrame, bins: DataFrame, axes: list[str], dt: float = 1.0, floor: float = 0.0) -> RateMap:
        """From counts (series_id, t_bin, n) and the covariates' bins (t_bin, axes)."""
        r = rate_map(counts, bins, axes)
        return cls(r.withColumn("rate", F.greatest(F.col("rate") / dt, F.lit(floor))), axes)

    def units(self, labels: list) -> RateMap:
        return RateMap(self.rates.where(F.col("series_id").isin(labels)), self.axes)

    def smooth(self, weights: dict[str, list[float]]) -> RateMap:
        return RateMap(smoothed(self.rates, self.axes, weights), self.axes)

    def predict(self, bins: DataFrame) -> DataFrame:
        """(t_bin, series_id, rate): the rate of the cell of each time bin; cells never seen give none."""
        return bins.join(self.rates.select("series_id", *self.axes, "rate"), self.axes).select("t_bin", "series_id", "rate")

    def score_samples(self, counts: DataFrame, bins: DataFrame, dt: float = 1.0) -> DataFrame:
        """(t_bin, loglik): Poisson log likelihood of the counts, without the factorials' part."""
        seen = self.predict(bins).join(counts, ["t_bin", "series_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        mean = F.greatest(F.col("rate") * dt, F.lit(1e-12))
        return seen.groupBy("t_bin").agg(F.sum(F.col("n") * F.log(mean) - mean).alias("loglik"))

    def score(self, counts: DataFrame, bins: DataFrame, dt: float = 1.0) -> DataFrame:
        """One row: the mean log likelihood of a time bin, and how many there were."""
        return self.score_samples(counts, bins, dt).agg(F.avg("loglik").alias("score"), F.count("*").alias("n_bins"))


# --- covariates from signals ---------------------------------------------------------------------

def covariate_bins(iv: DataFrame, s: DataFrame, ds: int, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(interval_id, t_bin, t, y): a signal (t, y) at the middle of each whole bin of the support; t_bin is the bin's start.

    Values come from samples of the bin's own interval (see ``signals.in_support``).  ``transform`` may change the rows, as
    to other covariates; rows that it leaves out count neither as time nor as events.
    """
    from .binned import grid
    from .signals import in_support

    middle = grid(iv, ds).select((F.col("bin_start") + F.lit(ds / 2)).alias("t"), F.col("bin_start").alias("t_bin"))
    at = in_support(middle, s.select(F.col("t").cast("double").alias("t"), "y"), iv, [])
    rows = at.join(middle, "t").select("interval_id", "t_bin", "t", "y")
    return rows if transform is None else transform(rows)


def map_of_signal(b: DataFrame, iv: DataFrame, s: DataFrame, ds: int, axes: dict[str, tuple[float, float, int]], floor: float = 0.0,
                  transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(series_id, axes, occupancy, rate) of bins (series_id, bin_start, n) by a signal's binned value; axes: see ``binned_axes``."""
    bins = binned_axes(covariate_bins(iv, s, ds, transform), axes).select("t_bin", *axes)
    return rate_map(b.select("series_id", F.col("bin_start").alias("t_bin"), "n"), bins, list(axes), floor)
