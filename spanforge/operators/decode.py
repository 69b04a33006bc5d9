"""Poisson Bayesian decoding of counts against a rate map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def posterior(counts: DataFrame, rates: DataFrame, axis: str, dt: float = 1.0) -> DataFrame:
    """(t_bin, axis, p): sum of n ln(rate) less dt times the summed rate, normalised by log-sum-exp.

    counts: (series_id, t_bin, n), dense; rates: (series_id, axis, rate) with positive rates.
    Bins without any count are left out.
    """
    total = rates.groupBy(axis).agg(F.sum("rate").alias("_r"))
    live = counts.where("n > 0")
    ll = (live.join(rates.withColumn("_l", F.log("rate")), "series_id").groupBy("t_bin", axis)
          .agg(F.sum(F.col("n") * F.col("_l")).alias("_s")).join(total, axis).withColumn("lp", F.col("_s") - dt * F.col("_r")))
    w = Window.partitionBy("t_bin")
    e = ll.withColumn("_e", F.exp(F.col("lp") - F.max("lp").over(w)))
    return e.select("t_bin", axis, (F.col("_e") / F.sum("_e").over(w)).alias("p"))


def mode_path(post: DataFrame, axis: str) -> DataFrame:
    """The first bin of the greatest chance."""
    return post.groupBy("t_bin").agg(F.max(F.struct(F.round("p", 9).alias("p"), (-F.col(axis)).alias("b"))).alias("m")).select("t_bin", (-F.col("m.b")).alias("mode"))


def mean_path(post: DataFrame, axis: str, offset: float = 0.5) -> DataFrame:
    return post.groupBy("t_bin").agg(F.sum(F.col("p") * (F.col(axis) + offset)).alias("mean"))


def rmse(decoded: DataFrame, truth: DataFrame, value: str) -> DataFrame:
    d = decoded.join(truth, "t_bin")
    return d.agg(F.sqrt(F.avg(F.pow(F.col(value) - F.col("x"), 2))).alias("rmse"), F.count("*").alias("n"))


def error_cdf(decoded: DataFrame, truth: DataFrame, value: str) -> DataFrame:
    """(error, share): cumulative shares of whole absolute errors."""
    e = decoded.join(truth, "t_bin").groupBy(F.abs(F.col(value) - F.col("x")).alias("error")).agg(F.count("*").alias("n"))
    up = Window.orderBy("error").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("error", (F.sum("n").over(up) / F.sum("n").over(Window.partitionBy())).alias("share"))


# --- any number of axes, windows of several bins, and cross-validation ------------------------

def windowed(counts: DataFrame, group: str, w: int, partial: bool = False) -> DataFrame:
    """Sums over w neighbouring time bins of a group, one for each first bin with a whole window.

    counts: (series_id, group, t_bin, n), dense.  With ``partial``, a group of fewer than w bins has one
    window of all its bins, at the first of them.
    """
    by = Window.partitionBy("series_id", group)
    on = by.orderBy("t_bin").rowsBetween(0, w - 1)
    rows = counts.withColumn("_n", F.sum("n").over(on)).withColumn("_c", F.count("*").over(on))
    whole = F.col("_c") == w
    if partial:
        rows = rows.withColumn("_size", F.count("*").over(by)).withColumn("_first", F.min("t_bin").over(by))
        whole = whole | ((F.col("_size") < w) & (F.col("t_bin") == F.col("_first")))
    return rows.where(whole).select("series_id", group, "t_bin", F.col("_n").alias("n"))


def posterior_nd(counts: DataFrame, rates: DataFrame, axes: list[str], dt: float = 1.0, w: int = 1, uniform_if_empty: bool = False) -> DataFrame:
    """(t_bin, axes, p) as ``posterior``, over any axes and for windows of w bins.

    Windows without any count are left out, or get the same chance in every cell.
    """
    total = rates.groupBy(*axes).agg(F.sum("rate").alias("_r"))
    live = counts.where("n > 0")
    ll = (live.join(rates.withColumn("_l", F.log("rate")), "series_id").groupBy("t_bin", *axes)
          .agg(F.sum(F.col("n") * F.col("_l")).alias("_s")).join(total, axes).withColumn("lp", F.col("_s") - dt * w * F.col("_r")))
    by = Window.partitionBy("t_bin")
    e = ll.withColumn("_e", F.exp(F.col("lp") - F.max("lp").over(by)))
    out = e.select("t_bin", *axes, (F.col("_e") / F.sum("_e").over(by)).alias("p"))
    if not uniform_if_empty:
        return out
    empty = counts.groupBy("t_bin").agg(F.sum("n").alias("_n")).where("_n = 0").select("t_bin")
    cells = total.select(*axes).crossJoin(total.agg((1 / F.count("*")).alias("p")))
    return out.unionByName(empty.crossJoin(F.broadcast(cells)).select("t_bin", *axes, "p"))  # cells: the rate map's size


def mode_nd(post: DataFrame, axes: list[str]) -> DataFrame:
    """(t_bin, axes): the least of the cells with the greatest chance."""
    best = F.max(F.struct(F.round("p", 9).alias("p"), *[(-F.col(a)).alias(a) for a in axes]))
    return post.groupBy("t_bin").agg(best.alias("m")).select("t_bin", *[(-F.col("m")[a]).alias(a) for a in axes])


def mean_nd(post: DataFrame, axes: list[str], offset: float = 0.5) -> DataFrame:
    """(t_bin, axes): the expected place along each axis, in bins."""
    return post.groupBy("t_bin").agg(*[F.sum(F.col("p") * (F.col(a) + offset)).alias(a) for a in axes])


def quantile_of(cdf: DataFrame, shares: list[float]) -> DataFrame:
    """(share, error): the inverse of a cumulative curve (error, share) from (0, 0), linear between its points."""
    at = F.explode(F.array(*map(F.lit, shares)))
    w = Window.orderBy("error")  # a cumulative curve has a row for each of its few hundred bins
    seg = cdf.select("error", "share").withColumn("_e", F.coalesce(F.lag("error").over(w), F.lit(0.0))).withColumn("_s", F.coalesce(F.lag("share").over(w), F.lit(0.0)))
    hit = seg.withColumn("q", at).where("q > _s and q <= share")
    return hit.select(F.col("q").alias("share"), (F.col("_e") + (F.col("error") - F.col("_e")) * (F.col("q") - F.col("_s")) / (F.col("share") - F.col("_s"))).alias("error"))


def cross_validated(counts: DataFrame, bins: DataFrame, axis: str, fold: Column, k: int, floor: float = 0.01, dt: float = 1.0, decoder=None) -> DataFrame:
    """(fold, t_bin, mean, x): each fold decoded with the rates of all others.

    ``fold`` is a column of ``bins`` from 0 to k - 1.  Rates of all folds come from one pass: those
    of a fold are all counts and occupancies less its own.  ``decoder`` may replace ``posterior_nd``.
    """
    b = bins.withColumn("fold", fold)
    of = b.groupBy("fold", axis).agg(F.count("*").alias("o"))
    nf = counts.join(b, "t_bin").groupBy("series_id", "fold", axis).agg(F.sum("n").alias("m"))
    folds = b.select("fold").distinct()
    cells = folds.join(of.groupBy(axis).agg(F.sum("o").alias("all_o")), how="cross").join(of, ["fold", axis], "left")
    cells = cells.withColumn("occ", F.col("all_o") - F.coalesce("o", F.lit(0))).where("occ > 0")
    every = nf.groupBy("series_id", axis).agg(F.sum("m").alias("all_m"))
    rates = (counts.select("series_id").distinct().crossJoin(cells.select("fold", axis, "occ")).join(every, ["series_id", axis], "left").join(nf, ["series_id", "fold", axis], "left")
             .withColumn("rate", F.greatest((F.coalesce("all_m", F.lit(0)) - F.coalesce("m", F.lit(0))) / F.col("occ") / dt, F.lit(floor))))
    live = counts.join(b.select("t_bin", "fold"), "t_bin")
    found = (decoder or _by_fold)(live, rates.select("series_id", "fold", axis, "rate"), axis, dt)
    mean = found.groupBy("fold", "t_bin").agg(F.sum(F.col("p") * (F.col(axis) + 0.5)).alias("mean"))
    return mean.join(b.select("fold", "t_bin", F.col(axis).alias("x")), ["fold", "t_bin"])


def _by_fold(counts: DataFrame, rates: DataFrame, axis: str, dt: float) -> DataFrame:
    total = rates.groupBy("fold", axis).agg(F.sum("rate").alias("_r"))
    ll = (counts.where("n > 0").join(rates.withColumn("_l", F.log("rate")), ["series_id", "fold"]).groupBy("fold", "t_bin", axis)
          .agg(F.sum(F.col("n") * F.col("_l")).alias("_s")).join(total, ["fold", axis]).withColumn("lp", F.col("_s") - dt * F.col("_r")))
    by = Window.partitionBy("fold", "t_bin")
    e = ll.withColumn("_e", F.exp(F.col("lp") - F.max("lp").over(by)))
    return e.select("fold", "t_bin", axis, (F.col("_e") / F.sum("_e").over(by)).alias("p"))


class BayesianDecoder:
    """Fit once on counts and covariates, then decode other counts."""

    def __init__(self, axes: list[str], dt: float = 1.0, w: int = 1, floor: float = 0.01) -> None:
        self.axes, self.dt, self.w, self.floor = axes, dt, w, floor

    def fit(self, counts: DataFrame, bins: DataFrame) -> BayesianDecoder:
        from .ratemap import RateMap

        self.map = RateMap.fit(counts, bins, self.axes, self.dt, self.floor)
        return self

    def predict_proba(self, counts: DataFrame) -> DataFrame:
        return posterior_nd(counts, self.map.rates, self.axes, self.dt, self.w)

    def predict(self, counts: DataFrame, mode: str = "mean") -> DataFrame:
        return (mean_nd if mode == "mean" else mode_nd)(self.predict_proba(counts), self.axes)

    def score(self, counts: DataFrame, bins: DataFrame) -> DataFrame:
        return self.map.score(counts, bins, self.dt)
