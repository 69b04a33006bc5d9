"""Runs of samples beyond thresholds, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .events import restrict


def runs(s: DataFrame, keys: list[str], index: str, flag: Column, value: Column, width: float | None = None) -> DataFrame:
    """(keys, first, last, best, n): maximal runs of n consecutive rows where the flag holds.

    With ``width``, series are worked through in pieces (see ``scans``): stretches of that width of the
    index, or ranges of rows if it is 0.
    """
    if width is not None:
        return scans.islands(scans.pieces(s, keys, index, width), keys, index, flag, value)
    w = Window.partitionBy(*keys).orderBy(index)
    rows = s.withColumn("_f", flag).withColumn("_v", value)
    rows = rows.withColumn("_g", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_f")
    return rows.groupBy(*keys, "_g").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.max("_v").alias("best"), F.count("*").alias("n")).drop("_g")


def crossings(s: DataFrame, keys: list[str], index: str, value: str, threshold: float | Column, mode: str = "above", width: float | None = None) -> DataFrame:
    x = F.col(value)
    return runs(s, keys, index, x >= threshold if mode == "above" else x <= threshold, x, width).drop("n")


def boundaries(s: DataFrame, keys: list[str], index: str, value: str, sigmas: float = 3.0, least_primary: int = 1, least: int = 1, most: int = 10**9, width: float | None = None,
               primary: float | None = None, secondary: float | None = None, mode: str = "above") -> DataFrame:
    """Runs beyond ``secondary`` that hold a run beyond ``primary``, with length limits in samples; ``best`` is the most extreme value.

    The thresholds are the mean + sigmas deviations (``below``: less them) and the mean, where none are given.

    A high run belongs to the last low run that starts at or before it; where one sample is
    enough, a low run's maximum says whether it has a high one.
    """
    sign = 1 if mode == "above" else -1
    x = sign * F.col(value).cast("double")
    moments = s.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    hi = F.col("_m") + sigmas * F.col("_s") if primary is None else F.lit(sign * primary)
    level = s.join(moments, keys).withColumn("_hi", x >= hi)
    low = runs(level, keys, index, x >= (F.col("_m") if secondary is None else F.lit(sign * secondary)), F.struct(F.col("_hi").cast("int").alias("hi"), x.alias("x")), width)
    low = low.select(*keys, F.col("first").alias("start"), F.col("last").alias("stop"), (sign * F.col("best.x")).alias("best"), F.col("best.hi").alias("_hit"), "n")
    fit = F.col("n").between(least, most)
    if least_primary <= 1:
        return low.where((F.col("_hit") == 1) & fit).drop("_hit", "n")
    high = runs(level, keys, index, F.col("_hi"), x, width).where(F.col("n") >= least_primary).select(*keys, F.col("first").alias("start"), F.lit(1).alias("_k"), F.lit(None).alias("_x"))
    both = low.select(*keys, "start", F.lit(0).alias("_k"), F.struct("start", "stop", "best", "n").alias("_x")).unionByName(high)
    last = F.last("_x", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("start", "_k").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_x", last).where("_k = 1").select(*keys, "_x.*").distinct()
    return found.where(fit).drop("n")


# --- population bursts ------------------------------------------------------------------------

def population_rate(ev: DataFrame, iv: DataFrame, ds: int, weights: list[float] | None = None, second: int = 1_000_000) -> DataFrame:
    """(interval_id, bin_idx, bin_start, rate): events of all series a second in bins of ds, smoothed."""
    from . import binned

    inside = restrict(ev, iv).withColumn("bin_idx", F.floor((F.col("t") - F.col("start")) / ds).cast("int"))
    some = inside.groupBy("interval_id", "bin_idx").agg(F.count("*").alias("n"))
    b = binned.grid(iv, ds).join(some, ["interval_id", "bin_idx"], "left").withColumn("rate", F.coalesce("n", F.lit(0)) * (second / ds)).drop("n")
    if weights is None:
        return b
    return binned.smooth(b, weights, ["interval_id"], v="rate").withColumn("rate", F.col("y")).drop("y")


def bursts(rate: DataFrame, ds: int, sigmas: float = 3.0, least: int = 1, most: int = 10**15) -> DataFrame:
    """(interval_id, start, stop, best): runs of the rate above its mean over all bins that reach mean + sigmas
    deviations, of a duration from ``least`` to ``most``; stop is the start of the last bin."""
    level = rate.agg(F.avg("rate").alias("_m"), F.stddev_pop("rate").alias("_s"))  # one row
    x = rate.join(F.broadcast(level), how="cross")
    rows = x.withColumn("_hi", F.col("rate") >= F.col("_m") + sigmas * F.col("_s"))
    outer = runs(rows, ["interval_id"], "bin_idx", F.col("rate") >= F.col("_m"), F.struct(F.col("_hi").cast("int").alias("hi"), F.col("rate").alias("rate")))
    found = outer.where("best.hi = 1").select("interval_id", "first", "last", F.col("best.rate").alias("best"))
    size = (F.col("last") - F.col("first") + 1).cast("long") * F.lit(ds)
    found = found.where(size.between(least, most))
    at = rate.select("interval_id", "bin_idx", "bin_start")
    return (found.join(at.select("interval_id", F.col("bin_idx").alias("first"), F.col("bin_start").alias("start")), ["interval_id", "first"])
            .join(at.select("interval_id", F.col("bin_idx").alias("last"), F.col("bin_start").alias("stop")), ["interval_id", "last"])
            .select("interval_id", "start", "stop", "best"))


def population_bursts(ev: DataFrame, iv: DataFrame, ds: int, weights: list[float], min_active: int, unsorted=None, **limits) -> DataFrame:
    """(interval_id, start, stop, n_active): bursts of the population in which more than ``min_active`` series
    are active, those of ``unsorted`` not counted."""
    b = bursts(population_rate(ev, iv, ds, weights), ds, **limits)
    spans = b.select("interval_id", "start", "stop")
    own = ev if unsorted is None else ev.where(F.col("series_id") != unsorted)
    inside = restrict(own, spans, closed_right=True)
    return inside.groupBy("interval_id", "start", "stop").agg(F.countDistinct("series_id").alias("n_active")).where(F.col("n_active") > min_active)


def epochs(s: DataFrame, keys: list[str], threshold: float, mode: str = "above", second: float | None = None, step: int = 1, width: float | None = None) -> DataFrame:
    """(keys, start, stop): runs of samples (keys, t, y) beyond ``second`` that reach ``threshold``; half-open.

    ``second`` is the threshold itself if it isn't given; run epochs are 10 and 8 above, inactive ones 5 and 7 below.
    """
    y, sign = F.col("y"), 1 if mode == "above" else -1
    low = threshold if second is None else second
    found = runs(s, keys, "t", sign * y >= sign * low, sign * y, width)
    return found.where(F.col("best") >= sign * threshold).select(*keys, F.col("first").alias("start"), (F.col("last") + step).alias("stop"))


def stretched(ranges: DataFrame, step: float) -> DataFrame:
    """(start, stop, x): floor of length / step even points from start on; they are further apart if the length isn't divisible."""
    n = F.floor((F.col("stop") - F.col("start")) / step)
    return (ranges.where(n > 0).withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
            .select("start", "stop", (F.col("start") + F.col("_k") * (F.col("stop") - F.col("start")) / F.col("_n")).alias("x")))


def zoomed(m: DataFrame, n_cols: int, wanted: int) -> DataFrame:
    """A matrix (row, col, v) of n_cols columns at ``wanted`` even places between its first and last column."""
    at = F.col("k") * ((n_cols - 1) / max(wanted - 1, 1))
    rows = m.select("row").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(wanted - 1)))).withColumn("_x", at)
    lo = F.least(F.floor("_x"), F.lit(n_cols - 1)).cast("int")
    rows = rows.withColumn("_lo", lo).withColumn("_hi", F.least(lo + 1, F.lit(n_cols - 1)))
    a = m.select("row", F.col("col").alias("_lo"), F.col("v").alias("_a"))
    b = m.select("row", F.col("col").alias("_hi"), F.col("v").alias("_b"))
    return rows.join(a, ["row", "_lo"]).join(b, ["row", "_hi"]).select("row", F.col("k").alias("col"), (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_x") - F.col("_lo"))).alias("v"))
