"""Reproducible shuffles of bins and events, scores of trajectories, and their chance level.

Random order comes from the md5 of a seed and the row's keys, so that a shuffle is the same in
every run and partitioning, and other engines can repeat it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drawn(seed: int | Column, *cols: str | Column) -> Column:
    """A text that orders rows at random."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("/", seed.cast("string"), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def uniform(seed: int | Column, *cols: str | Column) -> Column:
    """A number from 0 to below 1."""
    return F.conv(F.substring(drawn(seed, *cols), 1, 8), 16, 10).cast("double") / 2.0**32


def fine_uniform(seed: int | Column, *cols: str | Column) -> Column:
    """The same in steps of 2**-52."""
    return F.conv(F.substring(drawn(seed, *cols), 1, 13), 16, 10).cast("double") / 2.0**52


def time_swapped(b: DataFrame, seed: int, pooled: bool = False) -> DataFrame:
    """Bins (series_id, interval_id, bin_idx, n) in random order within each interval, all series alike;
    or dealt over the bins of all intervals (``pooled``)."""
    bins = b.select("interval_id", "bin_idx").distinct().withColumn("_d", drawn(seed, "interval_id", "bin_idx"))
    if not pooled:
        w = Window.partitionBy("interval_id")
        to = bins.withColumn("new_idx", (F.row_number().over(w.orderBy("_d", "bin_idx")) - 1).cast("int"))
        return b.join(to.drop("_d"), ["interval_id", "bin_idx"]).select("series_id", "interval_id", F.col("new_idx").alias("bin_idx"), "n")
    from .selection import places

    own = places(bins.withColumn("k", F.struct("interval_id", "bin_idx")), "k").select("k.*", "place")
    new = places(bins.withColumn("k", F.struct("_d", "interval_id", "bin_idx")), "k").select(F.col("k.interval_id").alias("_i"), F.col("k.bin_idx").alias("_b"), "place")
    to = own.join(new, "place").drop("place")
    return (b.withColumnsRenamed({"interval_id": "_i", "bin_idx": "_b"}).join(to, ["_i", "_b"]).select("series_id", "interval_id", "bin_idx", "n"))


def series_swapped(b: DataFrame, seed: int) -> DataFrame:
    """Series change their names within each interval, at random."""
    w = Window.partitionBy("interval_id")
    who = b.select("interval_id", "series_id").distinct()
    old = who.withColumn("_k", F.row_number().over(w.orderBy("series_id")))
    new = who.withColumn("_d", drawn(seed, "interval_id", "series_id")).withColumn("_k", F.row_number().over(w.orderBy("_d", "series_id")))
    to = old.join(new.select("interval_id", "_k", F.col("series_id").alias("new_id")), ["interval_id", "_k"]).drop("_k")
    return b.join(to, ["interval_id", "series_id"]).select(F.col("new_id").alias("series_id"), "interval_id", "bin_idx", "n")


def events_swapped(ev: DataFrame, group: str, seed: int) -> DataFrame:
    """Events (event_id, group, series_id, t) of a group exchange their series at random; times and counts stay."""
    w = Window.partitionBy(group)
    at = ev.withColumn("_k", F.row_number().over(w.orderBy("event_id")))
    who = ev.select(group, "series_id", F.row_number().over(w.orderBy(drawn(seed, "event_id"), "event_id")).alias("_k"))
    return at.drop("series_id").join(who, [group, "_k"]).drop("_k")


def _likely(mean: float) -> tuple[int, np.ndarray]:
    """(k, chances that a Poisson number is at most k, k + 1, ...): all but about 1e-30 of the law."""
    reach = 12 * math.sqrt(mean) + 40
    k = np.arange(max(0, int(mean - reach)), int(mean + reach) + 2)
    # ln k! of the first place, then sums of logarithms
    log_factorial = math.lgamma(k[0] + 1) + np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))
    return int(k[0]), np.cumsum(np.exp(k * math.log(mean) - mean - log_factorial))


@F.pandas_udf(T.LongType())
def poisson_count(mean: pd.Series, u: pd.Series) -> pd.Series:
    """How many of the cumulative chances of the Poisson law of that mean are at most u: a draw by inversion, for any mean."""
    out = np.zeros(len(mean), np.int64)
    m, x = mean.to_numpy(float), u.to_numpy(float)
    for one in np.unique(m[m > 0]):
        at = np.flatnonzero(m == one)
        first, below = _likely(float(one))
        out[at] = first + np.searchsorted(below, x[at], "right")
    return pd.Series(out)


def poisson_surrogate(b: DataFrame, seed: int) -> DataFrame:
    """Counts drawn from a Poisson law with each series' mean in each interval."""
    mean = b.groupBy("series_id", "interval_id").agg(F.avg("n").alias("_m"))
    u = fine_uniform(seed, "series_id", "interval_id", "bin_idx")
    return b.drop("n").join(mean, ["series_id", "interval_id"]).withColumn("n", poisson_count("_m", u)).drop("_m")


def shuffled_transitions(trans: DataFrame, seed: int, by: str = "i") -> DataFrame:
    """Chances off the diagonal in random order in each row (by i) or column (by j)."""
    other = "j" if by == "i" else "i"
    off = trans.where("i <> j")
    w = Window.partitionBy(by)
    a = off.select("i", "j", F.row_number().over(w.orderBy(other)).alias("_k"))
    p = off.select(by, "p", F.row_number().over(w.orderBy(drawn(seed, "i", "j"), other)).alias("_k"))
    return a.join(p, [by, "_k"]).select("i", "j", "p").unionByName(trans.where("i = j").select("i", "j", "p"))


def line_of(path: DataFrame) -> DataFrame:
    """(interval_id, slope, intercept, r2) of a path (interval_id, bin_idx, x) by least squares."""
    return path.groupBy("interval_id").agg(F.regr_slope("x", "bin_idx").alias("slope"), F.regr_intercept("x", "bin_idx").alias("intercept"), F.regr_r2("x", "bin_idx").alias("r2"))


def trajectory_score(post: DataFrame, lines: DataFrame, n_cells: int, reach: int = 0, normalize: bool = False) -> DataFrame:
    """(interval_id, score): chances (interval_id, bin_idx, cell, p) within ``reach`` cells of a line around a ring."""
    at = F.round(F.col("slope") * F.col("bin_idx") + F.col("intercept")).cast("long")
    near = F.pmod(F.col("cell") - at + reach, F.lit(n_cells)) <= 2 * reach
    s = post.join(lines, "interval_id").groupBy("interval_id").agg(F.sum(F.when(near, F.col("p")).otherwise(0.0)).alias("score"), F.countDistinct("bin_idx").alias("_n"))
    return s.select("interval_id", (F.col("score") / F.col("_n") if normalize else F.col("score")).alias("score"))


def best_line(post: DataFrame, n_cells: int, n_lines: int, reach: int, seed: int) -> DataFrame:
    """(interval_id, slope, intercept, score): of ``n_lines`` random lines through each interval's middle the one
    with the highest mean chance within ``reach`` cells; bins where it leaves the track count their median.

    A line is an angle and a distance from the middle; lines are drawn for each interval anew.
    """
    near = post.select("interval_id", "bin_idx", "cell", "p", F.sum("p").over(Window.partitionBy("interval_id", "bin_idx").orderBy("cell").rangeBetween(-reach, reach)).alias("_q"))
    mid = post.groupBy("interval_id", "bin_idx").agg(F.median("p").alias("_med"))
    size = mid.groupBy("interval_id").agg((F.max("bin_idx") + 1).alias("_n"))
    k = F.explode(F.sequence(F.lit(0), F.lit(n_lines - 1)))
    phi = (uniform(seed, "interval_id", "k") - 0.5) * math.pi
    half = F.sqrt(F.pow(F.col("_n"), 2) + F.lit(float(n_cells) ** 2)) / 2
    lines = (size.withColumn("k", k).withColumn("_phi", phi).withColumn("_rho", (uniform(seed + 1, "interval_id", "k") - 0.5) * 2 * half)
             .withColumn("slope", F.tan("_phi")).withColumn("intercept", (n_cells - 1) / 2 + F.col("_rho") / F.cos("_phi") - F.col("slope") * (F.col("_n") - 1) / 2))
    at = lines.select("interval_id", "k", "slope", "intercept", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("bin_idx"))
    at = at.withColumn("cell", F.round(F.col("slope") * F.col("bin_idx") + F.col("intercept")).cast("int"))
    hit = at.join(near.select("interval_id", "bin_idx", "cell", "_q"), ["interval_id", "bin_idx", "cell"], "left").join(mid, ["interval_id", "bin_idx"], "left")
    s = hit.groupBy("interval_id", "k").agg(F.avg(F.coalesce("_q", "_med", F.lit(0.0))).alias("score"), F.first("slope").alias("slope"), F.first("intercept").alias("intercept"))
    best = s.groupBy("interval_id").agg(F.max(F.struct("score", (-F.col("k")).alias("k"), "slope", "intercept")).alias("m"))
    return best.select("interval_id", "m.slope", "m.intercept", "m.score")


def consecutive_above(pvals: DataFrame, q: float, n: int) -> DataFrame:
    """(interval_id, longest, passes, trailing): the most consecutive bins with p above q, whether they are at
    least n, and whether the last bins alone are."""
    from .detect import runs

    r = runs(pvals, ["interval_id"], "bin_idx", F.col("p") > q, F.col("p")).withColumn("len", F.col("last") - F.col("first") + 1)
    end = pvals.groupBy("interval_id").agg(F.max("bin_idx").alias("_e"))
    g = end.join(r, "interval_id", "left").groupBy("interval_id").agg(F.coalesce(F.max("len"), F.lit(0)).alias("longest"), F.coalesce(F.max(F.when(F.col("last") == F.col("_e"), F.col("len"))), F.lit(0)).alias("_t"))
    return g.select("interval_id", "longest", (F.col("longest") >= n).alias("passes"), (F.col("_t") >= n).alias("trailing"))


def against_null(score: DataFrame, null: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, p, z): share of null scores that reach it, and its distance from their mean in deviations."""
    n = null.select(*keys, F.col("score").alias("_s"))
    g = score.join(n, keys).groupBy(*keys, "score").agg(((F.count_if(F.col("_s") >= F.col("score")) + 1) / (F.count("*") + 1)).alias("p"), F.avg("_s").alias("_m"), F.stddev_pop("_s").alias("_d"))
    return g.select(*keys, "score", "p", ((F.col("score") - F.col("_m")) / F.when(F.col("_d") > 0, F.col("_d"))).alias("z"))


def bottleneck(p: np.ndarray, subsets: np.ndarray) -> float:
    """The least flow out of a set of states with at most half the stationary weight, over that weight."""
    from .markov import steady_state

    pi = steady_state(p)
    flow = pi[:, None] * p
    weight = subsets @ pi
    out = np.einsum("ki,ij,kj->k", subsets, flow, ~subsets)
    ok = (weight > 0) & (weight <= 0.5 + 1e-12)
    return float((out[ok] / weight[ok]).min()) if ok.any() else 1.0


def line_shuffles(path: DataFrame, n: int, seed: int) -> DataFrame:
    """(interval_id, shuffle, r2) of a path (interval_id, bin_idx, x) whose places are dealt to its bins at random, n times;
    shuffle 0 is the path itself.  Null where x doesn't vary."""
    rows = path.where("x is not null").withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(n))))
    w = Window.partitionBy("interval_id", "shuffle")
    a = rows.withColumn("_k", F.row_number().over(w.orderBy("bin_idx")))
    b = rows.select("interval_id", "shuffle", F.col("bin_idx").alias("_to"), F.row_number().over(w.orderBy(F.when(F.col("shuffle") > 0, drawn(seed, "shuffle", "interval_id", "bin_idx")), "bin_idx")).alias("_k"))
    return a.join(b, ["interval_id", "shuffle", "_k"]).groupBy("interval_id", "shuffle").agg(F.regr_r2("x", "_to").alias("r2"))
