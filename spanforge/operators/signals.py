"""Sampled signals (series_id, t, y); windows are partitioned by the series (and interval) keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def stats(s: DataFrame, keys: list[str]) -> DataFrame:
    """Reductions that skip nulls; the deviation is that of the population."""
    return s.groupBy(*keys).agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.median("y").alias("median"), F.min("y").alias("min"), F.max("y").alias("max"), F.count("y").alias("n"))


def zscore(s: DataFrame, keys: list[str]) -> DataFrame:
    """Null where the deviation is 0."""
    m = s.groupBy(*keys).agg(F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s"))
    return s.join(m, keys).withColumn("z", (F.col("y") - F.col("_m")) / F.when(F.col("_s") != 0, F.col("_s"))).drop("_m", "_s")


def clip(s: DataFrame, low: float, high: float) -> DataFrame:
    return s.withColumn("y", F.least(F.greatest("y", F.lit(low)), F.lit(high)))


def neighbours(s: DataFrame, keys: list[str], chunk: int | None = None) -> DataFrame:
    """Columns _before and _after: y of the samples next to each.

    With ``chunk``, windows are over stretches of time of that width (column _c); what lies across
    their edges comes from a window over one row for each stretch.
    """
    if not chunk:
        w = Window.partitionBy(*keys).orderBy("t")
        return s.withColumn("_before", F.lag("y").over(w)).withColumn("_after", F.lead("y").over(w))
    c = s.withColumn("_c", F.floor(F.col("t") / chunk))
    edge, w = Window.partitionBy(*keys).orderBy("_c"), Window.partitionBy(*keys, "_c").orderBy("t")
    ends = c.groupBy(*keys, "_c").agg(F.min(F.struct("t", "y")).alias("_lo"), F.max(F.struct("t", "y")).alias("_hi"))
    ends = ends.select(*keys, "_c", F.lag("_hi").over(edge)["y"].alias("_pe"), F.lead("_lo").over(edge)["y"].alias("_ne"))
    out = c.join(ends, [*keys, "_c"]).withColumn("_before", F.coalesce(F.lag("y").over(w), "_pe")).withColumn("_after", F.coalesce(F.lead("y").over(w), "_ne"))
    return out.drop("_pe", "_ne")


def gradient(s: DataFrame, keys: list[str], fs: float = 1.0, rectify: bool = False, chunk: int | None = None) -> DataFrame:
    """Column dy: central differences, one-sided at the ends, 0 for a single sample."""
    before, after, y = F.col("_before"), F.col("_after"), F.col("y")
    d = F.coalesce((after - before) / 2, after - y, y - before, F.lit(0.0)) * fs
    return neighbours(s, keys, chunk).withColumn("dy", F.abs(d) if rectify else d).drop("_before", "_after", "_c")


def interpolate(points: DataFrame, s: DataFrame, keys: list[str], chunk: int | None = None) -> DataFrame:
    """(keys, t, y): linear between the samples around each point, held constant beyond the ends.

    With ``chunk``, windows are over stretches of time of that width and not over whole series; the
    samples next to a stretch come from a window over one row for each stretch.
    """
    a = points.select(*keys, "t", F.lit(1).alias("_k"), F.lit(None).cast("double").alias("_y"))
    b = s.select(*keys, "t", F.lit(0).alias("_k"), F.col("y").alias("_y"))
    both = a.unionByName(b).withColumn("_x", F.when(F.col("_y").isNotNull(), F.struct("t", "_y")))
    part = [*keys]
    if chunk:
        part.append("_c")
        both = both.withColumn("_c", F.floor(F.col("t") / chunk))
        edge = Window.partitionBy(*keys).orderBy("_c")
        ends = both.groupBy(*part).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        ends = ends.select(*part, F.last("_hi", ignorenulls=True).over(edge.rowsBetween(Window.unboundedPreceding, -1)).alias("_pe"), F.first("_lo", ignorenulls=True).over(edge.rowsBetween(1, Window.unboundedFollowing)).alias("_ne"))
        both = both.join(ends, part)
    back = Window.partitionBy(*part).orderBy("t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*part).orderBy("t", F.desc("_k")).rowsBetween(0, Window.unboundedFollowing)
    p, q = F.last("_x", ignorenulls=True).over(back), F.first("_x", ignorenulls=True).over(on)
    both = both.withColumn("_p", F.coalesce(p, "_pe") if chunk else p).withColumn("_q", F.coalesce(q, "_ne") if chunk else q)
    p, q = F.col("_p"), F.col("_q")
    share = (F.col("t") - p["t"]) / (q["t"] - p["t"])
    y = F.when(p.isNull(), q["_y"]).when(q.isNull() | (q["t"] == p["t"]), p["_y"]).otherwise(p["_y"] + (q["_y"] - p["_y"]) * share)
    return both.where("_k = 1").select(*keys, "t", y.alias("y"))


def unwrap(s: DataFrame, keys: list[str], period: float, chunk: int | None = None) -> DataFrame:
    """Jumps of at least half the period are taken back by whole periods."""
    d = F.col("y") - F.col("_before")
    turn = F.when(d >= period / 2, -period).when(d < -period / 2, period).otherwise(0.0)
    part = [*keys, "_c"] if chunk else keys
    rows = neighbours(s, keys, chunk).withColumn("_t", turn)
    here = F.sum("_t").over(Window.partitionBy(*part).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    if not chunk:
        return rows.withColumn("unwrapped", F.col("y") + here).drop("_t", "_before", "_after")
    up = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*part).agg(F.sum("_t").alias("_s")).select(*part, F.coalesce(F.sum("_s").over(up), F.lit(0.0)).alias("_o"))
    return rows.join(before, part).withColumn("unwrapped", F.col("y") + F.col("_o") + here).drop("_t", "_before", "_after", "_o", "_c")


def wrap(s: DataFrame, low: float, high: float) -> DataFrame:
    return s.withColumn("y", F.pmod(F.col("y") - low, F.lit(high - low)) + low)


def add(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sum on the common grid."""
    return a.join(b.withColumnRenamed("y", "_o"), [*keys, "t"]).withColumn("y", F.col("y") + F.col("_o")).drop("_o")


def join_left(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of both; where b has a time of a, a's sample stays."""
    return a.unionByName(b.join(a.select(*keys, "t"), [*keys, "t"], "left_anti"))


def histogram(s: DataFrame, keys: list[str], width: float) -> DataFrame:
    return s.groupBy(*keys, F.floor(F.col("y") / width).alias("bin")).agg(F.count("*").alias("n"))


def cdf(s: DataFrame, keys: list[str], width: float | None = None) -> DataFrame:
    """Column p: the share of samples that are not greater; in pieces of ``width`` of y, see ``scans``, if it is given."""
    if width is not None:
        n = scans.numbered(scans.pieces(s, keys, "y", width), keys, "y", "_i", "_n")
        last = F.max("_i").over(Window.partitionBy(*keys, "_p", "y"))
        return n.withColumn("p", (last + 1) / F.col("_n")).drop("_i", "_n", "_p")
    return s.withColumn("p", F.cume_dist().over(Window.partitionBy(*keys).orderBy("y")))


def path_length(s: DataFrame, keys: list[str], x: str, y: str, width: float | None = None) -> DataFrame:
    if width is not None:
        rows = scans.neighbours(scans.pieces(s, keys, "t", width), keys, "t", [x, y])
        step = F.hypot(F.col(x) - F.col("_before")[x], F.col(y) - F.col("_before")[y])
        return rows.groupBy(*keys).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("length"))
    w = Window.partitionBy(*keys).orderBy("t")
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    return s.withColumn("_d", step).groupBy(*keys).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"))


# --- arithmetic, grids and derived signals -------------------------------------------------

def scaled(s: DataFrame, keys: list[str], center: bool = True, scale: bool = True) -> DataFrame:
    """Minus the mean and by the population deviation (0 counts as 1); moments are aggregated and joined."""
    m = s.groupBy(*keys).agg(F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s"))
    y = F.col("y") - F.col("_m") if center else F.col("y")
    y = y / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s")) if scale else y
    return s.join(m, keys).withColumn("y", y).drop("_m", "_s")


_OPERATIONS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / F.when(b != 0, b)}


def combined(a: DataFrame, b: DataFrame | float | dict, op: str, keys: list[str]) -> DataFrame:
    """A signal and a number, a number for each key's value, or a signal on the common grid; x / 0 is null."""
    f = _OPERATIONS[op]
    if isinstance(b, DataFrame):
        return a.join(b.select(*keys, "t", F.col("y").alias("_o")), [*keys, "t"]).withColumn("y", f(F.col("y"), F.col("_o"))).drop("_o")
    if isinstance(b, dict):
        of = F.create_map(*[F.lit(x) for pair in b.items() for x in pair])
        return a.withColumn("y", f(F.col("y"), of[F.col(keys[0])]))
    return a.withColumn("y", f(F.col("y"), F.lit(float(b))))


def complex_parts(s: DataFrame, re: str = "re", im: str = "im") -> DataFrame:
    """Columns abs and angle of a complex signal kept as two columns."""
    return s.withColumn("abs", F.hypot(re, im)).withColumn("angle", F.atan2(im, re))


def shifted(s: DataFrame, by: int) -> DataFrame:
    return s.withColumn("t", F.col("t") + F.lit(by))


def sampling(s: DataFrame, keys: list[str], width: float | None = None) -> DataFrame:
    """(keys, n_samples, step, first, last, low, high): step is the median distance of samples."""
    if width is None:
        d = s.withColumn("_d", F.lead("t").over(Window.partitionBy(*keys).orderBy("t")) - F.col("t"))
    else:
        d = scans.neighbours(scans.pieces(s, keys, "t", width), keys, "t", []).withColumn("_d", F.col("_after.t") - F.col("t"))
    return (d.groupBy(*keys)
            .agg(F.count("*").alias("n_samples"), F.percentile("_d", 0.5).alias("step"), F.min("t").alias("first"), F.max("t").alias("last"), F.min("y").alias("low"), F.max("y").alias("high")))


def regridded(s: DataFrame, keys: list[str], step: int, chunk: int | None = None) -> DataFrame:
    """The signal at every ``step`` from its first sample on, by linear interpolation; ``chunk``: see ``interpolate``."""
    ends = s.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    points = ends.select(*keys, F.explode(F.sequence(F.col("_a"), F.col("_b"), F.lit(step))).alias("t"))
    return interpolate(points, s, keys, chunk)


def simplified(s: DataFrame, keys: list[str], n_samples: int, chunk: int | None = None) -> DataFrame:
    """``n_samples`` samples: evenly spread places from the first sample on, and the last sample; ``chunk``: see ``interpolate``."""
    ends = s.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    k = F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))
    at = F.when(F.col("_k") == n_samples - 1, F.col("_b")).otherwise(F.col("_a") + F.floor((F.col("_b") - F.col("_a")) * F.col("_k") / (n_samples - 1)))
    points = ends.withColumn("_k", k).select(*keys, at.cast("long").alias("t")).distinct()
    return interpolate(points, s, keys, chunk)


def tumbling(s: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Fewer samples, each the mean of ``step``: a plain filter against aliasing."""
    at = (F.col("t") - F.pmod("t", F.lit(step))).cast("long")
    return s.groupBy(*keys, at.alias("t")).agg(F.avg("y").alias("y"), F.count("*").alias("n"))


def lengths(s: DataFrame, keys: list[str]) -> DataFrame:
    return s.groupBy(*keys, "interval_id").agg(F.count("*").alias("n_samples"))


def melted(s: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Several signals of one table as single ones (signal, y)."""
    return s.unpivot([*keys, "t"], columns, "signal", "y")


def with_signal(s: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A further signal on the same grid as column ``name``; every sample must be there."""
    return s.join(other.select(*keys, "t", F.col("y").alias(name)), [*keys, "t"], "left").withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit("the signals have different times"))).otherwise(F.col(name)))


def trimmed(s: DataFrame, start: int, stop: int) -> DataFrame:
    return s.where(F.col("t").between(start, stop))


def velocity(s: DataFrame, keys: list[str], x: str, y: str, fs: float = 1.0, width: float | None = None) -> DataFrame:
    """Columns speed and heading of a track, from the gradients of its two coordinates; in pieces of ``width``, see
    ``scans``, if it is given."""
    w = Window.partitionBy(*keys).orderBy("t")
    if width is not None:
        s = scans.neighbours(scans.pieces(s, keys, "t", width), keys, "t", [x, y]).drop("_p")

    def d(c: str):
        before, after, v = (F.lag(c).over(w), F.lead(c).over(w), F.col(c)) if width is None else (F.col("_before")[c], F.col("_after")[c], F.col(c))
        return F.coalesce((after - before) / 2, after - v, v - before, F.lit(0.0)) * fs

    return s.withColumn("_dx", d(x)).withColumn("_dy", d(y)).withColumn("speed", F.hypot("_dx", "_dy")).withColumn("heading", F.atan2("_dy", "_dx")).drop("_dx", "_dy", "_before", "_after")


def directions(s: DataFrame, keys: list[str], width: float | None = None) -> DataFrame:
    """(keys, direction, start, stop): runs in which the signal rises (1) or falls (-1)."""
    if width is not None:
        rows = scans.neighbours(scans.pieces(s, keys, "t", width), keys, "t", ["y"])
        before, after, y = F.col("_before.y"), F.col("_after.y"), F.col("y")
        d = F.coalesce((after - before) / 2, after - y, y - before, F.lit(0.0))
        rows = rows.withColumn("direction", F.signum(d).cast("int")).drop("_before", "_after", "_p")
        return scans.stays(rows, keys, "t", "direction", width).where("direction <> 0")
    w = Window.partitionBy(*keys).orderBy("t")
    g = gradient(s, keys).withColumn("direction", F.signum("dy").cast("int"))
    g = g.withColumn("_n", F.when(F.col("direction") != F.lag("direction").over(w), 1).otherwise(0)).withColumn("_run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*keys, "_run", "direction").agg(F.min("t").alias("start"), F.max("t").alias("stop")).where("direction <> 0").drop("_run")


def power(s: DataFrame, keys: list[str], waves: list[int]) -> DataFrame:
    """(keys, k, power): periodogram of the centred samples at k waves over the series, by sums.

    Density for one sample a unit of time; k from 1 to below half the number of samples counts twice.
    """
    n = scaled(s, keys, True, False).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1)
    size = s.groupBy(*keys).agg(F.count("*").alias("_n"))
    each = n.join(size, keys).withColumn("k", F.explode(F.array(*map(F.lit, waves)))).withColumn("_a", F.col("k") * F.col("_i") * (2 * math.pi) / F.col("_n"))
    sums = each.groupBy(*keys, "k", "_n").agg(F.sum(F.col("y") * F.cos("_a")).alias("_c"), F.sum(F.col("y") * F.sin("_a")).alias("_s"))
    twice = F.when((F.col("k") > 0) & (2 * F.col("k") < F.col("_n")), 2).otherwise(1)
    return sums.select(*keys, "k", (twice * (F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")) / F.col("_n")).alias("power"))


def in_support(points: DataFrame, s: DataFrame, iv: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, interval_id, t, y): the signal at points (keys, t), from the samples of the interval that holds the point.

    Linear between an interval's own samples and constant beyond them; never across a gap of the support,
    and nothing where an interval has no sample.
    """
    from .ranges import points_in

    spans = iv.select("interval_id", "start", "stop")
    inner = points_in(s.select(*keys, "t", "y"), spans).drop("start", "stop")
    at = points_in(points.select(*keys, "t").distinct(), spans).drop("start", "stop")
    return interpolate(at, inner, [*keys, "interval_id"]).where("y is not null")


def derivative(s: DataFrame, keys: list[str], columns: list[str], fs: float = 1.0, rectify: bool = True, norm: bool = False,
               sigma: float | None = None, truncate: float = 4.0, width: float | None = None) -> DataFrame:
    """(keys, t, columns): gradients a second of several signals (keys, t, columns), within each of keys.

    Central differences, one-sided at the ends, 0 for a single sample.  With ``norm`` they are one column,
    ``norm``, the length of the vector; ``rectify`` takes absolute values; ``sigma`` seconds of a Gaussian
    smooth the result, folded back at the ends.  ``width``: in pieces, see ``scans``.
    """
    from ..functions.timeops import gaussian_weights
    from .binned import smooth

    if width is None:
        w = Window.partitionBy(*keys).orderBy("t")
        rows = s.withColumn("_before", F.lag(F.struct(*columns)).over(w)).withColumn("_after", F.lead(F.struct(*columns)).over(w))
    else:
        rows = scans.neighbours(scans.pieces(s, keys, "t", width), keys, "t", columns)

    def d(c: str):
        before, after, y = F.col("_before")[c], F.col("_after")[c], F.col(c)
        return F.coalesce((after - before) / 2, after - y, y - before, F.lit(0.0)) * fs

    out, names = rows.select(*keys, "t", *[d(c).alias(c) for c in columns]), columns
    if norm:
        out, names = out.select(*keys, "t", F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))).alias("norm")), ["norm"]
    if rectify:
        out = out.withColumns({c: F.abs(c) for c in names})
    if sigma:
        weights = gaussian_weights(sigma * fs, truncate)
        out = scans.numbered(scans.pieces(out, keys, "t", width or 0), keys, "t", "bin_idx").drop("_p") if width is not None else out.withColumn("bin_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1)
        for c in names:
            out = smooth(out, weights, keys, v=c).withColumn(c, F.col("y")).drop("y") if c != "y" else smooth(out, weights, keys, v=c)
        out = out.drop("bin_idx")
    return out.select(*keys, "t", *names)
