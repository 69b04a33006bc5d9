"""Tracks: midpoints, disks, places on a polyline and back, laps of a ring, and events along a track."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .shuffles import uniform


def midpoint_radius(p: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(keys, mx, my, radius): middle of the bounding box, and the mean of its half sides."""
    lo = {c: F.min(c) for c in (x, y)}
    hi = {c: F.max(c) for c in (x, y)}
    return p.groupBy(*keys).agg(((lo[x] + hi[x]) / 2).alias("mx"), ((lo[y] + hi[y]) / 2).alias("my"), ((hi[x] - lo[x] + hi[y] - lo[y]) / 4).alias("radius"))


def outside_disk(p: DataFrame, keys: list[str], share: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points further from the midpoint than a share of the radius."""
    m = midpoint_radius(p, keys, x, y)
    far = F.hypot(F.col(x) - F.col("mx"), F.col(y) - F.col("my")) > share * F.col("radius")
    return p.join(m, keys).where(far).select(*p.columns)


def on_track(lin: DataFrame, track: list[tuple[float, float]], value: str = "lin") -> DataFrame:
    """Columns x and y: the point of a polyline at a length from its start; beyond the ends the end points."""
    steps, at = [], 0.0
    for (ax, ay), (bx, by) in zip(track, track[1:]):
        length = math.hypot(bx - ax, by - ay)
        steps.append((at, length, ax, ay, (bx - ax) / length, (by - ay) / length))
        at += length
    v = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(at))
    x = y = None
    for lo, length, ax, ay, ux, uy in steps:
        here = v <= lo + length
        px, py = ax + (v - lo) * ux, ay + (v - lo) * uy
        x, y = (F.when(here, px), F.when(here, py)) if x is None else (x.when(here, px), y.when(here, py))
    lo, length, ax, ay, ux, uy = steps[-1]
    return lin.withColumn("x", x.otherwise(ax + length * ux)).withColumn("y", y.otherwise(ay + length * uy))


def laps(s: DataFrame, keys: list[str], length: float, width: float | None = None) -> DataFrame:
    """Column lap of a ring's positions (keys, t, y in [0, length)): how often the start was passed, forwards less
    backwards; in pieces of ``width``, see ``scans``, if it is given."""
    if width is not None:
        d = F.col("y") - F.col("_before.y")
        turn = F.when(d <= -length / 2, 1).when(d > length / 2, -1).otherwise(0)
        rows = scans.neighbours(scans.pieces(s, keys, "t", width), keys, "t", ["y"]).withColumn("_t", turn)
        return scans.running(rows, keys, "t", F.col("_t"), "lap").drop("_t", "_before", "_after", "_p")
    w = Window.partitionBy(*keys).orderBy("t")
    d = F.col("y") - F.lag("y").over(w)
    turn = F.when(d <= -length / 2, 1).when(d > length / 2, -1).otherwise(0)
    return s.withColumn("_t", turn).withColumn("lap", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_t")


def lap_epochs(s: DataFrame, keys: list[str], length: float, width: float | None = None) -> DataFrame:
    """(keys, lap, start, stop) of runs on one lap, the last one included."""
    if width is not None:
        return scans.stays(laps(s, keys, length, width), keys, "t", "lap", width)
    w = Window.partitionBy(*keys).orderBy("t")
    x = laps(s, keys, length).withColumn("_n", F.when(F.col("lap") != F.lag("lap").over(w), 1).otherwise(0)).withColumn("_r", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_r", "lap").agg(F.min("t").alias("start"), F.max("t").alias("stop")).drop("_r")


def turned(s: DataFrame, by: float, length: float) -> DataFrame:
    """A ring's positions counted from another origin."""
    return s.withColumn("y", F.pmod(F.col("y") - by, F.lit(length)))


def thinned(candidates: DataFrame, rate: str, most: float, seed: int, *key: str) -> DataFrame:
    """Events of an inhomogeneous law: candidates of the rate ``most`` stay with the chance rate / most."""
    return candidates.where(uniform(seed, *key) < F.col(rate) / most)


def generated(positions: DataFrame, rates: DataFrame, cell: str, dt: float, seed: int) -> DataFrame:
    """(series_id, t) of events along a track: positions (t, cell) every dt, rates (series_id, cell, rate) a second;
    a step has an event with the chance rate * dt."""
    return positions.join(rates, cell).where(uniform(seed, "series_id", "t") < F.least(F.col("rate") * dt, F.lit(1.0))).select("series_id", "t")
