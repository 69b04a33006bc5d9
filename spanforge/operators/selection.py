"""Picking intervals, series and bins by label or by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .events import restrict


def _sliced(place: str, pick: slice, n: str):
    """Condition on a place from 0 of n (a column); negative bounds count from the end, steps are positive."""
    if (step := pick.step or 1) < 1:
        raise ValueError("rows have no order of their own, so they can't be picked backwards")
    bound = lambda x: F.lit(x) if x >= 0 else F.greatest(F.col(n) + x, F.lit(0))
    lo = bound(pick.start or 0)
    ok = (F.col(place) >= lo) & ((F.col(place) - lo) % step == 0)
    return ok if pick.stop is None else ok & (F.col(place) < bound(pick.stop))


def places(df: DataFrame, key: str, total: str | None = None) -> DataFrame:
    """(key, place): the distinct keys in order, from 0, and their number as ``total``.

    Ranges of keys are written once, and counted; so no task sees all keys.
    """
    return scans.numbered(scans.pieces(df.select(key).distinct(), [], key), [], key, "place", total).select(key, "place", *([total] if total else []))


def series_by_label(ev: DataFrame, labels: list | None = None, first=None, last=None) -> DataFrame:
    """Rows of the series that are listed, or of those from first to last label, both included."""
    if labels is not None:
        return ev.where(F.col("series_id").isin(labels))
    ok = F.lit(True)
    if first is not None:
        ok = ok & (F.col("series_id") >= first)
    return ev.where(ok if last is None else ok & (F.col("series_id") <= last))


def series_by_place(ev: DataFrame, pick: slice) -> DataFrame:
    """Rows of the series at these places in the order of their labels."""
    return ev.join(places(ev, "series_id", "_n").where(_sliced("place", pick, "_n")).select("series_id"), "series_id", "left_semi")


def intervals_by_place(iv: DataFrame, keys: list[str], pick: slice) -> DataFrame:
    """Intervals at these places in the order of their starts, within each set."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    n = iv.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return n.where(_sliced("_i", pick, "_n")).drop("_i", "_n")


def selected(ev: DataFrame, iv: DataFrame, bucket: int | None = None, labels: list | None = None) -> DataFrame:
    """Events of some series inside some intervals, each once."""
    own = ev if labels is None else series_by_label(ev, labels)
    return own.join(restrict(own.select("event_id", "t"), iv, bucket).select("event_id").distinct(), "event_id", "left_semi")


def reordered(series: DataFrame, labels: list) -> DataFrame:
    """(series_id, place): listed labels in their order from 0; others are left out."""
    return series.select("series_id").distinct().withColumn("place", F.array_position(F.array(*map(F.lit, labels)), F.col("series_id")) - 1).where("place >= 0")


def with_empty(counts: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """Series without any row get one with 0."""
    return series.select("series_id").distinct().join(counts, "series_id", "left").withColumn(value, F.coalesce(value, F.lit(0)))


def bins_by_index(b: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Bins first to last (both included) of each pair, numbered over all intervals in order, as new intervals."""
    grid = b.select("interval_id", "bin_idx").distinct()
    at = places(grid.withColumn("k", F.struct("interval_id", "bin_idx")), "k").select("k.*", "place")
    pick = F.explode(F.array(*[F.struct(F.lit(i).alias("piece"), F.lit(a).alias("lo"), F.lit(z).alias("hi")) for i, (a, z) in enumerate(pairs)]))
    cut = at.withColumn("p", pick).where("place between p.lo and p.hi").select("interval_id", "bin_idx", "p.piece", (F.col("place") - F.col("p.lo")).cast("int").alias("new_idx"))
    return b.join(cut, ["interval_id", "bin_idx"]).select("series_id", F.col("piece").alias("interval_id"), F.col("new_idx").alias("bin_idx"), "n")


def sample_ranges(s: DataFrame, iv: DataFrame, bucket: int | None = None, width: float = 0) -> DataFrame:
    """(series_id, interval_id, first, last): numbers of the samples inside each interval; pieces of ``width``, see ``scans``."""
    n = scans.numbered(scans.pieces(s, ["series_id"], "t", width), ["series_id"], "t", "i").drop("_p")
    return restrict(n, iv, bucket).groupBy("series_id", "interval_id").agg(F.min("i").alias("first"), F.max("i").alias("last"))


def partitioned(s: DataFrame, iv: DataFrame, n: int | None = None, ds: int | None = None) -> DataFrame:
    """Events or samples with the piece (interval_id, piece, start, stop) of the support that holds them: each interval cut
    into n equal pieces, or into pieces of ``ds`` with the rest last."""
    length = F.col("stop") - F.col("start")
    step = F.lit(ds) if ds else F.ceil(length / n).cast("long")
    count = F.greatest(F.ceil(length / step).cast("int"), F.lit(1))
    cut = (iv.select("interval_id", "start", "stop").withColumn("_w", step).withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
           .select("interval_id", "piece", (F.col("start") + F.col("piece") * F.col("_w")).alias("start"), F.least(F.col("start") + (F.col("piece") + 1) * F.col("_w"), "stop").alias("stop")))
    return restrict(s, cut)


def sliced(s: DataFrame, iv: DataFrame, intervals: slice | list | None = None, series: slice | list | None = None) -> DataFrame:
    """Samples of some series inside some intervals: each picked by places, in the order of starts or labels, or by labels."""
    if isinstance(series, slice):
        s = series_by_place(s, series)
    elif series is not None:
        s = series_by_label(s, series)
    if isinstance(intervals, slice):
        at = places(iv.withColumn("_key", F.struct("start", "stop", "interval_id")), "_key", "_n")
        iv = at.where(_sliced("place", intervals, "_n")).select("_key.interval_id", "_key.start", "_key.stop")
    elif intervals is not None:
        iv = iv.where(F.col("interval_id").isin(intervals))
    return restrict(s, iv)
