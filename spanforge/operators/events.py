"""Event series (series_id, t, ...) and their restriction to intervals (interval_id, start, stop)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import points_in


def restrict(ev: DataFrame, iv: DataFrame, bucket: int | None = None, closed_right: bool = False, most: int | None = None) -> DataFrame:
    """Events inside an interval, with its columns; start <= t < stop (or <= stop).

    Both sides are dealt out by cells of time whose width follows the intervals' lengths (see
    ``ranges``), or by buckets of one width, which suits intervals of about that length.
    """
    if not bucket:
        return points_in(ev, iv, closed_right, most)
    last = F.col("stop") if closed_right else F.greatest(F.col("stop") - 1, F.col("start"))
    cells = iv.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(last / bucket))))
    end = F.col("t") <= F.col("stop") if closed_right else F.col("t") < F.col("stop")
    return ev.withColumn("_b", F.floor(F.col("t") / bucket)).join(cells, "_b").where((F.col("t") >= F.col("start")) & end).drop("_b")


def outside(ev: DataFrame, iv: DataFrame, bucket: int | None = None) -> DataFrame:
    """Events in no interval; without ``bucket`` they are those in the gaps of all intervals."""
    if not bucket:
        from . import scans
        from .intervals import LEAST, MOST

        some = iv.where("start < stop").select("start", "stop")
        walls = some.sparkSession.createDataFrame([(LEAST, LEAST), (MOST, MOST)], "start long, stop long")
        m = scans.merged(some.unionByName(walls), [])
        next_ = scans.neighbours(scans.pieces(m, [], "start"), [], "start", [])
        gaps = next_.select(F.col("stop").alias("_from"), F.col("_after.start").alias("_to")).where("_from < _to")
        found = points_in(ev.withColumnsRenamed({c: f"_e_{c}" for c in ev.columns if c != "t"}), gaps.select(F.col("_from").alias("start"), F.col("_to").alias("stop")))
        return found.select(*[F.col(c if c == "t" else f"_e_{c}").alias(c) for c in ev.columns])
    cells = iv.select(F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket))).alias("_c"), "start", "stop")
    e = ev.withColumn("_b", F.floor(F.col("t") / bucket))
    return e.join(cells, (F.col("_b") == F.col("_c")) & (F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop")), "left_anti").drop("_b")


def flatten(ev: DataFrame, series_id: int | str = 0) -> DataFrame:
    return ev.withColumn("series_id", F.lit(series_id))


def summary(ev: DataFrame) -> DataFrame:
    return ev.groupBy("series_id").agg(F.count("*").alias("n_events"), F.min("t").alias("first_event"), F.max("t").alias("last_event"))


def firing_order(ev: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, place): series by their first event; silent ones last, then by id."""
    from .selection import places

    first = series.join(ev.groupBy("series_id").agg(F.min("t").alias("first")), "series_id", "left")
    at = places(first.select(F.struct(F.col("first").isNull().alias("silent"), "first", "series_id").alias("k")), "k")
    return at.select("k.series_id", (F.col("place") + 1).alias("place"))


def is_sorted(ev: DataFrame, order: str) -> DataFrame:
    """(series_id, sorted): whether times rise with the column ``order``."""
    w = Window.partitionBy("series_id").orderBy(order)
    return ev.withColumn("_ok", F.coalesce(F.col("t") >= F.lag("t").over(w), F.lit(True))).groupBy("series_id").agg(F.bool_and("_ok").alias("sorted"))


def segments(ev: DataFrame, keys: list[str], step: int, inclusive: bool = False, width: float | None = None) -> DataFrame:
    """Contiguous runs (keys, start, stop, n): a gap of at least 2 * step starts a new one; stop is
    the last time plus step (or the last time itself); in pieces of ``width``, see ``scans``, if it is given."""
    if width is not None:
        from . import scans

        p = scans.neighbours(scans.pieces(ev.select(*keys, "t"), keys, "t", width), keys, "t", [])
        found = scans.stretches(p, keys, "t", F.coalesce(F.col("t") - F.col("_before.t") >= 2 * step, F.lit(True)))
        return found.select(*keys, F.col("first").alias("start"), (F.col("last") + (0 if inclusive else step)).alias("stop"), "n")
    w = Window.partitionBy(*keys).orderBy("t")
    new = F.when(F.col("t") - F.lag("t").over(w) >= 2 * step, 1).otherwise(0)
    runs = ev.withColumn("_n", new).withColumn("_run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min("t").alias("start"), (F.max("t") + (0 if inclusive else step)).alias("stop"), F.count("*").alias("n")).drop("_run")


def retime(ev: DataFrame, collapsed: DataFrame, bucket: int | None = None) -> DataFrame:
    """Events of collapsed intervals (start, stop, new_start) at their new times."""
    return restrict(ev, collapsed, bucket).withColumn("t", F.col("t") - F.col("start") + F.col("new_start"))


def state_asof(points: DataFrame, ev: DataFrame, keys: list[str], state: str, pieces: bool = False) -> DataFrame:
    """Points (keys, t) with the state of the last event at or before t; before all events the first state.

    With ``pieces``, points and events of a key are worked through in ranges of rows (see ``scans``).
    """
    a = points.select(*keys, "t", F.lit(1).alias("_k"), F.lit(None).cast("string").alias("_s"))
    b = ev.select(*keys, "t", F.lit(0).alias("_k"), F.col(state).cast("string").alias("_s"))
    if pieces:
        from . import scans

        rows = a.unionByName(b).withColumn("_at", F.struct("t", "_k"))
        found = scans.filled(scans.pieces(rows, keys, "_at"), keys, "_at", "_s", "_last").where("_k = 1")
        first = ev.where(F.col(state).isNotNull()).groupBy(*keys).agg(F.min(F.struct("t", F.col(state).cast("string").alias("s")))["s"].alias("_first"))
        return found.join(first, keys, "left").select(*keys, "t", F.coalesce("_last", "_first").alias("state"))
    w = Window.partitionBy(*keys).orderBy("t", "_k")
    both = a.unionByName(b).withColumn("_last", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_first", F.first("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return both.where("_k = 1").select(*keys, "t", F.coalesce("_last", "_first").alias("state"))


def stateful(ev: DataFrame, iv: DataFrame, keys: list[str], state: str, bucket: int | None = None) -> DataFrame:
    """Step function rows (keys, t, kind, state): kind 0 and 2 at interval starts and stops with the
    carried state, kind 1 for the events inside."""
    ids = ev.select(*keys).distinct()
    edges = iv.select(F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(0).alias("kind")), F.struct(F.col("stop").alias("t"), F.lit(2).alias("kind")))).alias("e")).select("e.t", "e.kind")
    at = ids.crossJoin(edges)  # every series has every interval's two edges, as the result has
    carried = state_asof(at.select(*keys, "t").distinct(), ev, keys, state)
    rows = at.join(carried, [*keys, "t"]).select(*keys, "t", "kind", "state")
    inside = restrict(ev, iv, bucket).select(*keys, "t", F.lit(1).alias("kind"), F.col(state).cast("string").alias("state"))
    return rows.unionByName(inside)


def folds(df: DataFrame, k: int, index: Column) -> DataFrame:
    """Validation fold of each row: its index modulo k."""
    return df.withColumn("fold", F.pmod(index, F.lit(k)))
