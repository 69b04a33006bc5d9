"""Interval algebra.  A set is the rows of equal ``keys``; rows have start <= stop and are half-open.

Everything is partitioned by the keys: one shuffle on them serves the windows and joins of a
composition, and no operator needs an order over several sets.  Where one set is very long, ``width``
lets it be worked through in pieces (see ``scans``): stretches of time of that width, or ranges of
intervals if it is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .ranges import overlapping, points_in

Keys = list[str]
#: Ends of an unbounded domain, far beyond any time in microseconds.
LEAST, MOST = -(2**62), 2**62


def _order(keys: Keys):
    return Window.partitionBy(*keys).orderBy("start", "stop")


def merge(iv: DataFrame, keys: Keys, gap: int = 0, width: float | None = None) -> DataFrame:
    """Union of overlapping or touching intervals; also bridges gaps of at most ``gap``."""
    if width is not None:
        return scans.merged(iv.select(*keys, "start", "stop"), keys, width, gap)
    before = F.max("stop").over(_order(keys).rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= before + gap, 0).otherwise(1)
    return (iv.withColumn("_new", new).withColumn("_island", F.sum("_new").over(_order(keys).rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island"))


def bag_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All intervals of both, duplicates kept."""
    return a.unionByName(b)


def union(a: DataFrame, b: DataFrame, keys: Keys, width: float | None = None) -> DataFrame:
    return merge(bag_union(a, b), keys, width=width)


def intersect(a: DataFrame, b: DataFrame, keys: Keys, boundaries: bool = True, bucket: int | None = None) -> DataFrame:
    """Overlap of each pair with a.start < b.stop and b.start < a.stop, not merged; without
    ``boundaries`` the hull of the pair.

    Both sides are dealt out by cells of time whose width follows their lengths (see ``ranges``), or by
    buckets of one width, where a pair is kept in the bucket in which its overlap starts; so a set of
    many intervals doesn't meet itself as a whole.
    """
    lo, hi = (F.greatest, F.least) if boundaries else (F.least, F.greatest)
    if not bucket:
        return overlapping(a, b, keys).select(*keys, lo("start", "_s").alias("start"), hi("stop", "_e").alias("stop"))
    o = b.select(*keys, F.col("start").alias("_s"), F.col("stop").alias("_e"))
    a = a.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.greatest(F.col("stop") - 1, F.col("start")) / bucket))))
    o = o.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bucket), F.floor(F.greatest(F.col("_e") - 1, F.col("_s")) / bucket))))
    pairs = a.join(o, [*keys, "_b"]).where("start < _e and _s < stop").where(F.floor(F.greatest("start", "_s") / bucket) == F.col("_b"))
    return pairs.select(*keys, lo("start", "_s").alias("start"), hi("stop", "_e").alias("stop"))


def intersect_bucketed(a: DataFrame, b: DataFrame, bucket: int) -> DataFrame:
    """Overlaps of two sets without keys, by an equi-join on time buckets; a pair is kept in the
    bucket where its overlap starts."""
    def cells(df: DataFrame, s: str, e: str) -> DataFrame:
        first, last = F.floor(F.col(s) / bucket), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / bucket)
        return df.withColumn("_b", F.explode(F.sequence(first, last)))
    o = cells(b.select(F.col("start").alias("_s"), F.col("stop").alias("_e")), "_s", "_e")
    return (cells(a, "start", "stop").join(o, "_b").where("start < _e and _s < stop")
            .where(F.floor(F.greatest("start", "_s") / bucket) == F.col("_b"))
            .select(F.greatest("start", "_s").alias("start"), F.least("stop", "_e").alias("stop")))


def complement(iv: DataFrame, keys: Keys, low: int = LEAST, high: int = MOST, width: float | None = None) -> DataFrame:
    """Gaps of the merged set inside the domain [low, high); empty gaps are left out."""
    m = merge(iv, keys, width=width)
    if width is None:
        order = Window.partitionBy(*keys).orderBy("start")
        head = m.select(*keys, F.lag("stop", 1, low).over(order).alias("_from"), F.col("start").alias("_to"))
    else:
        n = scans.neighbours(scans.pieces(m, keys, "start", width), keys, "start", ["stop"])
        head = n.select(*keys, F.coalesce("_before.stop", F.lit(low)).alias("_from"), F.col("start").alias("_to"))
    tail = m.groupBy(*keys).agg(F.max("stop").alias("_from")).select(*keys, "_from", F.lit(high).cast("long").alias("_to"))
    return (head.unionByName(tail).select(*keys, F.greatest("_from", F.lit(low)).alias("start"), F.least("_to", F.lit(high)).alias("stop"))
            .where("start < stop"))


def difference(a: DataFrame, b: DataFrame, keys: Keys, width: float | None = None) -> DataFrame:
    """Parts of a's merged set outside b, by one sweep over the ends of both merged sets."""
    def ends(iv: DataFrame, da: int, db: int) -> DataFrame:
        at = F.explode(F.array(*[F.struct(F.col(c).alias("t"), F.lit(k * da).alias("da"), F.lit(k * db).alias("db")) for c, k in (("start", 1), ("stop", -1))]))
        return merge(iv, keys, width=width).select(*keys, at.alias("_x")).select(*keys, "_x.*")

    if width is not None:
        at = ends(a, 1, 0).unionByName(ends(b, 0, 1)).groupBy(*keys, "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
        p = scans.neighbours(scans.pieces(at, keys, "t", width), keys, "t", [])
        p = scans.running(scans.running(p, keys, "t", F.col("da"), "_a"), keys, "t", F.col("db"), "_b")
        return p.select(*keys, F.col("t").alias("start"), F.col("_after.t").alias("stop"), "_a", "_b").where("_a > 0 and _b = 0 and stop is not null").select(*keys, "start", "stop")
    w = Window.partitionBy(*keys).orderBy("t")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    at = ends(a, 1, 0).unionByName(ends(b, 0, 1)).groupBy(*keys, "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    run = at.select(*keys, F.col("t").alias("start"), F.lead("t").over(w).alias("stop"), F.sum("da").over(up).alias("_a"), F.sum("db").over(up).alias("_b"))
    return run.where("_a > 0 and _b = 0 and stop is not null").select(*keys, "start", "stop")


def expand(iv: DataFrame, amount: int, direction: str = "both") -> DataFrame:
    left, right = direction in ("both", "start"), direction in ("both", "stop")
    return iv.withColumn("start", F.col("start") - amount * left).withColumn("stop", F.col("stop") + amount * right)


def shrink(iv: DataFrame, amount: int, direction: str = "both", strict: bool = False) -> DataFrame:
    """Intervals that would vanish are left out, or refused (``strict``)."""
    out = expand(iv, -amount, direction)
    if strict:
        return out.withColumn("stop", F.when(F.col("start") > F.col("stop"), F.raise_error(F.lit("an interval is shorter than what is taken off"))).otherwise(F.col("stop")))
    return out.where("start <= stop")


def shift(iv: DataFrame, amount: int) -> DataFrame:
    return iv.withColumn("start", F.col("start") + amount).withColumn("stop", F.col("stop") + amount)


def partition(iv: DataFrame, keys: Keys, n: int | None = None, ds: int | None = None) -> DataFrame:
    """Each interval in ``n`` equal pieces, or in pieces of ``ds`` with the remainder last."""
    length = F.col("stop") - F.col("start")
    step = F.lit(ds) if ds else F.ceil(length / n).cast("long")
    count = F.greatest(F.ceil(length / step).cast("int"), F.lit(1))
    return (iv.withColumn("_step", step).withColumn("_i", F.explode(F.sequence(F.lit(0), count - 1)))
            .select(*keys, (F.col("start") + F.col("_i") * F.col("_step")).alias("start"),
                    F.least(F.col("start") + (F.col("_i") + 1) * F.col("_step"), "stop").alias("stop")))


def measure(iv: DataFrame, keys: Keys) -> DataFrame:
    """(keys, n_intervals, length): number of merged intervals and their total length."""
    return merge(iv, keys).groupBy(*keys).agg(F.count("*").alias("n_intervals"), F.sum(F.col("stop") - F.col("start")).alias("length"))


def hull(iv: DataFrame, keys: Keys) -> DataFrame:
    return iv.groupBy(*keys).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_intervals"))


def centers(iv: DataFrame) -> DataFrame:
    return iv.withColumn("center", (F.col("start") + F.col("stop")) / 2).withColumn("length", F.col("stop") - F.col("start"))


def is_merged(iv: DataFrame, keys: Keys) -> DataFrame:
    """(keys, merged): whether no two intervals of the set overlap or touch."""
    before = F.max("stop").over(_order(keys).rowsBetween(Window.unboundedPreceding, -1))
    return iv.withColumn("_ok", F.coalesce(F.col("start") > before, F.lit(True))).groupBy(*keys).agg(F.bool_and("_ok").alias("merged"))


def drop_empty(iv: DataFrame) -> DataFrame:
    return iv.where("stop > start")


def contains(points: DataFrame, iv: DataFrame, keys: Keys, width: float | None = None) -> DataFrame:
    """Points (keys, t) inside an interval, closed on both ends: the last merged interval before each decides.

    With ``width``, points and merged intervals meet in cells (see ``ranges``).
    """
    if width is not None:
        return points_in(points.select(*keys, "t"), merge(iv, keys, width=width), closed_right=True, keys=keys).select(*keys, "t")
    m = merge(iv, keys).select(*keys, F.col("start").alias("t"), F.lit(0).alias("_k"), F.col("stop").alias("_e"))
    p = points.select(*keys, "t", F.lit(1).alias("_k"), F.lit(None).cast("long").alias("_e"))
    back = Window.partitionBy(*keys).orderBy("t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return m.unionByName(p).withColumn("_e", F.last("_e", ignorenulls=True).over(back)).where("_k = 1 and t <= _e").select(*keys, "t")


def collapse(iv: DataFrame, keys: Keys, gap: int = 0, width: float | None = None) -> DataFrame:
    """Merged intervals moved end to end, with offsets (new start - old start) for their events."""
    if width is not None:
        m = scans.pieces(merge(iv, keys, width=width), keys, "start", width)
        size = F.col("stop") - F.col("start") + gap
        m = scans.running(m, keys, "start", size, "_up").withColumn("new_start", F.col("_up") - size)
        return m.select(*keys, "start", "stop", "new_start", (F.col("new_start") + F.col("stop") - F.col("start")).alias("new_stop"))
    order = Window.partitionBy(*keys).orderBy("start")
    length = F.col("stop") - F.col("start")
    new = F.coalesce(F.sum(length + gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return merge(iv, keys).select(*keys, "start", "stop", new.alias("new_start"), (new + length).alias("new_stop"))


def pieces(iv: DataFrame, keys: Keys, n: int) -> DataFrame:
    """Each set cut into n pieces of equal total length, counted along its merged intervals.

    A piece that reaches over a gap is more than one interval; ``piece`` numbers them from 0.
    """
    order = Window.partitionBy(*keys).orderBy("start")
    length = F.col("stop") - F.col("start")
    m = merge(iv, keys)
    total = m.groupBy(*keys).agg(F.sum(length).alias("_t"))
    m = m.withColumn("_o", F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(total, keys).where("_t > 0 and stop > start")
    cut = lambda k: F.floor(F.col("_t") * k / n)
    first = F.greatest(F.floor(F.col("_o") * n / F.col("_t")) - 1, F.lit(0))
    last = F.least(F.floor((F.col("_o") + length) * n / F.col("_t")), F.lit(n - 1))
    at = m.withColumn("piece", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("start"), F.col("start") + cut(F.col("piece")) - F.col("_o"))
    hi = F.least(F.col("stop"), F.col("start") + cut(F.col("piece") + 1) - F.col("_o"))
    return at.select(*keys, F.col("piece").cast("long").alias("piece"), lo.cast("long").alias("start"), hi.cast("long").alias("stop")).where("start < stop")


def from_starts(starts: DataFrame, length: int) -> DataFrame:
    """Intervals of one length; a row without a start is refused."""
    start = F.when(F.col("start").isNull(), F.raise_error(F.lit("an interval needs a start"))).otherwise(F.col("start"))
    return starts.withColumn("start", start).withColumn("stop", F.col("start") + F.lit(length))


def checked(iv: DataFrame) -> DataFrame:
    """The same intervals; one that stops before it starts is refused."""
    return iv.withColumn("stop", F.when(F.col("stop") < F.col("start"), F.raise_error(F.lit("an interval stops before it starts"))).otherwise(F.col("stop")))


def at_places(iv: DataFrame, keys: Keys, picked: list[int]) -> DataFrame:
    """The intervals at some places, from 0, of each set in order."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    return iv.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i").isin(picked)).drop("_i")
