"""All registered queries of the interval, event and signal operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeops import DAY, HOUR, floordiv, gaussian_weights
from ..operators import binned as B
from ..operators import decode as D
from ..operators import detect as X
from ..operators import events as E
from ..operators import intervals as I
from ..operators import markov as M
from ..operators import ratemap as R
from ..operators import signals as S
from ..sources.tables import day_windows, events, order_lifetimes, shipping_weeks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
K = ["set_id"]


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name], _SQL[name] = f, sql
        return f
    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# --- intervals: a = order lifetimes, b = shipping weeks, both by customer --------------------

_A = """a AS (SELECT o_custkey AS set_id, epoch_us(o_orderdate) AS start, stop FROM orders JOIN
 (SELECT l_orderkey, max(epoch_us(l_shipdate)) AS stop FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey WHERE stop >= epoch_us(o_orderdate))"""
_B = f"""b AS (SELECT o_custkey AS set_id, epoch_us(l_shipdate) AS start, epoch_us(l_shipdate) + {7 * DAY} AS stop FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def _merged(src: str, out: str, gap: int = 0) -> str:
    return f"""{out} AS (SELECT set_id, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY set_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS isl FROM
 (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY set_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new FROM {src})) GROUP BY set_id, isl)"""


def _gaps(src: str, out: str, low: int, high: int) -> str:
    return f"""{out} AS (SELECT set_id, greatest(f, {low}) AS start, least(t, {high}) AS stop FROM (
 SELECT set_id, lag(stop, 1, {low}) OVER (PARTITION BY set_id ORDER BY start) AS f, start AS t FROM {src}
 UNION ALL SELECT set_id, max(stop), {high} FROM {src} GROUP BY set_id) WHERE greatest(f, {low}) < least(t, {high}))"""


def _a(s: SparkSession, d: str) -> DataFrame:
    return order_lifetimes(s, d)


def _b(s: SparkSession, d: str) -> DataFrame:
    return shipping_weeks(s, d)


_LOW, _HIGH = 694224000000000, 946684800000000  # 1992-01-01 and 2000-01-01


@_query("iv_merge", f"WITH {_A}, {_merged('a', 'm')} SELECT * FROM m")
def _(s, d):
    return I.merge(_a(s, d), K)


@_query("iv_merge_gap", f"WITH {_A}, {_merged('a', 'm', 30 * DAY)} SELECT * FROM m")
def _(s, d):
    return I.merge(_a(s, d), K, 30 * DAY)


@_query("iv_join_bag", f"WITH {_A}, {_B} SELECT * FROM a UNION ALL SELECT * FROM b")
def _(s, d):
    return I.bag_union(_a(s, d), _b(s, d))


@_query("iv_union", f"WITH {_A}, {_B}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b), {_merged('u', 'm')} SELECT * FROM m")
def _(s, d):
    return I.union(_a(s, d), _b(s, d), K)


_PAIR = "FROM a JOIN b USING (set_id) WHERE a.start < b.stop AND b.start < a.stop"


@_query("iv_intersect", f"WITH {_A}, {_B} SELECT set_id, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop {_PAIR}")
def _(s, d):
    return I.intersect(_a(s, d), _b(s, d), K)


@_query("iv_intersect_hulls", f"WITH {_A}, {_B} SELECT set_id, least(a.start, b.start) AS start, greatest(a.stop, b.stop) AS stop {_PAIR}")
def _(s, d):
    return I.intersect(_a(s, d), _b(s, d), K, boundaries=False)


@_query("iv_complement", f"WITH {_A}, {_merged('a', 'm')}, {_gaps('m', 'g', _LOW, _HIGH)} SELECT * FROM g")
def _(s, d):
    return I.complement(_a(s, d), K, _LOW, _HIGH)


@_query("iv_difference", f"""WITH {_A}, {_B}, {_merged('a', 'am')}, {_merged('b', 'bm')}, {_gaps('bm', 'g', I.LEAST, I.MOST)}
SELECT set_id, greatest(am.start, g.start) AS start, least(am.stop, g.stop) AS stop FROM am JOIN g USING (set_id) WHERE am.start < g.stop AND g.start < am.stop
UNION ALL SELECT * FROM am WHERE set_id NOT IN (SELECT set_id FROM b)""")
def _(s, d):
    return I.difference(_a(s, d), _b(s, d), K)


@_query("iv_hull", f"WITH {_A} SELECT set_id, min(start) AS start, max(stop) AS stop, count(*) AS n_intervals FROM a GROUP BY set_id")
def _(s, d):
    return I.hull(_a(s, d), K)


@_query("iv_expand", f"WITH {_A} SELECT set_id, start - {DAY} AS start, stop + {DAY} AS stop FROM a")
def _(s, d):
    return I.expand(_a(s, d), DAY)


@_query("iv_shrink", f"WITH {_A} SELECT set_id, start + {DAY} AS start, stop - {DAY} AS stop FROM a WHERE start + {DAY} <= stop - {DAY}")
def _(s, d):
    return I.shrink(_a(s, d), DAY)


@_query("iv_shift", f"WITH {_A} SELECT set_id, start + {3 * DAY} AS start, stop + {3 * DAY} AS stop FROM a")
def _(s, d):
    return I.shift(_a(s, d), 3 * DAY)


@_query("iv_partition_n", f"""WITH {_A}, c AS (SELECT set_id, start, stop, CAST(ceil((stop - start) / 4) AS BIGINT) AS w FROM a)
SELECT set_id, start + i * w AS start, least(start + (i + 1) * w, stop) AS stop
FROM (SELECT *, unnest(generate_series(0, CASE WHEN w = 0 THEN 0 ELSE greatest(CAST(ceil((stop - start) / w) AS BIGINT), 1) - 1 END)) AS i FROM c WHERE stop > start)""")
def _(s, d):
    return I.partition(I.drop_empty(_a(s, d)), K, n=4)


@_query("iv_partition_ds", f"""WITH {_A} SELECT set_id, start + i * {10 * DAY} AS start, least(start + (i + 1) * {10 * DAY}, stop) AS stop
FROM (SELECT *, unnest(generate_series(0, greatest(CAST(ceil((stop - start) / {10 * DAY}) AS BIGINT), 1) - 1)) AS i FROM a)""")
def _(s, d):
    return I.partition(_a(s, d), K, ds=10 * DAY)


@_query("iv_length", f"WITH {_A}, {_merged('a', 'm')} SELECT set_id, count(*) AS n_intervals, CAST(sum(stop - start) AS BIGINT) AS length FROM m GROUP BY set_id")
def _(s, d):
    return I.measure(_a(s, d), K)


@_query("iv_centers", f"WITH {_A} SELECT set_id, start, stop, (start + stop) / 2 AS center, stop - start AS length FROM a")
def _(s, d):
    return I.centers(_a(s, d))


@_query("iv_ismerged", f"""WITH {_A} SELECT set_id, bool_and(ok) AS merged FROM (SELECT set_id, coalesce(start > max(stop) OVER (PARTITION BY set_id ORDER BY start, stop
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM a) GROUP BY set_id""")
def _(s, d):
    return I.is_merged(_a(s, d), K)


@_query("iv_contains", f"WITH {_A}, {_B} SELECT set_id, start AS t FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.set_id = b.set_id AND b.start BETWEEN a.start AND a.stop)")
def _(s, d):
    return I.contains(_b(s, d).select("set_id", F.col("start").alias("t")), _a(s, d), K)


_COLLAPSED = "SELECT set_id, start, stop, CAST(coalesce(sum(stop - start) OVER (PARTITION BY set_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_start FROM m"


@_query("iv_collapse_time", f"WITH {_A}, {_merged('a', 'm')} SELECT *, new_start + (stop - start) AS new_stop FROM ({_COLLAPSED})")
def _(s, d):
    return I.collapse(_a(s, d), K)


@_query("iv_intersect_bucketed", f"""WITH ev AS (SELECT epoch_us(ts) AS t FROM events), w AS (SELECT DISTINCT t // {DAY} AS k FROM ev),
a AS (SELECT k * {DAY} + {9 * HOUR} AS start, k * {DAY} + {17 * HOUR} AS stop FROM w), b AS (SELECT t - {HOUR} AS start, t + {HOUR} AS stop FROM ev)
SELECT greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM a JOIN b ON a.start < b.stop AND b.start < a.stop""")
def _(s, d):
    ev = events(s, d)
    return I.intersect_bucketed(day_windows(ev).select("start", "stop"), ev.select((F.col("t") - HOUR).alias("start"), (F.col("t") + HOUR).alias("stop")), 4 * HOUR)


# --- events ----------------------------------------------------------------------------------

_EV = "ev AS (SELECT event_id, event_type AS series_id, user_id, epoch_us(ts) AS t, value FROM events)"
_WIN = f"win AS (SELECT interval_id, interval_id * {DAY} + {9 * HOUR} AS start, interval_id * {DAY} + {17 * HOUR} AS stop FROM (SELECT DISTINCT t // {DAY} AS interval_id FROM ev))"


def _ev(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = events(s, d)
    return ev, day_windows(ev)


@_query("ev_restrict", f"WITH {_EV}, {_WIN} SELECT ev.*, interval_id, start, stop FROM ev JOIN win ON t >= start AND t < stop")
def _(s, d):
    ev, win = _ev(s, d)
    return E.restrict(ev, win)


@_query("ev_restrict_counts", f"WITH {_EV}, {_WIN} SELECT series_id, interval_id, count(*) AS n FROM ev JOIN win ON t >= start AND t < stop GROUP BY ALL")
def _(s, d):
    ev, win = _ev(s, d)
    return E.restrict(ev, win).groupBy("series_id", "interval_id").agg(F.count("*").alias("n"))


@_query("ev_outside", f"WITH {_EV}, {_WIN} SELECT * FROM ev WHERE NOT EXISTS (SELECT 1 FROM win WHERE t >= start AND t < stop)")
def _(s, d):
    ev, win = _ev(s, d)
    return E.outside(ev, win, 4 * HOUR)


@_query("ev_flatten", f"WITH {_EV} SELECT event_id, 0 AS series_id, user_id, t, value FROM ev")
def _(s, d):
    return E.flatten(events(s, d))


@_query("ev_summary", f"WITH {_EV} SELECT series_id, count(*) AS n_events, min(t) AS first_event, max(t) AS last_event FROM ev GROUP BY series_id")
def _(s, d):
    return E.summary(events(s, d))


@_query("ev_firing_order", f"""WITH {_EV} SELECT u.series_id, row_number() OVER (ORDER BY f NULLS LAST, u.series_id) AS place
FROM (SELECT DISTINCT user_id AS series_id FROM ev) u LEFT JOIN (SELECT user_id AS series_id, min(t) AS f FROM ev WHERE series_id = 'error' AND value > 400 GROUP BY user_id) x ON u.series_id = x.series_id""")
def _(s, d):
    ev = events(s, d)
    own = ev.where("series_id = 'error' and value > 400").select(F.col("user_id").alias("series_id"), "t")
    return E.firing_order(own, ev.select(F.col("user_id").alias("series_id")).distinct())


@_query("ev_union", f"WITH {_EV} SELECT series_id, t FROM ev WHERE value < 100 UNION ALL SELECT series_id, t FROM ev WHERE value > 300")
def _(s, d):
    ev = events(s, d)
    return ev.where("value < 100").select("series_id", "t").unionByName(ev.where("value > 300").select("series_id", "t"))


@_query("ev_sorted_check", f"WITH {_EV} SELECT series_id, bool_and(ok) AS sorted FROM (SELECT series_id, coalesce(t >= lag(t) OVER (PARTITION BY series_id ORDER BY event_id), true) AS ok FROM ev) GROUP BY series_id")
def _(s, d):
    return E.is_sorted(events(s, d), "event_id")


@_query("ev_contiguous_segments", f"""WITH {_EV} SELECT user_id, min(t) AS start, max(t) + {6 * HOUR} AS stop, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM
(SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= {12 * HOUR} THEN 1 ELSE 0 END AS new FROM ev)) GROUP BY user_id, run""")
def _(s, d):
    return E.segments(events(s, d), ["user_id"], 6 * HOUR)


@_query("ev_collapse_time", f"""WITH {_EV}, {_WIN}, c AS (SELECT start, stop, CAST(coalesce(sum(stop - start) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_start FROM win)
SELECT event_id, series_id, t - start + new_start AS t FROM ev JOIN c ON t >= start AND t < stop""")
def _(s, d):
    ev, win = _ev(s, d)
    one = I.collapse(win.select(F.lit(0).alias("k"), "start", "stop"), ["k"])
    return E.retime(ev, one.select("start", "stop", "new_start"), 4 * HOUR).select("event_id", "series_id", "t")


@_query("ev_kfold", f"WITH {_EV} SELECT event_id, event_id % 5 AS fold FROM ev")
def _(s, d):
    return E.folds(events(s, d).select("event_id"), 5, F.col("event_id"))


@_query("ev_nearest", f"""WITH {_EV} SELECT DISTINCT ON (p.user_id, p.t) p.user_id, p.t, e.event_id AS nearest FROM (SELECT user_id, t FROM ev WHERE series_id = 'purchase') p
JOIN (SELECT * FROM ev WHERE series_id = 'click') e USING (user_id) ORDER BY p.user_id, p.t, abs(e.t - p.t), e.t, e.event_id""")
def _(s, d):
    ev = events(s, d)
    click = ev.where("series_id = 'click'").select("user_id", F.col("t").alias("_t"), "event_id")
    return (ev.where("series_id = 'purchase'").select("user_id", "t").join(click, "user_id").groupBy("user_id", "t")
            .agg(F.min(F.struct(F.abs(F.col("_t") - F.col("t")).alias("d"), "_t", "event_id"))["event_id"].alias("nearest")))


# --- step functions and marks ------------------------------------------------------------------

@_query("val_state_asof", f"""WITH {_EV}, p AS (SELECT DISTINCT user_id, (t // {DAY}) * {DAY} + {12 * HOUR} AS t FROM ev)
SELECT p.user_id, p.t, coalesce(e.series_id, f.s) AS state FROM p ASOF LEFT JOIN ev e ON p.user_id = e.user_id AND p.t >= e.t
JOIN (SELECT user_id, arg_min(series_id, t) AS s FROM ev GROUP BY user_id) f ON f.user_id = p.user_id""")
def _(s, d):
    ev = events(s, d)
    points = ev.select("user_id", (floordiv(F.col("t"), DAY) * DAY + 12 * HOUR).alias("t")).distinct()
    return E.state_asof(points, ev, ["user_id"], "series_id")


@_query("val_state_boundaries", f"""WITH {_EV}, {_WIN}, w AS (SELECT * FROM win ORDER BY start), u AS (SELECT DISTINCT user_id FROM ev), f AS (SELECT user_id, arg_min(series_id, t) AS s FROM ev GROUP BY user_id),
p AS (SELECT user_id, start AS t, 0 AS kind FROM u, w UNION ALL SELECT user_id, stop, 2 FROM u, w)
SELECT p.user_id, p.t, p.kind, coalesce(e.series_id, f.s) AS state FROM p ASOF LEFT JOIN ev e ON p.user_id = e.user_id AND p.t >= e.t JOIN f ON f.user_id = p.user_id
UNION ALL SELECT user_id, t, 1, series_id FROM ev JOIN win ON t >= start AND t < stop""")
def _(s, d):
    ev, win = _ev(s, d)
    return E.stateful(ev, win, ["user_id"], "series_id", 4 * HOUR)


_CELLS = f"""cells AS (SELECT series_id, interval_id, bin_idx, start + bin_idx * {HOUR} AS bin_start FROM (SELECT DISTINCT series_id FROM ev), (SELECT *, unnest(generate_series(0, (stop - start) // {HOUR} - 1)) AS bin_idx FROM win))"""


def _binned_sql(extra: str = "") -> str:
    return f"""{_EV}, {_WIN}, {_CELLS}, found AS (SELECT series_id, interval_id, (t - start) // {HOUR} AS bin_idx, count(*) AS n{extra} FROM ev JOIN win ON t >= start AND t < stop GROUP BY ALL)"""


_BIN = _binned_sql() + ", bins AS (SELECT c.*, coalesce(n, 0) AS n FROM cells c LEFT JOIN found USING (series_id, interval_id, bin_idx))"


def _bins(s: SparkSession, d: str) -> DataFrame:
    ev, win = _ev(s, d)
    return B.bin_events(ev, win, HOUR)


for _name, _agg, _expr in (("sum", F.sum, "sum(value)"), ("mean", F.avg, "avg(value)"), ("min", F.min, "min(value)"), ("max", F.max, "max(value)"), ("median", F.median, "median(value)")):
    _SQL[f"val_bin_{_name}"] = f"WITH {_binned_sql(', ' + _expr + ' AS v')} SELECT c.series_id, c.interval_id, CAST(c.bin_idx AS INTEGER) AS bin_idx, round({'coalesce(v, 0)' if _name == 'sum' else 'v'}, 6) AS v FROM cells c LEFT JOIN found USING (series_id, interval_id, bin_idx)"

    def _value_bins(s, d, agg=_agg, zero=_name == "sum"):
        ev, win = _ev(s, d)
        b = B.bin_events(ev, win, HOUR, {"v": agg("value")}, 4 * HOUR)
        return _round(b.withColumn("v", F.coalesce("v", F.lit(0.0)) if zero else F.col("v")), "v").select("series_id", "interval_id", "bin_idx", "v")

    _QUERIES[f"val_bin_{_name}"] = lambda s, d, f=_value_bins: f(s, d)


# --- bins ------------------------------------------------------------------------------------

@_query("flagship_window_rates", f"WITH {_BIN} SELECT series_id, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_bins, round(avg(n), 6) AS mean_rate, round(stddev_pop(n), 6) AS std_rate FROM bins GROUP BY series_id")
def _(s, d):
    return _round(_bins(s, d).groupBy("series_id").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_bins"), F.avg("n").alias("mean_rate"), F.stddev_pop("n").alias("std_rate")), "mean_rate", "std_rate")


@_query("bin_hourly_dense", f"WITH {_BIN} SELECT series_id, interval_id, CAST(bin_idx AS INTEGER) AS bin_idx, bin_start, n FROM bins")
def _(s, d):
    return _bins(s, d)


@_query("bin_rebin", f"""WITH {_BIN} SELECT series_id, interval_id, CAST(bin_idx // 3 AS INTEGER) AS bin_idx, CAST(sum(n) AS BIGINT) AS n, min(bin_start) AS bin_start FROM bins GROUP BY series_id, interval_id, bin_idx // 3 HAVING count(*) = 3""")
def _(s, d):
    return B.rebin(_bins(s, d), 3)


@_query("bin_flatten", f"WITH {_BIN} SELECT interval_id, CAST(bin_idx AS INTEGER) AS bin_idx, bin_start, CAST(sum(n) AS BIGINT) AS n FROM bins GROUP BY ALL")
def _(s, d):
    return B.flatten(_bins(s, d))


@_query("bin_stats", f"WITH {_BIN} SELECT series_id, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, median(n) AS median, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_bins FROM bins GROUP BY series_id")
def _(s, d):
    return _round(B.stats(_bins(s, d)), "mean", "std")


for _name, _c, _s, _expr in (("center", True, False, "n - avg(n) OVER w"), ("normalize", False, True, "n / CASE WHEN stddev_pop(n) OVER w = 0 THEN 1 ELSE stddev_pop(n) OVER w END"),
                             ("standardize", True, True, "(n - avg(n) OVER w) / CASE WHEN stddev_pop(n) OVER w = 0 THEN 1 ELSE stddev_pop(n) OVER w END")):
    _SQL[f"bin_{_name}"] = f"WITH {_BIN} SELECT series_id, bin_start, round({_expr}, 6) AS y FROM bins WINDOW w AS (PARTITION BY series_id)"
    _QUERIES[f"bin_{_name}"] = lambda s, d, c=_c, k=_s: _round(B.scaled(_bins(s, d), c, k), "y").select("series_id", "bin_start", "y")


@_query("bin_active_per_bin", f"WITH {_BIN} SELECT interval_id, CAST(bin_idx AS INTEGER) AS bin_idx, bin_start, CAST(sum(least(n, 1)) AS BIGINT) AS n_active FROM bins GROUP BY ALL")
def _(s, d):
    return B.active_per_bin(_bins(s, d)).withColumn("n_active", F.col("n_active").cast("long"))


@_query("bin_restrict_full", f"WITH {_BIN} SELECT series_id, b.interval_id, CAST(bin_idx AS INTEGER) AS bin_idx, bin_start, n FROM bins b JOIN win w ON b.interval_id = w.interval_id AND bin_start >= w.start + {HOUR // 2} AND bin_start + {HOUR} <= w.stop - {HOUR}")
def _(s, d):
    ev, win = _ev(s, d)
    part = win.select("interval_id", (F.col("start") + HOUR // 2).alias("start"), (F.col("stop") - HOUR).alias("stop"))
    return B.inside(_bins(s, d), part, HOUR).select("series_id", "interval_id", "bin_idx", "bin_start", "n")


@_query("bin_boxcar", f"WITH {_BIN} SELECT series_id, bin_start, round(avg(n) OVER (PARTITION BY series_id, interval_id ORDER BY bin_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS y FROM bins")
def _(s, d):
    return _round(B.rolling(_bins(s, d), 1, 1, how="avg"), "y").select("series_id", "bin_start", "y")


@_query("win_sum", f"WITH {_BIN} SELECT series_id, bin_start, CAST(sum(n) OVER (PARTITION BY series_id, interval_id ORDER BY bin_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS y FROM bins")
def _(s, d):
    return B.rolling(_bins(s, d), 2, 0).select("series_id", "bin_start", F.col("y").cast("long").alias("y"))


_G = gaussian_weights(1.5)
_KERNEL = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({i - len(_G) // 2}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(_G)) + ") AS t(off, w))"


@_query("smooth_gaussian_within", f"""WITH {_BIN}, {_KERNEL}, z AS (SELECT series_id, interval_id, max(bin_idx) + 1 AS m FROM bins GROUP BY ALL),
want AS (SELECT series_id, interval_id, bin_idx AS at, bin_start, m, w, ((bin_idx + off) % (2 * m) + 2 * m) % (2 * m) AS q FROM bins JOIN z USING (series_id, interval_id), k)
SELECT series_id, want.bin_start, round(sum(w * n), 6) AS y FROM want JOIN (SELECT series_id, interval_id, bin_idx, n FROM bins) v USING (series_id, interval_id)
WHERE v.bin_idx = CASE WHEN q < m THEN q ELSE 2 * m - 1 - q END GROUP BY series_id, want.bin_start""")
def _(s, d):
    return _round(B.smooth(_bins(s, d), _G, ["series_id", "interval_id"]), "y").select("series_id", "bin_start", "y")


@_query("smooth_gaussian_across", f"""WITH {_BIN}, {_KERNEL}, v AS (SELECT series_id, bin_start // {HOUR} AS i, n FROM bins)
SELECT a.series_id, a.i * {HOUR} AS bin_start, round(sum(w * b.n) / sum(w), 6) AS y FROM v a, k, v b WHERE a.series_id = b.series_id AND b.i = a.i + off GROUP BY ALL""")
def _(s, d):
    b = _bins(s, d).select("series_id", floordiv(F.col("bin_start"), HOUR).cast("int").alias("bin_idx"), "n", "bin_start")
    return _round(B.smooth(b, _G, ["series_id"], reflect=False), "y").select("series_id", "bin_start", "y")


# --- signals: mean value by series and hour ------------------------------------------------------

_SIG = f"{_EV}, sig AS (SELECT series_id, (t // {HOUR}) * {HOUR} AS t, round(avg(value), 6) AS y FROM ev GROUP BY ALL)"


def _sig(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy("series_id", (floordiv(F.col("t"), HOUR) * HOUR).alias("t")).agg(F.round(F.avg("value"), 6).alias("y"))


SK = ["series_id"]


@_query("sig_stats", f"WITH {_SIG} SELECT series_id, round(avg(y), 5) AS mean, round(stddev_pop(y), 5) AS std, round(median(y), 5) AS median, min(y) AS min, max(y) AS max, count(y) AS n FROM sig GROUP BY series_id")
def _(s, d):
    return _round(S.stats(_sig(s, d), SK), "mean", "std", "median", digits=5)


@_query("sig_zscore", f"WITH {_SIG} SELECT series_id, t, round((y - avg(y) OVER w) / nullif(stddev_pop(y) OVER w, 0), 6) AS z FROM sig WINDOW w AS (PARTITION BY series_id)")
def _(s, d):
    return _round(S.zscore(_sig(s, d), SK), "z").select("series_id", "t", "z")


@_query("sig_clip", f"WITH {_SIG} SELECT series_id, t, least(greatest(y, 50e0), 300e0) AS y FROM sig")
def _(s, d):
    return S.clip(_sig(s, d), 50.0, 300.0)


@_query("sig_gradient", f"""WITH {_SIG} SELECT series_id, t, round(coalesce((lead(y) OVER w - lag(y) OVER w) / 2, lead(y) OVER w - y, y - lag(y) OVER w, 0), 7) AS dy FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY t)""")
def _(s, d):
    return _round(S.gradient(_sig(s, d), SK, chunk=7 * DAY), "dy", digits=7).select("series_id", "t", "dy")


_GRID = f"p AS (SELECT series_id, t + {HOUR // 3} AS t FROM sig UNION SELECT series_id, t - {HOUR // 3} FROM sig)"


@_query("sig_interp", f"""WITH {_SIG}, {_GRID}, x AS (SELECT p.series_id, p.t, a.t AS t0, a.y AS y0 FROM p ASOF LEFT JOIN sig a ON p.series_id = a.series_id AND p.t >= a.t),
z AS (SELECT x.*, b.t AS t1, b.y AS y1 FROM x ASOF LEFT JOIN sig b ON x.series_id = b.series_id AND x.t <= b.t)
SELECT series_id, t, round(CASE WHEN t0 IS NULL THEN y1 WHEN t1 IS NULL OR t1 = t0 THEN y0 ELSE y0 + (y1 - y0) * ((t - t0) / (t1 - t0)) END, 7) AS y FROM z""")
def _(s, d):
    sig = _sig(s, d)
    points = sig.select("series_id", (F.col("t") + HOUR // 3).alias("t")).union(sig.select("series_id", F.col("t") - HOUR // 3)).distinct()
    return _round(S.interpolate(points, sig, SK), "y", digits=7)


@_query("sig_unwrap", f"""WITH {_EV}, h AS (SELECT user_id, t, CAST((t // {HOUR}) % 24 AS DOUBLE) AS y FROM ev),
j AS (SELECT *, y - lag(y) OVER (PARTITION BY user_id ORDER BY t) AS dy FROM h)
SELECT user_id, t, y + sum(CASE WHEN dy >= 12 THEN -24e0 WHEN dy < -12 THEN 24e0 ELSE 0e0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS unwrapped FROM j""")
def _(s, d):
    h = events(s, d).select("user_id", "t", F.pmod(floordiv(F.col("t"), HOUR), F.lit(24)).cast("double").alias("y"))
    return S.unwrap(h, ["user_id"], 24.0, chunk=7 * DAY).select("user_id", "t", "unwrapped")


@_query("sig_wrap", f"WITH {_SIG} SELECT series_id, t, round(y - floor(y / 90) * 90, 5) AS y FROM sig")
def _(s, d):
    return _round(S.wrap(_sig(s, d), 0.0, 90.0), "y", digits=5)


@_query("sig_add", f"WITH {_SIG} SELECT a.t, round(a.y + b.y, 5) AS y FROM sig a JOIN sig b USING (t) WHERE a.series_id = 'click' AND b.series_id = 'view'")
def _(s, d):
    sig = _sig(s, d)
    return _round(S.add(sig.where("series_id = 'click'").select("t", "y"), sig.where("series_id = 'view'").select("t", "y"), []), "y", digits=5)


@_query("sig_join_left", f"""WITH {_SIG} SELECT t, y FROM sig WHERE series_id = 'click' UNION ALL SELECT t, y FROM sig b WHERE series_id = 'view' AND NOT EXISTS (SELECT 1 FROM sig a WHERE a.series_id = 'click' AND a.t = b.t)""")
def _(s, d):
    sig = _sig(s, d)
    return S.join_left(sig.where("series_id = 'click'").select("t", "y"), sig.where("series_id = 'view'").select("t", "y"), [])


@_query("sig_histogram", f"WITH {_SIG} SELECT series_id, CAST(floor(y / 25) AS BIGINT) AS bin, count(*) AS n FROM sig GROUP BY ALL")
def _(s, d):
    return S.histogram(_sig(s, d), SK, 25.0)


@_query("sig_cdf", f"WITH {_SIG} SELECT series_id, t, round(cume_dist() OVER (PARTITION BY series_id ORDER BY y), 9) AS p FROM sig")
def _(s, d):
    return _round(S.cdf(_sig(s, d), SK, width=50.0), "p", digits=9).select("series_id", "t", "p")


@_query("geo_path_length", f"""WITH {_EV}, g AS (SELECT user_id, sqrt(power(value - lag(value) OVER w, 2) + power(h - lag(h) OVER w, 2)) AS d FROM (SELECT user_id, t, value, CAST(t AS DOUBLE) / {HOUR} AS h FROM ev) WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(coalesce(sum(d), 0), 4) AS length FROM g GROUP BY user_id""")
def _(s, d):
    p = events(s, d).withColumn("h", F.col("t").cast("double") / HOUR)
    return _round(S.path_length(p, ["user_id"], "value", "h"), "length", digits=4)


# --- detection on flattened hourly counts over whole days --------------------------------------

_HOURS = f"""{_EV}, n AS (SELECT t // {DAY} AS day, (t // {HOUR}) % 24 AS h, count(*) AS n FROM ev GROUP BY ALL),
hours AS (SELECT day, h, coalesce(n, 0) AS n FROM (SELECT DISTINCT day FROM n) CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS h) LEFT JOIN n USING (day, h))"""


def _hours(s: SparkSession, d: str) -> DataFrame:
    ev = events(s, d)
    n = ev.groupBy(floordiv(F.col("t"), DAY).alias("day"), F.pmod(floordiv(F.col("t"), HOUR), F.lit(24)).alias("h")).agg(F.count("*").alias("n"))
    return n.select("day").distinct().withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long")))).join(n, ["day", "h"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _runs_sql(flag: str) -> str:
    return f"""SELECT day, min(h) AS first, max(h) AS last, max(n) AS best FROM (SELECT *, sum(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY h ROWS UNBOUNDED PRECEDING) AS g FROM lv) WHERE {flag} GROUP BY day, g"""


for _name, _mode, _flag, _thr in (("above", "above", "n >= 15", 15), ("below", "below", "n <= 12", 12)):
    _SQL[f"thr_runs_{_name}"] = f"WITH {_HOURS}, lv AS (SELECT * FROM hours) {_runs_sql(_flag)}"
    _QUERIES[f"thr_runs_{_name}"] = lambda s, d, m=_mode, t=_thr: X.crossings(_hours(s, d), ["day"], "h", "n", t, m)


@_query("thr_event_boundaries", f"""WITH {_HOURS}, lv AS (SELECT *, n >= avg(n) OVER (PARTITION BY day) + stddev_pop(n) OVER (PARTITION BY day) AS hi, n >= avg(n) OVER (PARTITION BY day) AS lo FROM hours),
i AS ({_runs_sql('hi')}), o AS ({_runs_sql('lo')})
SELECT DISTINCT o.day, o.first AS start, o.last AS stop, CAST(o.best AS DOUBLE) AS best FROM i JOIN o ON i.day = o.day AND o.first <= i.first AND i.last <= o.last WHERE o.last - o.first + 1 BETWEEN 2 AND 8""")
def _(s, d):
    return X.boundaries(_hours(s, d), ["day"], "h", "n", 1.0, 1, 2, 8)


# --- tuning curves: series by hour of day (and weekday) ----------------------------------------

_TB = f"{_EV}, tb AS (SELECT t_bin, t_bin % 24 AS h, (t_bin // 24) % 7 AS wd FROM (SELECT DISTINCT t // {HOUR} AS t_bin FROM ev)), cn AS (SELECT series_id, t // {HOUR} AS t_bin, count(*) AS n FROM ev GROUP BY ALL)"


def _rates_sql(axes: str, floor: str = "0") -> str:
    return f"""occ AS (SELECT {axes}, count(*) AS occupancy FROM tb GROUP BY {axes}), cs AS (SELECT series_id, {axes}, sum(n) AS n FROM cn JOIN tb USING (t_bin) GROUP BY series_id, {axes}),
r AS (SELECT series_id, {axes}, occupancy, greatest(coalesce(n, 0) / greatest(occupancy, 1), {floor}) AS rate FROM (SELECT DISTINCT series_id FROM cn) CROSS JOIN occ LEFT JOIN cs USING (series_id, {axes}))"""


def _tuning(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = events(s, d).withColumn("t_bin", floordiv(F.col("t"), HOUR))
    bins = ev.select("t_bin").distinct().withColumn("h", F.pmod("t_bin", F.lit(24))).withColumn("wd", F.pmod(floordiv(F.col("t_bin"), 24), F.lit(7)))
    return ev.groupBy("series_id", "t_bin").agg(F.count("*").alias("n")), bins


@_query("tc_occupancy", f"WITH {_TB} SELECT h, wd, count(*) AS occupancy FROM tb GROUP BY ALL")
def _(s, d):
    return R.occupancy(_tuning(s, d)[1], ["h", "wd"])


@_query("tc_ratemap_1d", f"WITH {_TB}, {_rates_sql('h', '0.01e0')} SELECT series_id, h, occupancy, round(rate, 6) AS rate FROM r")
def _(s, d):
    return _round(R.rate_map(*_tuning(s, d), ["h"], 0.01), "rate")


@_query("tc_ratemap_2d", f"WITH {_TB}, {_rates_sql('h, wd')} SELECT series_id, h, wd, occupancy, round(rate, 6) AS rate FROM r")
def _(s, d):
    return _round(R.rate_map(*_tuning(s, d), ["h", "wd"]), "rate")


_INFO = """q AS (SELECT *, occupancy / sum(occupancy) OVER (PARTITION BY series_id) AS p FROM r), q2 AS (SELECT *, sum(p * rate) OVER (PARTITION BY series_id) AS m FROM q),
q3 AS (SELECT series_id, max(m) AS mean_rate, sum(CASE WHEN rate > 0 THEN p * (rate / m) * log2(rate / m) ELSE 0 END) AS si, max(rate) AS mx, sum(p * rate * rate) AS sq FROM q2 GROUP BY series_id)"""


@_query("tc_information", f"WITH {_TB}, {_rates_sql('h')}, {_INFO} SELECT series_id, round(mean_rate, 6) AS mean_rate, round(si, 6) AS si, round(si * mean_rate, 6) AS info_rate, round(mx / mean_rate, 6) AS selectivity, round(mean_rate * mean_rate / sq, 6) AS sparsity FROM q3")
def _(s, d):
    return _round(R.information(R.rate_map(*_tuning(s, d), ["h"])), "mean_rate", "si", "info_rate", "selectivity", "sparsity")


@_query("tc_normalised", f"WITH {_TB}, {_rates_sql('h')} SELECT series_id, h, round(rate / max(rate) OVER (PARTITION BY series_id), 6) AS rate FROM r")
def _(s, d):
    return _round(R.normalised(R.rate_map(*_tuning(s, d), ["h"])), "rate").select("series_id", "h", "rate")


@_query("tc_peak_order", f"""WITH {_TB}, {_rates_sql('h')}, pk AS (SELECT DISTINCT ON (series_id) series_id, h AS peak FROM r ORDER BY series_id, rate DESC, h)
SELECT series_id, peak, CAST(row_number() OVER (ORDER BY peak, series_id) AS INTEGER) AS place FROM pk""")
def _(s, d):
    return R.peaks(R.rate_map(*_tuning(s, d), ["h"]), "h")


@_query("tc_directional", f"""WITH {_TB}, lr AS (SELECT series_id, h, avg(n) AS rate FROM cn JOIN tb USING (t_bin) WHERE wd < 3 GROUP BY ALL), rl AS (SELECT series_id, h, avg(n) AS rate FROM cn JOIN tb USING (t_bin) WHERE wd >= 3 GROUP BY ALL),
lo AS (SELECT series_id FROM lr GROUP BY series_id HAVING max(rate) > 4 AND avg(rate) < 10), ro AS (SELECT series_id FROM rl GROUP BY series_id HAVING max(rate) > 4 AND avg(rate) < 10)
SELECT series_id, 'lr' AS direction, h, round(rate, 6) AS rate FROM lr WHERE series_id IN (FROM lo) UNION ALL SELECT series_id, 'rl', h, round(rate, 6) FROM rl WHERE series_id IN (FROM ro) AND series_id NOT IN (FROM lo)""")
def _(s, d):
    counts, bins = _tuning(s, d)
    r = counts.join(bins, "t_bin")
    lr = r.where("wd < 3").groupBy("series_id", "h").agg(F.avg("n").alias("rate"))
    rl = r.where("wd >= 3").groupBy("series_id", "h").agg(F.avg("n").alias("rate"))
    return _round(R.directional(lr, rl, ["h"], 4.0, 10.0), "rate")


# --- decoding ------------------------------------------------------------------------------------

_POST = f"""{_TB}, {_rates_sql('h', '0.01e0')}, tot AS (SELECT h, sum(rate) AS sr FROM r GROUP BY h),
ll AS (SELECT t_bin, r.h, sum(n * ln(rate)) - max(sr) AS lp FROM cn JOIN r USING (series_id) JOIN tot ON tot.h = r.h GROUP BY t_bin, r.h),
e AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY t_bin)) AS x FROM ll), post AS (SELECT t_bin, h, x / sum(x) OVER (PARTITION BY t_bin) AS p FROM e),
mode AS (SELECT DISTINCT ON (t_bin) t_bin, h AS mode FROM post ORDER BY t_bin, round(p, 9) DESC, h), mean AS (SELECT t_bin, sum(p * (h + 0.5e0)) AS mean FROM post GROUP BY t_bin)"""


def _posterior(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts, bins = _tuning(s, d)
    return D.posterior(counts, R.rate_map(counts, bins, ["h"], 0.01), "h"), bins.select("t_bin", F.col("h").alias("x"))


@_query("dec_posterior_1d", f"WITH {_POST} SELECT t_bin, h, round(p, 6) AS p FROM post")
def _(s, d):
    return _round(_posterior(s, d)[0], "p")


@_query("dec_mode_path", f"WITH {_POST} SELECT t_bin, mode FROM mode")
def _(s, d):
    return D.mode_path(_posterior(s, d)[0], "h")


@_query("dec_mean_path", f"WITH {_POST} SELECT t_bin, round(mean, 6) AS mean FROM mean")
def _(s, d):
    return _round(D.mean_path(_posterior(s, d)[0], "h"), "mean")


@_query("dec_rmse", f"WITH {_POST} SELECT round(sqrt(avg(power(mean - tb.h, 2))), 6) AS rmse, count(*) AS n FROM mean JOIN tb USING (t_bin)")
def _(s, d):
    post, truth = _posterior(s, d)
    return _round(D.rmse(D.mean_path(post, "h"), truth, "mean"), "rmse")


@_query("dec_error_cdf", f"WITH {_POST}, er AS (SELECT abs(mode - tb.h) AS error, count(*) AS n FROM mode JOIN tb USING (t_bin) GROUP BY ALL) SELECT error, round(sum(n) OVER (ORDER BY error ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS share FROM er")
def _(s, d):
    post, truth = _posterior(s, d)
    return _round(D.error_cdf(D.mode_path(post, "h"), truth, "mode"), "share", digits=9)


# --- states ----------------------------------------------------------------------------------------

_MK = f"""{_EV}, nx AS (SELECT series_id AS i, lead(series_id) OVER (PARTITION BY user_id ORDER BY t, event_id) AS j FROM ev), tn AS (SELECT i, j, count(*) AS n FROM nx WHERE j IS NOT NULL GROUP BY i, j),
tr AS (SELECT *, n / sum(n) OVER (PARTITION BY i) AS p FROM tn)"""
_ORDER = ["t", "event_id"]


def _trans(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = events(s, d)
    return ev, M.transitions(ev, ["user_id"], "series_id", _ORDER)


@_query("mk_transmat", f"WITH {_MK} SELECT i, j, n, round(p, 9) AS p FROM tr")
def _(s, d):
    return _round(_trans(s, d)[1], "p", digits=9)


def _score_sql(src: str) -> str:
    return f"""st AS (SELECT user_id, series_id AS i, lead(series_id) OVER (PARTITION BY user_id ORDER BY t, event_id) AS j FROM {src})
SELECT user_id, round(coalesce(sum(ln(p)), 0) - ln(count(*)), 6) AS score, count(*) AS length FROM st LEFT JOIN tr USING (i, j) GROUP BY user_id"""


@_query("mk_order_score", f"WITH {_MK}, {_score_sql('ev')}")
def _(s, d):
    ev, trans = _trans(s, d)
    return _round(M.order_score(ev, trans, ["user_id"], "series_id", _ORDER), "score")


@_query("mk_order_score_nd", f"WITH {_MK}, nd AS (SELECT * FROM (SELECT *, lag(series_id) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM ev) WHERE b IS NULL OR b <> series_id), {_score_sql('nd')}")
def _(s, d):
    ev, trans = _trans(s, d)
    return _round(M.order_score(ev, trans, ["user_id"], "series_id", _ORDER, collapse_repeats=True), "score")


@_query("mk_state_diversity", f"WITH {_EV} SELECT user_id, count(DISTINCT series_id) AS n_states, round(count(DISTINCT series_id) / count(*), 9) AS diversity FROM ev GROUP BY user_id")
def _(s, d):
    return _round(M.diversity(events(s, d), ["user_id"], "series_id"), "diversity", digits=9)


@_query("mk_gini", f"WITH {_EV}, g AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev) SELECT user_id, round(sum((2 * i - n - 1) * value) / (max(n) * sum(value)), 6) AS gini FROM g GROUP BY user_id")
def _(s, d):
    return _round(M.gini(events(s, d), ["user_id"], "value"), "gini")


@_query("rp_linregress", f"WITH {_EV}, x AS (SELECT user_id, CAST(t - min(t) OVER (PARTITION BY user_id) AS DOUBLE) / {DAY} AS x, value AS y FROM ev) SELECT user_id, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM x GROUP BY user_id")
def _(s, d):
    x = (F.col("t") - F.min("t").over(Window.partitionBy("user_id"))).cast("double") / DAY
    g = events(s, d).withColumn("x", x).groupBy("user_id").agg(F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"), F.regr_r2("value", "x").alias("r2"))
    return _round(g, "slope", "intercept", "r2")


@_query("rp_significant", f"""WITH {_EV}, sc AS (SELECT user_id, sum(value) AS score, count(*) AS n FROM ev WHERE series_id = 'purchase' GROUP BY user_id),
nul AS (SELECT user_id, event_id % 97 AS k, sum(value) AS score FROM ev GROUP BY ALL)
SELECT sc.user_id, round((1 + count(*) FILTER (WHERE nul.score >= sc.score)) / (count(*) + 1), 9) AS p FROM sc JOIN nul USING (user_id) GROUP BY sc.user_id""")
def _(s, d):
    ev = events(s, d)
    score = ev.where("series_id = 'purchase'").groupBy("user_id").agg(F.sum("value").alias("score"))
    null = ev.groupBy("user_id", (F.col("event_id") % 97).alias("k")).agg(F.sum("value").alias("_n"))
    p = (1 + F.sum(F.when(F.col("_n") >= F.col("score"), 1).otherwise(0))) / (F.count("*") + 1)
    return _round(score.join(null, "user_id").groupBy("user_id").agg(p.alias("p")), "p", digits=9)
