"""Registered queries of selections, pieces of intervals, arithmetic, grids, bursts and tracks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import texts as X
from ..functions.timeops import DAY, HOUR, floordiv
from ..operators import binned as B
from ..operators import detect as D
from ..operators import filters as Z
from ..operators import geometry as G
from ..operators import intervals as I
from ..operators import selection as L
from ..operators import signals as S
from .catalogue import _A, _B, _BIN, _EV, _G, _HOURS, _KERNEL, _QUERIES, _SIG, _WIN, K, SK, _a, _b, _bins, _ev, _hours, _merged, _query, _round, _sig

# --- selections --------------------------------------------------------------------------------


@_query("sel_series_labels", f"WITH {_EV} SELECT event_id, series_id, t FROM ev WHERE series_id IN ('view', 'click')")
def _(s, d):
    return L.series_by_label(_ev(s, d)[0], ["view", "click"]).select("event_id", "series_id", "t")


@_query("sel_series_label_range", f"WITH {_EV} SELECT event_id, series_id, t FROM ev WHERE series_id BETWEEN 'error' AND 'signup'")
def _(s, d):
    return L.series_by_label(_ev(s, d)[0], first="error", last="signup").select("event_id", "series_id", "t")


@_query("sel_series_places", f"WITH {_EV} SELECT event_id, series_id, t FROM (SELECT *, dense_rank() OVER (ORDER BY series_id) - 1 AS p FROM ev) WHERE p >= 1 AND p < 5 AND (p - 1) % 2 = 0")
def _(s, d):
    return L.series_by_place(_ev(s, d)[0], slice(1, 5, 2)).select("event_id", "series_id", "t")


@_query("sel_places_from_the_end", f"WITH {_A}, n AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY start, stop) - 1 AS i, count(*) OVER (PARTITION BY set_id) AS n FROM a) SELECT set_id, start, stop FROM n WHERE i >= greatest(n - 4, 0) AND i < greatest(n - 1, 0) AND (i - greatest(n - 4, 0)) % 2 = 0")
def _(s, d):
    return L.intervals_by_place(_a(s, d), K, slice(-4, -1, 2))


@_query("sel_user_places", f"WITH {_EV} SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT user_id FROM ev)")
def _(s, d):
    return L.places(_ev(s, d)[0], "user_id").withColumnRenamed("key", "user_id")


@_query("sel_interval_places", f"WITH {_A} SELECT set_id, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY start, stop) - 1 AS i FROM a) WHERE i >= 1 AND (i - 1) % 2 = 0")
def _(s, d):
    return L.intervals_by_place(_a(s, d), K, slice(1, None, 2))


@_query("sel_intervals_listed", f"WITH {_A} SELECT set_id, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY start, stop) - 1 AS i FROM a) WHERE i IN (0, 3)")
def _(s, d):
    return I.at_places(_a(s, d), K, [0, 3])


@_query("sel_events_and_series", f"WITH {_EV}, {_WIN} SELECT event_id, series_id, t FROM ev WHERE series_id IN ('view', 'error') AND EXISTS (SELECT 1 FROM win WHERE t >= start AND t < stop)")
def _(s, d):
    ev, win = _ev(s, d)
    return L.selected(ev, win, labels=["view", "error"]).select("event_id", "series_id", "t")


@_query("sel_reordered", "SELECT series_id, CAST(place AS BIGINT) AS place FROM (SELECT DISTINCT event_type AS series_id, list_position(['view', 'click', 'error'], event_type) - 1 AS place FROM events) WHERE place >= 0")
def _(s, d):
    return L.reordered(_ev(s, d)[0], ["view", "click", "error"]).withColumn("place", F.col("place").cast("long"))


@_query("sel_empty_kept", f"WITH {_EV}, c AS (SELECT series_id, count(*) AS n FROM ev WHERE value > 489 AND user_id < 20 GROUP BY series_id) SELECT series_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT series_id FROM ev) LEFT JOIN c USING (series_id)")
def _(s, d):
    ev = _ev(s, d)[0]
    return L.with_empty(ev.where("value > 489 and user_id < 20").groupBy("series_id").agg(F.count("*").alias("n")), ev, "n")


@_query("sel_bins_by_index", f"""WITH {_BIN}, g AS (SELECT *, dense_rank() OVER (ORDER BY interval_id, bin_idx) - 1 AS p FROM bins), w AS (SELECT * FROM (VALUES (0, 3, 9), (1, 20, 24)) AS t(piece, lo, hi))
SELECT series_id, CAST(piece AS INTEGER) AS interval_id, CAST(p - lo AS INTEGER) AS bin_idx, n FROM g JOIN w ON p BETWEEN lo AND hi""")
def _(s, d):
    return L.bins_by_index(_bins(s, d), [(3, 9), (20, 24)])


@_query("sel_sample_ranges", f"""WITH {_SIG}, {_WIN}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i FROM sig)
SELECT series_id, interval_id, CAST(min(i) AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last FROM x JOIN win ON x.t >= start AND x.t < stop GROUP BY ALL""")
def _(s, d):
    return L.sample_ranges(_sig(s, d), _ev(s, d)[1], 4 * HOUR, width=30 * DAY)


# --- intervals ---------------------------------------------------------------------------------

@_query("iv_pieces", f"""WITH {_A}, {_merged('a', 'm')}, o AS (SELECT *, coalesce(sum(stop - start) OVER (PARTITION BY set_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, sum(stop - start) OVER (PARTITION BY set_id) AS t FROM m),
c AS (SELECT set_id, k AS piece, greatest(start, start + CAST(floor(t * k / 5) AS BIGINT) - o) AS a, least(stop, start + CAST(floor(t * (k + 1) / 5) AS BIGINT) - o) AS z FROM o, (SELECT unnest(generate_series(0, 4)) AS k) WHERE t > 0 AND stop > start)
SELECT set_id, CAST(piece AS BIGINT) AS piece, CAST(a AS BIGINT) AS start, CAST(z AS BIGINT) AS stop FROM c WHERE a < z""")
def _(s, d):
    return I.pieces(_a(s, d), K, 5)


@_query("iv_from_starts", f"WITH {_A} SELECT set_id, start, start + {DAY} AS stop FROM a")
def _(s, d):
    return I.checked(I.from_starts(_a(s, d).select("set_id", "start"), DAY))


@_query("iv_drop_empty", f"WITH {_A} SELECT set_id, start, greatest(stop - {60 * DAY}, start) AS stop FROM a WHERE stop - {60 * DAY} > start")
def _(s, d):
    return I.drop_empty(_a(s, d).withColumn("stop", F.greatest(F.col("stop") - 60 * DAY, F.col("start"))))


@_query("iv_intersect_keyed_buckets", f"WITH {_A}, {_B} SELECT set_id, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM a JOIN b USING (set_id) WHERE a.start < b.stop AND b.start < a.stop")
def _(s, d):
    return I.intersect(_a(s, d), _b(s, d), K, bucket=60 * DAY)


# --- signals -----------------------------------------------------------------------------------

@_query("sig_scaled", f"""WITH {_SIG}, m AS (SELECT series_id, avg(y) AS m, stddev_pop(y) AS s FROM sig GROUP BY series_id)
SELECT series_id, t, round(y - m, 5) AS centered, round(y / CASE WHEN s = 0 THEN 1 ELSE s END, 5) AS normalized, round((y - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 5) AS standardized FROM sig JOIN m USING (series_id)""")
def _(s, d):
    sig = _sig(s, d)
    c, n, z = (S.scaled(sig, SK, *how).withColumnRenamed("y", name) for how, name in (((True, False), "centered"), ((False, True), "normalized"), ((True, True), "standardized")))
    return _round(c.join(n, ["series_id", "t"]).join(z, ["series_id", "t"]), "centered", "normalized", "standardized", digits=5)


@_query("sig_arithmetic", f"""WITH {_SIG}, o AS (SELECT series_id, t, round(y / 2 + 1, 6) AS o FROM sig WHERE (t // {HOUR}) % 3 <> 0)
SELECT series_id, t, round(y + 5, 5) AS plus_number, round(y - o, 5) AS minus_signal, round(y * CASE series_id WHEN 'view' THEN 2e0 WHEN 'click' THEN 3e0 END, 5) AS times_own, round(y / nullif(o, 0), 5) AS over_signal FROM sig JOIN o USING (series_id, t)""")
def _(s, d):
    sig = _sig(s, d)
    o = sig.where((floordiv(F.col("t"), HOUR) % 3) != 0).withColumn("y", F.round(F.col("y") / 2 + 1, 6))
    cols = {"plus_number": (5.0, "+"), "minus_signal": (o, "-"), "times_own": ({"view": 2.0, "click": 3.0}, "*"), "over_signal": (o, "/")}
    out = None
    for name, (b, op) in cols.items():
        one = S.combined(sig, b, op, SK).withColumnRenamed("y", name)
        out = one if out is None else out.join(one, ["series_id", "t"])
    return _round(out, *cols, digits=5)


@_query("sig_complex", f"WITH {_EV} SELECT event_id, round(sqrt(re * re + im * im), 6) AS \"abs\", round(atan2(im, re), 6) AS angle FROM (SELECT event_id, value - 245 AS re, CAST((t // {HOUR}) % 24 - 12 AS DOUBLE) AS im FROM ev)")
def _(s, d):
    ev = _ev(s, d)[0].select("event_id", (F.col("value") - 245).alias("re"), (F.pmod(floordiv(F.col("t"), HOUR), F.lit(24)) - 12).cast("double").alias("im"))
    return _round(S.complex_parts(ev), "abs", "angle").select("event_id", "abs", "angle")


@_query("sig_shift_trim", f"WITH {_SIG} SELECT series_id, t + {DAY} AS t, y FROM sig WHERE t BETWEEN {1704326400000000 - DAY} AND {1704931200000000 - DAY}")
def _(s, d):
    return S.trimmed(S.shifted(_sig(s, d), DAY), 1704326400000000, 1704931200000000)


@_query("sig_sampling", f"""WITH {_SIG}, x AS (SELECT *, lead(t) OVER (PARTITION BY series_id ORDER BY t) - t AS dt FROM sig)
SELECT series_id, count(*) AS n_samples, CAST(quantile_cont(dt, 0.5) AS DOUBLE) AS step, min(t) AS first, max(t) AS last, min(y) AS low, max(y) AS high FROM x GROUP BY series_id""")
def _(s, d):
    return S.sampling(_sig(s, d), SK, width=30 * DAY)


_LERP = """x AS (SELECT p.series_id, p.t, a.t AS t0, a.y AS y0 FROM p ASOF LEFT JOIN sig a ON p.series_id = a.series_id AND p.t >= a.t),
z AS (SELECT x.*, b.t AS t1, b.y AS y1 FROM x ASOF LEFT JOIN sig b ON x.series_id = b.series_id AND x.t <= b.t)
SELECT series_id, t, round(CASE WHEN t0 IS NULL THEN y1 WHEN t1 IS NULL OR t1 = t0 THEN y0 ELSE y0 + (y1 - y0) * ((t - t0) / (t1 - t0)) END, 6) AS y FROM z"""


@_query("sig_subsample", f"WITH {_SIG}, e AS (SELECT series_id, min(t) AS a, max(t) AS b FROM sig GROUP BY series_id), p AS (SELECT series_id, unnest(generate_series(a, b, {5 * HOUR // 3})) AS t FROM e), {_LERP}")
def _(s, d):
    return _round(S.regridded(_sig(s, d), SK, 5 * HOUR // 3), "y")


@_query("sig_simplify", f"""WITH {_SIG}, e AS (SELECT series_id, min(t) AS a, max(t) AS b FROM sig GROUP BY series_id),
p AS (SELECT DISTINCT series_id, CASE WHEN k = 49 THEN b ELSE a + CAST(floor((b - a) * k / 49) AS BIGINT) END AS t FROM e, (SELECT unnest(generate_series(0, 49)) AS k)), {_LERP}""")
def _(s, d):
    return _round(S.simplified(_sig(s, d), SK, 50), "y")


@_query("sig_interp_chunked", f"WITH {_SIG}, p AS (SELECT series_id, t + {HOUR // 3} AS t FROM sig UNION SELECT series_id, t - {HOUR // 3} FROM sig), {_LERP}")
def _(s, d):
    sig = _sig(s, d)
    points = sig.select("series_id", (F.col("t") + HOUR // 3).alias("t")).union(sig.select("series_id", F.col("t") - HOUR // 3)).distinct()
    return _round(S.interpolate(points, sig, SK, chunk=3 * DAY), "y")


@_query("sig_mean_decimated", f"WITH {_SIG} SELECT series_id, (t // {6 * HOUR}) * {6 * HOUR} AS t, round(avg(y), 5) AS y, count(*) AS n FROM sig GROUP BY ALL")
def _(s, d):
    return _round(S.tumbling(_sig(s, d), SK, 6 * HOUR), "y", digits=5)


@_query("sig_lengths", f"WITH {_SIG}, {_WIN} SELECT series_id, interval_id, count(*) AS n_samples FROM sig JOIN win ON sig.t >= start AND sig.t < stop GROUP BY ALL")
def _(s, d):
    from ..operators.events import restrict

    return S.lengths(restrict(_sig(s, d), _ev(s, d)[1]), SK)


@_query("sig_melted", f"WITH {_EV}, w AS (SELECT user_id, t, value, CAST(event_id AS DOUBLE) AS number FROM ev) UNPIVOT (SELECT user_id, t, value, number FROM w) ON value, number INTO NAME signal VALUE y")
def _(s, d):
    ev = _ev(s, d)[0].select("user_id", "t", "value", F.col("event_id").cast("double").alias("number"))
    return S.melted(ev, ["user_id"], ["value", "number"])


@_query("sig_with_signal", f"WITH {_SIG} SELECT series_id, t, y, round(y * 2, 6) AS twice FROM sig")
def _(s, d):
    sig = _sig(s, d)
    return S.with_signal(sig, sig.withColumn("y", F.round(F.col("y") * 2, 6)), SK, "twice")


_TRACK = f"tr AS (SELECT user_id, t, value AS x, CAST((t // {HOUR}) % 24 AS DOUBLE) AS y FROM ev)"


def _track(s, d):
    return _ev(s, d)[0].select("user_id", "t", F.col("value").alias("x"), F.pmod(floordiv(F.col("t"), HOUR), F.lit(24)).cast("double").alias("y"))


@_query("sig_velocity", f"""WITH {_EV}, {_TRACK}, g AS (SELECT *, {', '.join(f"coalesce((lead({c}) OVER w - lag({c}) OVER w) / 2, lead({c}) OVER w - {c}, {c} - lag({c}) OVER w, 0) AS d{c}" for c in 'xy')} FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, t, round(sqrt(dx * dx + dy * dy), 6) AS speed, round(atan2(dy, dx), 6) AS heading FROM g""")
def _(s, d):
    return _round(S.velocity(_track(s, d), ["user_id"], "x", "y"), "speed", "heading").select("user_id", "t", "speed", "heading")


@_query("sig_directions", f"""WITH {_SIG}, g AS (SELECT *, CAST(sign(coalesce((lead(y) OVER w - lag(y) OVER w) / 2, lead(y) OVER w - y, y - lag(y) OVER w, 0)) AS INTEGER) AS direction FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY t)),
n AS (SELECT *, CASE WHEN direction <> lag(direction) OVER (PARTITION BY series_id ORDER BY t) THEN 1 ELSE 0 END AS n FROM g), r AS (SELECT *, sum(n) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM n)
SELECT series_id, direction, min(t) AS start, max(t) AS stop FROM r WHERE direction <> 0 GROUP BY series_id, r, direction""")
def _(s, d):
    return S.directions(_sig(s, d), SK, width=30 * DAY)


@_query("sig_power", f"""WITH {_SIG}, c AS (SELECT series_id, y - avg(y) OVER (PARTITION BY series_id) AS y, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM sig),
f AS (SELECT series_id, k, n, sum(y * cos(k * i * {2 * math.pi!r} / n)) AS c, sum(y * sin(k * i * {2 * math.pi!r} / n)) AS s FROM c, (SELECT unnest([1, 7, 30, 60]) AS k) GROUP BY ALL)
SELECT series_id, CAST(k AS INTEGER) AS k, round((CASE WHEN 2 * k < n THEN 2 ELSE 1 END) * (c * c + s * s) / n, 3) AS power FROM f""")
def _(s, d):
    return _round(S.power(_sig(s, d), SK, [1, 7, 30, 60]), "power", digits=3)


# Filters have no SQL; tests hold them against recursions and sines.
def _regular(s, d):
    return _hours(s, d).select(F.lit("all").alias("series_id"), ((F.col("day") * 24 + F.col("h")) * HOUR).alias("t"), F.col("n").cast("double").alias("y"))


_QUERIES["flt_low_pass"] = lambda s, d: _round(Z.zero_phase(_regular(s, d), SK, 24.0, high=2.0, chunk=256, halo=96, width=30 * DAY), "y")
_QUERIES["flt_band_stop"] = lambda s, d: _round(Z.zero_phase(_regular(s, d), SK, 24.0, low=2.0, high=4.0, bandstop=True, chunk=256, halo=96, width=30 * DAY), "y")
_QUERIES["flt_envelope"] = lambda s, d: _round(Z.envelope(_regular(s, d), SK, 24.0, sigma=0.1, chunk=1 << 12, halo=96, width=30 * DAY), "y")
_QUERIES["flt_decimated"] = lambda s, d: _round(Z.decimated(_regular(s, d), SK, 24.0, 6.0, chunk=256, halo=96, width=30 * DAY), "y")
_QUERIES["flt_bursts"] = lambda s, d: Z.ripples(_regular(s, d), SK, 24.0, 2.0, 5.0, sigmas=1.0, least=0.05, chunk=1 << 12, halo=96, width=30 * DAY)


# --- bins --------------------------------------------------------------------------------------

@_query("bin_arithmetic", f"""WITH {_BIN} SELECT series_id, interval_id, CAST(bin_idx AS INTEGER) AS bin_idx, n * 2e0 AS twice, n + n * n AS plus, n / nullif(n * 1e0, 0) AS own_share FROM bins""")
def _(s, d):
    b = _bins(s, d)
    at = ["series_id", "interval_id", "bin_idx"]
    square = b.withColumn("n", F.col("n") * F.col("n"))
    return (B.combined(b, 2, "*").select(*at, F.col("n").alias("twice")).join(B.combined(b, square, "+").select(*at, F.col("n").alias("plus")), at)
            .join(B.combined(b.withColumn("n", F.col("n") * 1.0), b, "/").select(*at, F.col("n").alias("own_share")), at))


@_query("bin_centers", f"""WITH {_BIN}, z AS (SELECT interval_id, max(bin_idx) + 1 AS n_bins, min(bin_start) AS first, max(bin_start) + {HOUR} AS last FROM bins GROUP BY interval_id)
SELECT interval_id, CAST(n_bins AS INTEGER) AS n_bins, first, last, coalesce(sum(n_bins) OVER (ORDER BY interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n_bins - 1) / 2e0 AS midpoint FROM z""")
def _(s, d):
    return B.centers(_bins(s, d), HOUR)


@_query("bin_without_last", f"WITH {_BIN} SELECT series_id, interval_id, CAST(bin_idx AS INTEGER) AS bin_idx, n FROM (SELECT *, max(bin_idx) OVER (PARTITION BY interval_id) AS m FROM bins) WHERE bin_idx < m")
def _(s, d):
    return B.without_last(_bins(s, d)).select("series_id", "interval_id", "bin_idx", "n")


@_query("bin_from_signal", f"""WITH {_SIG}, {_WIN} SELECT series_id, interval_id, CAST(row_number() OVER (PARTITION BY series_id, interval_id ORDER BY t) - 1 AS INTEGER) AS bin_idx, t AS bin_start, y AS n FROM sig JOIN win ON sig.t >= start AND sig.t < stop""")
def _(s, d):
    return B.from_signal(_sig(s, d), _ev(s, d)[1], HOUR, 4 * HOUR)


@_query("win_partial_scaler", f"""WITH {_BIN}, m AS (SELECT series_id, avg(n) AS m, stddev_pop(n) AS s FROM bins GROUP BY series_id)
SELECT series_id, interval_id, CAST(bin_idx AS INTEGER) AS bin_idx, round((n - m) / CASE WHEN s < 1e-9 THEN 1 ELSE s END, 5) AS y, CAST(n AS DOUBLE) AS back FROM bins JOIN m USING (series_id)""")
def _(s, d):
    b = _bins(s, d)
    fit = B.Moments(["series_id"]).partial_fit(b.where("interval_id % 2 = 0")).partial_fit(b.where("interval_id % 2 = 1"))
    both = fit.inverse_transform(fit.transform(b).withColumnRenamed("n", "was")).withColumnRenamed("n", "back")
    return _round(both, "y", "back", digits=5).select("series_id", "interval_id", "bin_idx", "y", "back")


@_query("val_smooth", f"""WITH {_SIG}, {_KERNEL}, v AS (SELECT series_id, t // {HOUR} AS i, y FROM sig)
SELECT a.series_id, a.i AS bin_idx, round(sum(w * b.y) / sum(w), 5) AS y FROM v a, k, v b WHERE a.series_id = b.series_id AND b.i = a.i + off GROUP BY ALL""")
def _(s, d):
    b = _sig(s, d).select("series_id", floordiv(F.col("t"), HOUR).alias("bin_idx"), F.col("y").alias("v"))
    b = b.withColumn("bin_idx", F.col("bin_idx").cast("int"))
    return _round(B.smooth(b, _G, ["series_id"], v="v", reflect=False), "y", digits=5).select("series_id", F.col("bin_idx").cast("long").alias("bin_idx"), "y")


# --- bursts and runs -----------------------------------------------------------------------------

_MUA = f"""{_EV}, {_WIN}, c AS (SELECT interval_id, start + i * {HOUR // 4} AS bin_start, i AS bin_idx FROM (SELECT *, unnest(generate_series(0, (stop - start) // {HOUR // 4} - 1)) AS i FROM win)),
f AS (SELECT interval_id, (t - start) // {HOUR // 4} AS bin_idx, count(*) AS n FROM ev JOIN win ON t >= start AND t < stop GROUP BY ALL),
mua AS (SELECT interval_id, bin_idx, bin_start, coalesce(n, 0) * {1_000_000 / (HOUR // 4)!r} AS rate FROM c LEFT JOIN f USING (interval_id, bin_idx))"""


@_query("mua_rate", f"WITH {_MUA} SELECT interval_id, CAST(bin_idx AS INTEGER) AS bin_idx, bin_start, round(rate, 9) AS rate FROM mua")
def _(s, d):
    return _round(D.population_rate(*_ev(s, d), HOUR // 4), "rate", digits=9)


_SMOOTH_MUA = f"""{_MUA}, {_KERNEL}, z AS (SELECT interval_id, max(bin_idx) + 1 AS m FROM mua GROUP BY ALL), wt AS (SELECT interval_id, bin_idx AS place, bin_start, m, w, ((bin_idx + off) % (2 * m) + 2 * m) % (2 * m) AS q FROM mua JOIN z USING (interval_id), k),
sm AS (SELECT interval_id, place AS bin_idx, wt.bin_start, round(sum(w * rate), 12) AS rate FROM wt JOIN (SELECT interval_id, bin_idx, rate FROM mua) v USING (interval_id) WHERE v.bin_idx = CASE WHEN q < m THEN q ELSE 2 * m - 1 - q END GROUP BY ALL)"""


def _runs_over(flag: str, source: str) -> str:
    return f"""SELECT interval_id, min(bin_idx) AS first, max(bin_idx) AS last, min(bin_start) AS start, max(bin_start) AS stop, max(rate) AS best, bool_or(hi) AS hi FROM
 (SELECT *, sum(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER (PARTITION BY interval_id ORDER BY bin_idx ROWS UNBOUNDED PRECEDING) AS g FROM {source}) WHERE {flag} GROUP BY interval_id, g"""


_BURST = f"""{_SMOOTH_MUA}, lv AS (SELECT *, rate >= avg(rate) OVER () + 1.5e0 * stddev_pop(rate) OVER () AS hi, rate >= avg(rate) OVER () AS lo FROM sm), bu AS (SELECT * FROM ({_runs_over('lo', 'lv')}) WHERE hi AND last - first + 1 BETWEEN 3 AND 20)"""


@_query("mua_events", f"WITH {_BURST} SELECT interval_id, start, stop, round(best, 9) AS best FROM bu")
def _(s, d):
    rate = _round(D.population_rate(*_ev(s, d), HOUR // 4, _G), "rate", digits=12)
    return _round(D.bursts(rate, HOUR // 4, 1.5, 3 * (HOUR // 4), 20 * (HOUR // 4)), "best", digits=9)


@_query("mua_population_bursts", f"WITH {_BURST} SELECT bu.interval_id, bu.start, bu.stop, count(DISTINCT series_id) AS n_active FROM bu JOIN ev ON t >= bu.start AND t <= bu.stop WHERE series_id <> 'error' GROUP BY ALL HAVING count(DISTINCT series_id) > 3")
def _(s, d):
    return D.population_bursts(*_ev(s, d), HOUR // 4, _G, 3, "error", sigmas=1.5, least=3 * (HOUR // 4), most=20 * (HOUR // 4))


for _name, _mode, _hi, _lo in (("run", "above", 300.0, 260.0), ("inactive", "below", 150.0, 230.0)):
    _op = ">=" if _mode == "above" else "<="
    _best = "max" if _mode == "above" else "min"

    @_query(f"thr_{_name}_spans", f"""WITH {_SIG}, g AS (SELECT *, sum(CASE WHEN y {_op} {_lo!r} THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM sig)
SELECT series_id, min(t) AS start, max(t) + {HOUR} AS stop FROM g WHERE y {_op} {_lo!r} GROUP BY series_id, g HAVING {_best}(y) {_op} {_hi!r}""")
    def _(s, d, mode=_mode, hi=_hi, lo=_lo):
        return D.epochs(_sig(s, d), SK, hi, mode, lo, HOUR)


@_query("util_even_points", f"WITH {_A}, n AS (SELECT DISTINCT start, stop, (stop - start) // {7 * DAY} AS n FROM a) SELECT start, stop, CAST(round(start + k * (stop - start) / n) AS BIGINT) AS x FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM n WHERE n > 0)")
def _(s, d):
    return D.stretched(_a(s, d).select("start", "stop").distinct(), 7 * DAY).withColumn("x", F.round("x").cast("long"))


@_query("util_zoomed_columns", f"""WITH {_HOURS}, p AS (SELECT day AS "row", k, k * {23 / 9!r} AS x FROM (SELECT DISTINCT day FROM hours), (SELECT unnest(generate_series(0, 9)) AS k)), q AS (SELECT *, CAST(least(floor(x), 23) AS INTEGER) AS lo FROM p)
SELECT "row", CAST(k AS INTEGER) AS col, round(a.n + (b.n - a.n) * (x - lo), 6) AS v FROM q JOIN hours a ON a.day = "row" AND a.h = lo JOIN hours b ON b.day = "row" AND b.h = least(lo + 1, 23)""")
def _(s, d):
    m = _hours(s, d).select(F.col("day").alias("row"), F.col("h").cast("int").alias("col"), F.col("n").cast("double").alias("v"))
    return _round(D.zoomed(m, 24, 10), "v")


# --- tracks --------------------------------------------------------------------------------------

_MID = "(SELECT user_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (max(x) - min(x) + max(y) - min(y)) / 4 AS radius FROM tr GROUP BY user_id)"


@_query("geo_midpoint", f"WITH {_EV}, {_TRACK} SELECT user_id, round(mx, 6) AS mx, round(my, 6) AS my, round(radius, 6) AS radius FROM {_MID}")
def _(s, d):
    return _round(G.midpoint_radius(_track(s, d), ["user_id"]), "mx", "my", "radius")


@_query("geo_outside_disk", f"WITH {_EV}, {_TRACK} SELECT user_id, t, x, y FROM tr JOIN {_MID} USING (user_id) WHERE sqrt(power(x - mx, 2) + power(y - my, 2)) > 0.6e0 * radius")
def _(s, d):
    return G.outside_disk(_track(s, d), ["user_id"], 0.6)


@_query("geo_on_track", f"""WITH {_EV}, v AS (SELECT event_id, least(greatest(value, 0), 300 + 200) AS v FROM ev)
SELECT event_id, round(CASE WHEN v <= 300 THEN v * 0.6e0 ELSE 180 + (v - 300) * 0.8e0 END, 6) AS x, round(CASE WHEN v <= 300 THEN v * 0.8e0 ELSE 240 - (v - 300) * 0.6e0 END, 6) AS y FROM v""")
def _(s, d):
    lin = _ev(s, d)[0].select("event_id", F.col("value").alias("lin"))
    return _round(G.on_track(lin, [(0.0, 0.0), (180.0, 240.0), (340.0, 120.0)]), "x", "y").select("event_id", "x", "y")


_LAP = f"""rg AS (SELECT user_id, t, CAST((t // {HOUR}) % 24 AS DOUBLE) AS y FROM ev), q AS (SELECT *, y - lag(y) OVER (PARTITION BY user_id ORDER BY t) AS d FROM rg),
lp AS (SELECT user_id, t, y, CAST(sum(CASE WHEN d <= -12 THEN 1 WHEN d > 12 THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lap FROM q)"""


def _ring(s, d):
    return _track(s, d).select("user_id", "t", "y")


@_query("geo_laps", f"WITH {_EV}, {_LAP} SELECT * FROM lp")
def _(s, d):
    return G.laps(_ring(s, d), ["user_id"], 24.0)


@_query("geo_lap_spans", f"""WITH {_EV}, {_LAP}, n AS (SELECT *, CASE WHEN lap <> lag(lap) OVER (PARTITION BY user_id ORDER BY t) THEN 1 ELSE 0 END AS n FROM lp), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM n)
SELECT user_id, lap, min(t) AS start, max(t) AS stop FROM r GROUP BY user_id, r, lap""")
def _(s, d):
    return G.lap_epochs(_ring(s, d), ["user_id"], 24.0)


@_query("geo_turned", f"WITH {_EV}, {_LAP} SELECT user_id, t, CASE WHEN y >= 5 THEN y - 5 ELSE y + 19 END AS y FROM rg")
def _(s, d):
    return G.turned(_ring(s, d), 5.0, 24.0)


_U = "CAST(('0x' || substr(md5(concat_ws('/', {}::VARCHAR, {})), 1, 8)) AS BIGINT) / 4294967296e0"


@_query("geo_thinned", f"WITH {_EV} SELECT event_id FROM ev WHERE {_U.format(7, 'event_id')} < value / 500")
def _(s, d):
    return G.thinned(_ev(s, d)[0], "value", 500.0, 7, "event_id").select("event_id")


@_query("geo_generated", f"""WITH {_EV}, p AS (SELECT DISTINCT t // {HOUR} AS t, (t // {HOUR}) % 24 AS cell FROM ev), r AS (SELECT 'view' AS series_id, unnest(generate_series(0, 23)) AS cell, 0.25e0 AS rate UNION ALL SELECT 'click', unnest(generate_series(0, 11)), 0.75e0)
SELECT series_id, t FROM p JOIN r USING (cell) WHERE {_U.format(3, 'series_id, t')} < rate""")
def _(s, d):
    p = _ev(s, d)[0].select(floordiv(F.col("t"), HOUR).alias("t")).distinct().withColumn("cell", F.pmod("t", F.lit(24)))
    cells = lambda name, n, rate: s.range(n).select(F.lit(name).alias("series_id"), F.col("id").alias("cell"), F.lit(rate).alias("rate"))
    return G.generated(p, cells("view", 24, 0.25).union(cells("click", 12, 0.75)), "cell", 1.0, 3)


# --- texts ---------------------------------------------------------------------------------------

@_query("fmt_durations", """WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN round(value) * 60 * 24 WHEN 1 THEN round(value) WHEN 2 THEN -round(value) * 3600 WHEN 3 THEN 0 ELSE round(value) * 60 END AS x FROM events),
p AS (SELECT event_id, x, CAST(abs(x) AS BIGINT) AS w FROM v), q AS (SELECT *, w // 86400 AS d, (w // 3600) % 24 AS h, (w // 60) % 60 AS m, w % 60 AS s FROM p)
SELECT event_id, (CASE WHEN x < 0 THEN '-' ELSE '' END) || (CASE WHEN d > 0 THEN d || ' days ' ELSE '' END) || CASE WHEN h > 0 THEN printf('%d:%02d:%02d hours', h, m, s) WHEN m > 0 THEN printf('%d:%02d minutes', m, s) WHEN s > 0 THEN s || ' seconds' ELSE '0.0 milliseconds' END AS txt FROM q""")
def _(s, d):
    ev = _ev(s, d)[0]
    v = F.round("value")
    x = F.expr("pmod(event_id, 5)")
    return ev.select("event_id", X.duration_text(F.when(x == 0, v * 1440).when(x == 1, v).when(x == 2, -v * 3600).when(x == 3, 0.0).otherwise(v * 60)).alias("txt"))


@_query("fmt_counts", "SELECT event_id, format('{:,}', event_id * 977) AS counted, CASE WHEN event_id * 977 < 1024 THEN (event_id * 977) || ' bytes' WHEN event_id * 977 < 1048576 THEN printf('%.3f kilobytes', event_id * 977 / 1024e0) WHEN event_id * 977 < 1073741824 THEN printf('%.3f megabytes', event_id * 977 / 1048576e0) ELSE printf('%.3f gigabytes', event_id * 977 / 1073741824e0) END AS size FROM events")
def _(s, d):
    n = F.col("event_id") * 977
    return _ev(s, d)[0].select("event_id", X.count_text(n).alias("counted"), X.bytes_text(n).alias("size"))


@_query("fmt_lengths", r"SELECT event_id, CASE WHEN value >= 100 THEN regexp_replace(printf('%.4f', value / 100), '\.?0+$', '') || ' m' WHEN value >= 1 THEN regexp_replace(printf('%.4f', value), '\.?0+$', '') || ' cm' ELSE regexp_replace(printf('%.4f', value * 10), '\.?0+$', '') || ' mm' END AS txt FROM events")
def _(s, d):
    return _ev(s, d)[0].select("event_id", X.length_text(F.col("value")).alias("txt"))
