"""Registered queries of aggregates that users write, pieces of supports, picked signals, and covariates within their support."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeops import DAY, HOUR, floordiv
from ..operators import binned as B
from ..operators import ratemap as R
from ..operators import selection as L
from ..operators import signals as S
from .catalogue import _BIN, _EV, _SIG, _WIN, _bins, _binned_sql, _ev, _query, _round, _sig


def trimmed_mean(v):
    """Without the least and the greatest value, where there are more than two."""
    return float((v.sum() - v.min() - v.max()) / (len(v) - 2) if len(v) > 2 else v.mean())


_TRIMMED = ", CASE WHEN count(*) > 2 THEN (sum(value) - min(value) - max(value)) / (count(*) - 2) ELSE avg(value) END AS v, max(value) AS top"


@_query("val_bin_callable", f"WITH {_binned_sql(_TRIMMED)} SELECT c.series_id, c.interval_id, CAST(c.bin_idx AS INTEGER) AS bin_idx, coalesce(n, 0) AS n, round(v, 5) AS trimmed, top FROM cells c LEFT JOIN found USING (series_id, interval_id, bin_idx)")
def _(s, d):
    ev, win = _ev(s, d)
    b = B.bin_events(ev, win, HOUR, {"trimmed": trimmed_mean, "top": F.max("value")})
    return _round(b, "trimmed", digits=5).select("series_id", "interval_id", "bin_idx", "n", "trimmed", "top")


_CUT = f"cut AS (SELECT interval_id, i AS piece, start + i * {{step}} AS a, least(start + (i + 1) * {{step}}, stop) AS z FROM win, (SELECT unnest(generate_series(0, {{n}} - 1)) AS i))"


@_query("val_partition", f"WITH {_EV}, {_WIN}, {_CUT.format(step=8 * HOUR // 5, n=5)} SELECT event_id, series_id, value, interval_id, CAST(piece AS INTEGER) AS piece, a AS start, z AS stop FROM ev JOIN cut ON t >= a AND t < z")
def _(s, d):
    ev, win = _ev(s, d)
    return L.partitioned(ev, win, n=5).select("event_id", "series_id", "value", "interval_id", "piece", "start", "stop")


@_query("sig_partition", f"WITH {_SIG}, {_WIN}, {_CUT.format(step=3 * HOUR, n=3)} SELECT series_id, interval_id, CAST(piece AS INTEGER) AS piece, count(*) AS n, round(sum(y), 6) AS total FROM sig JOIN cut ON t >= a AND t < z GROUP BY ALL")
def _(s, d):
    p = L.partitioned(_sig(s, d), _ev(s, d)[1], ds=3 * HOUR)
    return _round(p.groupBy("series_id", "interval_id", "piece").agg(F.count("*").alias("n"), F.sum("y").alias("total")), "total")


@_query("sel_signal_slices", f"""WITH {_SIG}, {_WIN}, iv AS (SELECT *, row_number() OVER (ORDER BY start, stop) - 1 AS i, count(*) OVER () AS n FROM win), se AS (SELECT series_id, row_number() OVER (ORDER BY series_id) - 1 AS i FROM (SELECT DISTINCT series_id FROM sig))
SELECT sig.series_id, t, y, interval_id, start, stop FROM sig JOIN se USING (series_id) JOIN iv ON t >= start AND t < stop WHERE se.i < 3 AND iv.i >= 1 AND iv.i < n - 1 AND (iv.i - 1) % 2 = 0""")
def _(s, d):
    return L.sliced(_sig(s, d), _ev(s, d)[1], slice(1, -1, 2), slice(0, 3)).select("series_id", "t", "y", "interval_id", "start", "stop")


def _samples(s, d):
    """One series, without two hours at noon and every third day."""
    x = _sig(s, d).where("series_id = 'view'").select("t", "y")
    hour, day = F.pmod(floordiv(F.col("t"), HOUR), F.lit(24)), floordiv(F.col("t"), DAY)
    return x.where(~hour.isin(12, 13) & (F.pmod(day, F.lit(3)) != 0))


_AT = f"""{_BIN}, raw AS (SELECT (t // {HOUR}) * {HOUR} AS t, round(avg(value), 6) AS y FROM ev WHERE series_id = 'view' GROUP BY ALL),
sam AS (SELECT interval_id, t, y FROM raw JOIN win ON t >= start AND t < stop WHERE (t // {HOUR}) % 24 NOT IN (12, 13) AND (t // {DAY}) % 3 <> 0),
pts AS (SELECT DISTINCT interval_id, bin_start, bin_start + {HOUR // 2} AS t FROM bins),
pq AS (SELECT p.interval_id, p.bin_start, p.t, max(s.t) FILTER (s.t <= p.t) AS a, arg_max(y, s.t) FILTER (s.t <= p.t) AS ya, min(s.t) FILTER (s.t >= p.t) AS z, arg_min(y, s.t) FILTER (s.t >= p.t) AS yz FROM pts p JOIN sam s USING (interval_id) GROUP BY ALL),
cov AS (SELECT interval_id, bin_start, CASE WHEN a IS NULL THEN yz WHEN z IS NULL OR z = a THEN ya ELSE ya + (yz - ya) * ((t - a) / (z - a)) END AS y FROM pq)"""


@_query("tc_covariate_in_support", f"WITH {_AT} SELECT interval_id, bin_start AS t_bin, round(y, 7) AS y FROM cov")
def _(s, d):
    return _round(R.covariate_bins(_ev(s, d)[1], _samples(s, d), HOUR), "y", digits=7).select("interval_id", "t_bin", "y")


@_query("tc_of_signal", f"""WITH {_AT}, x AS (SELECT bin_start, CAST(least(floor((sqrt(y) - 5) * 8 / 15), 7) AS INTEGER) AS k FROM cov WHERE sqrt(y) BETWEEN 5 AND 20), occ AS (SELECT k, count(*) AS occupancy FROM x GROUP BY k),
cs AS (SELECT series_id, k, sum(n) AS n FROM bins JOIN x USING (bin_start) GROUP BY ALL) SELECT series_id, k AS y, occupancy, round(n / occupancy, 6) AS rate FROM cs JOIN occ USING (k)""")
def _(s, d):
    root = lambda rows: rows.withColumn("y", F.sqrt("y"))
    return _round(R.map_of_signal(_bins(s, d), _ev(s, d)[1], _samples(s, d), HOUR, {"y": (5.0, 20.0, 8)}, transform=root), "rate").select("series_id", "y", "occupancy", "rate")


_TWO = f"{_EV}, two AS (SELECT (t // {HOUR}) * {HOUR} AS t, t // {DAY} AS day, avg(value) AS a, count(*)::DOUBLE AS b FROM ev GROUP BY ALL)"
_GRAD = "coalesce((lead({c}) OVER w - lag({c}) OVER w) / 2, lead({c}) OVER w - {c}, {c} - lag({c}) OVER w, 0)"


@_query("sig_derivative_norm", f"WITH {_TWO} SELECT day, t, round(2 * sqrt(da * da + db * db), 5) AS norm FROM (SELECT day, t, {_GRAD.format(c='a')} AS da, {_GRAD.format(c='b')} AS db FROM two WINDOW w AS (PARTITION BY day ORDER BY t))")
def _(s, d):
    ev, hour = _ev(s, d)[0], (floordiv(F.col("t"), HOUR) * HOUR).alias("t")
    two = ev.groupBy(hour, floordiv(F.col("t"), DAY).alias("day")).agg(F.avg("value").alias("a"), F.count("*").cast("double").alias("b"))
    return _round(S.derivative(two, ["day"], ["a", "b"], 2.0, norm=True), "norm", digits=5)
