"""Registered queries of shuffles, bursts, stacked windows, tracks and hidden states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeops import DAY, HOUR, floordiv
from ..operators import detect as X
from ..operators import hmm as H
from ..operators import replay as P
from ..scratch import written
from ..sources.tables import events
from .catalogue import _BIN, _EV, _HOURS, _bins, _hours, _query, _QUERIES, _round, _runs_sql


@_query("thr_run_epochs", f"WITH {_HOURS}, lv AS (SELECT * FROM hours), r AS ({_runs_sql('n >= 13')}) SELECT * FROM r WHERE best >= 18")
def _(s, d):
    return P.hysteresis(_hours(s, d), ["day"], "h", "n", 18, 13)


@_query("pbe", f"""WITH {_HOURS}, lv AS (SELECT *, n >= avg(n) OVER (PARTITION BY day) + stddev_pop(n) OVER (PARTITION BY day) AS hi, n >= avg(n) OVER (PARTITION BY day) AS lo FROM hours),
i AS ({_runs_sql('hi')}), o AS ({_runs_sql('lo')}), b AS (SELECT DISTINCT o.day, o.first AS start, o.last AS stop FROM i JOIN o ON i.day = o.day AND o.first <= i.first AND i.last <= o.last)
SELECT b.day, start, stop, count(*) AS n_events, count(DISTINCT series_id) AS n_active FROM b JOIN ev ON t // {DAY} = b.day AND (t // {HOUR}) % 24 BETWEEN start AND stop GROUP BY ALL HAVING count(DISTINCT series_id) >= 4""")
def _(s, d):
    found = X.boundaries(_hours(s, d), ["day"], "h", "n", 1.0).select("day", "start", "stop")
    ev = events(s, d).select("series_id", floordiv(F.col("t"), DAY).alias("day"), F.pmod(floordiv(F.col("t"), HOUR), F.lit(24)).alias("h"))
    return (ev.join(found, "day").where("h between start and stop").groupBy("day", "start", "stop")
            .agg(F.count("*").alias("n_events"), F.countDistinct("series_id").alias("n_active")).where("n_active >= 4"))


@_query("win_stack", f"""WITH {_BIN}, m AS (SELECT series_id, interval_id, max(bin_idx) AS m FROM bins GROUP BY ALL)
SELECT a.series_id, a.interval_id, CAST(a.bin_idx AS INTEGER) AS bin_idx, CAST(b.bin_idx - a.bin_idx AS INTEGER) AS "offset", b.n FROM bins a JOIN m USING (series_id, interval_id)
JOIN bins b ON a.series_id = b.series_id AND a.interval_id = b.interval_id AND b.bin_idx BETWEEN a.bin_idx - 2 AND a.bin_idx + 1 WHERE a.bin_idx >= 2 AND a.bin_idx + 1 <= m AND (a.bin_idx - 2) % 2 = 0""")
def _(s, d):
    return P.stacked(_bins(s, d), 2, 1, 2)


@_query("win_scaler", f"""WITH {_BIN}, f AS (SELECT series_id, avg(n) AS m, stddev_pop(n) AS s FROM bins WHERE interval_id % 5 <> 0 GROUP BY series_id)
SELECT series_id, interval_id, CAST(bin_idx AS INTEGER) AS bin_idx, round((n - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS y FROM bins JOIN f USING (series_id)""")
def _(s, d):
    y = P.trained_scale(_bins(s, d), F.col("interval_id") % 5 != 0, ["series_id"])
    return _round(y, "y").select("series_id", "interval_id", "bin_idx", "y")


@_query("rp_consecutive_bins", f"""WITH {_BIN}, fl AS (SELECT interval_id, bin_idx, sum(n) AS n FROM bins GROUP BY ALL),
r AS (SELECT interval_id, count(*) AS c FROM (SELECT *, bin_idx - row_number() OVER (PARTITION BY interval_id ORDER BY bin_idx) AS g FROM fl WHERE n > 0) GROUP BY interval_id, g)
SELECT interval_id, CAST(coalesce(max(c), 0) AS INTEGER) AS n_consecutive FROM (SELECT DISTINCT interval_id FROM fl) LEFT JOIN r USING (interval_id) GROUP BY interval_id""")
def _(s, d):
    return P.longest_active(_bins(s, d))


#: Shift of a shuffle from the length of the series' name, so that SQL can say the same.
_SHIFT = "(length(series_id) * 3 + interval_id) * k"


@_query("rp_cycle_shuffle", f"""WITH {_BIN}, z AS (SELECT *, 1 AS k, max(bin_idx) OVER (PARTITION BY series_id, interval_id) + 1 AS m FROM bins)
SELECT series_id, interval_id, CAST((bin_idx + {_SHIFT}) % m AS INTEGER) AS bin_idx, n FROM z""")
def _(s, d):
    return P.cycled(_bins(s, d).withColumn("k", F.lit(1)), ["series_id", "interval_id"], F.expr(_SHIFT)).select("series_id", "interval_id", "bin_idx", "n")


@_query("rp_cycle_significance", f"""WITH {_BIN}, many AS (SELECT *, max(bin_idx) OVER (PARTITION BY series_id, interval_id) + 1 AS m FROM bins CROSS JOIN (SELECT unnest(generate_series(0, 50)) AS k)),
fl AS (SELECT interval_id, k, (bin_idx + {_SHIFT}) % m AS b, sum(n) AS n FROM many GROUP BY ALL),
sc AS (SELECT interval_id, k, coalesce(sum(p), 0) AS score FROM (SELECT *, n * lead(n) OVER (PARTITION BY interval_id, k ORDER BY b) AS p FROM fl) GROUP BY ALL)
SELECT a.interval_id, CAST(a.score AS BIGINT) AS score, round((count(*) FILTER (WHERE b.score >= a.score) + 1) / (count(*) + 1), 9) AS p FROM sc a JOIN sc b USING (interval_id) WHERE a.k = 0 AND b.k > 0 GROUP BY ALL""")
def _(s, d):
    return _round(P.cycle_test(_bins(s, d), 50, F.expr(_SHIFT)), "p", digits=9)


@_query("geo_linearize", f"""WITH {_EV}, pt AS (SELECT event_id, value AS x, CAST((t // {HOUR}) % 24 AS DOUBLE) AS y FROM ev),
a AS (SELECT *, least(greatest((x * 240 + y * 10) / sqrt(57700e0), 0), sqrt(57700e0)) AS u, least(greatest(((x - 240) * 260 + (y - 10) * 14) / sqrt(67796e0), 0), sqrt(67796e0)) AS v FROM pt),
b AS (SELECT *, sqrt(power(x - u * 240 / sqrt(57700e0), 2) + power(y - u * 10 / sqrt(57700e0), 2)) AS ou, sqrt(power(x - 240 - v * 260 / sqrt(67796e0), 2) + power(y - 10 - v * 14 / sqrt(67796e0), 2)) AS ov FROM a)
SELECT event_id, round(CASE WHEN ou <= ov THEN u ELSE sqrt(57700e0) + v END, 5) AS lin, round(least(ou, ov), 5) AS off FROM b""")
def _(s, d):
    pt = events(s, d).select("event_id", F.col("value").alias("x"), F.pmod(floordiv(F.col("t"), HOUR), F.lit(24)).cast("double").alias("y"))
    return _round(P.linearized(pt, [(0.0, 0.0), (240.0, 10.0), (500.0, 24.0)]), "lin", "off", digits=5).select("event_id", "lin", "off")


def _fitted(s, d):
    b = _bins(s, d)
    series = H.series_of(b)
    w = written(H.wide(b, series), "wide")  # every round reads it
    return w, H.fit(w, H.initial(w, series, 3), 3)


_QUERIES["hmm_scores"] = lambda s, d: _round(H.scores(*_fitted(s, d)), "loglik")
_QUERIES["hmm_paths"] = lambda s, d: H.paths(*_fitted(s, d))
