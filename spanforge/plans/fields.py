"""Registered queries of curves over several axes, decoders, shuffles, trajectories and hidden states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeops import HOUR, floordiv, gaussian_weights
from ..operators import decode as D
from ..operators import hmm as H
from ..operators import markov as M
from ..operators import ratemap as R
from ..operators import shuffles as P
from ..scratch import written
from .catalogue import _BIN, _EV, _INFO, _MK, _POST, _QUERIES, _TB, _bins, _ev, _posterior, _query, _rates_sql, _round, _trans, _tuning

_W = gaussian_weights(1.0, 2.0)
_WK = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({i - len(_W) // 2}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(_W)) + ") AS t(off, w))"
_TB3 = f"{_EV}, tb AS (SELECT t_bin, t_bin % 24 AS h, (t_bin // 24) % 7 AS wd, (t_bin // 24) % 2 AS par FROM (SELECT DISTINCT t // {HOUR} AS t_bin FROM ev)), cn AS (SELECT series_id, t // {HOUR} AS t_bin, count(*) AS n FROM ev GROUP BY ALL)"


def _map(s, d, axes=("h",), floor: float = 0.0):
    counts, bins = _tuning(s, d)
    return R.rate_map(counts, bins, list(axes), floor)


# --- curves --------------------------------------------------------------------------------------

@_query("tc_smooth_1d", f"WITH {_TB}, {_rates_sql('h')}, {_WK} SELECT a.series_id, a.h, round(sum(w * b.rate) / sum(w), 6) AS rate FROM r a, k, r b WHERE b.series_id = a.series_id AND b.h = a.h + off GROUP BY ALL")
def _(s, d):
    return _round(R.smoothed(_map(s, d), ["h"], {"h": _W}), "rate").select("series_id", "h", "rate")


@_query("tc_smooth_2d", f"""WITH {_TB}, {_rates_sql('h, wd')}, {_WK}, a AS (SELECT a.series_id, a.h, a.wd, sum(w * b.rate) / sum(w) AS rate FROM r a, k, r b WHERE b.series_id = a.series_id AND b.wd = a.wd AND b.h = a.h + off GROUP BY ALL)
SELECT a.series_id, a.h, a.wd, round(sum(w * b.rate) / sum(w), 6) AS rate FROM a, k, a b WHERE b.series_id = a.series_id AND b.h = a.h AND b.wd = a.wd + off GROUP BY ALL""")
def _(s, d):
    return _round(R.smoothed(_map(s, d, ("h", "wd")), ["h", "wd"], {"h": _W, "wd": _W}), "rate").select("series_id", "h", "wd", "rate")


@_query("tc_arithmetic", f"WITH {_TB}, {_rates_sql('h')} SELECT series_id, h, round(rate + 1, 6) AS plus, round(rate / nullif(rate, 0), 6) AS ratio FROM r")
def _(s, d):
    r = _map(s, d)
    one, two = R.combined(r, 1.0, "+", ["h"]), R.combined(r, r, "/", ["h"])
    return _round(one.select("series_id", "h", F.col("rate").alias("plus")).join(two.select("series_id", "h", F.col("rate").alias("ratio")), ["series_id", "h"]), "plus", "ratio")


@_query("tc_reduced_2d", f"WITH {_TB}, {_rates_sql('h, wd')} SELECT series_id, round(avg(rate), 6) AS mean, round(max(rate), 6) AS max, round(min(rate), 6) AS min, round(stddev_pop(rate), 6) AS std FROM r GROUP BY series_id")
def _(s, d):
    return _round(R.reduced(_map(s, d, ("h", "wd"))), "mean", "max", "min", "std")


_INFO_OUT = "SELECT series_id, round(mean_rate, 6) AS mean_rate, round(si, 6) AS si, round(si * mean_rate, 6) AS info_rate, round(mx / mean_rate, 6) AS selectivity, round(mean_rate * mean_rate / sq, 6) AS sparsity FROM q3"


@_query("tc_information_2d", f"WITH {_TB}, {_rates_sql('h, wd')}, {_INFO} {_INFO_OUT}")
def _(s, d):
    return _round(R.information(_map(s, d, ("h", "wd"))), "mean_rate", "si", "info_rate", "selectivity", "sparsity")


def _tuning3(s, d):
    counts, bins = _tuning(s, d)
    return counts, bins.withColumn("par", F.pmod(floordiv(F.col("t_bin"), 24), F.lit(2)))


@_query("tc_ratemap_3d", f"WITH {_TB3}, {_rates_sql('h, wd, par')} SELECT series_id, h, wd, par, occupancy, round(rate, 6) AS rate FROM r")
def _(s, d):
    return _round(R.rate_map(*_tuning3(s, d), ["h", "wd", "par"]), "rate")


@_query("tc_information_3d", f"WITH {_TB3}, {_rates_sql('h, wd, par')}, {_INFO} {_INFO_OUT}")
def _(s, d):
    return _round(R.information(R.rate_map(*_tuning3(s, d), ["h", "wd", "par"])), "mean_rate", "si", "info_rate", "selectivity", "sparsity")


@_query("tc_least_duration", f"WITH {_TB}, {_rates_sql('h, wd')} SELECT series_id, h, wd, occupancy, round(CASE WHEN occupancy < 4 THEN 0 ELSE rate END, 6) AS rate FROM r")
def _(s, d):
    return _round(R.covered(_map(s, d, ("h", "wd")), 1.0, 4.0), "rate").select("series_id", "h", "wd", "occupancy", "rate")


@_query("tc_axis_bins", f"""WITH {_EV}, x AS (SELECT event_id, value FROM ev WHERE value BETWEEN 20 AND 470)
SELECT event_id, CAST(least(floor((value - 20) * 9 / 450), 8) AS INTEGER) AS left_closed, CAST(greatest(ceil((value - 20) * 9 / 450) - 1, 0) AS INTEGER) AS right_closed FROM x""")
def _(s, d):
    x = _ev(s, d)[0].select("event_id", "value")
    axes = {"value": (20.0, 470.0, 9)}
    a, b = R.binned_axes(x, axes).withColumnRenamed("value", "left_closed"), R.binned_axes(x, axes, True).withColumnRenamed("value", "right_closed")
    return a.join(b, "event_id")


def _fit(s, d):
    counts, bins = _tuning(s, d)
    return R.RateMap.fit(counts, bins, ["h"], floor=0.01), counts, bins


@_query("tc_units", f"WITH {_TB}, {_rates_sql('h', '0.01e0')} SELECT series_id, h, round(rate, 6) AS rate FROM r WHERE series_id IN ('view', 'click')")
def _(s, d):
    return _round(_fit(s, d)[0].units(["view", "click"]).rates, "rate").select("series_id", "h", "rate")


@_query("rate_predict", f"WITH {_TB}, {_rates_sql('h', '0.01e0')} SELECT t_bin, series_id, round(rate, 6) AS rate FROM tb JOIN r USING (h)")
def _(s, d):
    m, _, bins = _fit(s, d)
    return _round(m.predict(bins), "rate")


@_query("rate_score", f"""WITH {_TB}, {_rates_sql('h', '0.01e0')}, l AS (SELECT t_bin, sum(coalesce(cn.n, 0) * ln(rate) - rate) AS ll FROM tb JOIN r USING (h) LEFT JOIN cn USING (t_bin, series_id) GROUP BY t_bin)
SELECT round(avg(ll), 6) AS score, count(*) AS n_bins FROM l""")
def _(s, d):
    m, counts, bins = _fit(s, d)
    return _round(m.score(counts, bins), "score")


# --- decoding ------------------------------------------------------------------------------------

_DENSE = "dn AS (SELECT series_id, t_bin, t_bin // 24 AS day, coalesce(n, 0) AS n FROM (SELECT DISTINCT series_id FROM cn) CROSS JOIN tb LEFT JOIN cn USING (series_id, t_bin))"


def _dense(s, d):
    counts, bins = _tuning(s, d)
    all_ = counts.select("series_id").distinct().crossJoin(bins.select("t_bin")).join(counts, ["series_id", "t_bin"], "left")
    return all_.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("day", floordiv(F.col("t_bin"), 24)), bins


@_query("dec_windowed_counts", f"WITH {_TB}, {_DENSE} SELECT series_id, day, t_bin, CAST(m AS BIGINT) AS n FROM (SELECT *, sum(n) OVER w AS m, count(*) OVER w AS c FROM dn WINDOW w AS (PARTITION BY series_id, day ORDER BY t_bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE c = 3")
def _(s, d):
    return D.windowed(_dense(s, d)[0], "day", 3)


_POST2 = f"""{_TB}, {_rates_sql('h, wd', '0.01e0')}, tot AS (SELECT h, wd, sum(rate) AS sr FROM r GROUP BY h, wd),
ll AS (SELECT t_bin, r.h, r.wd, sum(n * ln(rate)) - max(sr) AS lp FROM cn JOIN r USING (series_id) JOIN tot ON tot.h = r.h AND tot.wd = r.wd GROUP BY ALL),
e AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY t_bin)) AS x FROM ll), post AS (SELECT t_bin, h, wd, x / sum(x) OVER (PARTITION BY t_bin) AS p FROM e)"""


def _post2(s, d):
    counts, _ = _tuning(s, d)
    return D.posterior_nd(counts, _map(s, d, ("h", "wd"), 0.01), ["h", "wd"])


@_query("dec_posterior_2d", f"WITH {_POST2} SELECT t_bin, h, wd, round(p, 6) AS p FROM post")
def _(s, d):
    return _round(_post2(s, d), "p")


@_query("dec_paths_2d", f"""WITH {_POST2}, mo AS (SELECT DISTINCT ON (t_bin) t_bin, h AS mode_h, wd AS mode_wd FROM post ORDER BY t_bin, round(p, 9) DESC, h, wd)
SELECT t_bin, mode_h, mode_wd, round(sum(p * (h + 0.5e0)), 6) AS mean_h, round(sum(p * (wd + 0.5e0)), 6) AS mean_wd FROM post JOIN mo USING (t_bin) GROUP BY ALL""")
def _(s, d):
    post = _post2(s, d)
    mode = D.mode_nd(post, ["h", "wd"]).withColumnsRenamed({"h": "mode_h", "wd": "mode_wd"})
    mean = D.mean_nd(post, ["h", "wd"]).withColumnsRenamed({"h": "mean_h", "wd": "mean_wd"})
    return _round(mode.join(mean, "t_bin"), "mean_h", "mean_wd")


@_query("dec_partial_windows", f"""WITH {_TB}, {_DENSE}, z AS (SELECT * FROM dn WHERE day % 2 = 0 OR t_bin % 24 < 2), v AS (SELECT *, sum(n) OVER w AS m, count(*) OVER w AS c, count(*) OVER (PARTITION BY series_id, day) AS size, min(t_bin) OVER (PARTITION BY series_id, day) AS a FROM z WINDOW w AS (PARTITION BY series_id, day ORDER BY t_bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT series_id, day, t_bin, CAST(m AS BIGINT) AS n FROM v WHERE c = 3 OR (size < 3 AND t_bin = a)""")
def _(s, d):
    return D.windowed(_dense(s, d)[0].where("day % 2 = 0 or t_bin % 24 < 2"), "day", 3, partial=True)


@_query("dec_windowed_2d", f"""WITH {_TB}, {_DENSE}, {_rates_sql('h, wd', '0.01e0')}, v AS (SELECT *, sum(n) OVER w AS m, count(*) OVER w AS c, count(*) OVER (PARTITION BY series_id, day) AS size, min(t_bin) OVER (PARTITION BY series_id, day) AS a FROM dn WINDOW w AS (PARTITION BY series_id, day ORDER BY t_bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
wn AS (SELECT series_id, t_bin, m AS n FROM v WHERE c = 3 OR (size < 3 AND t_bin = a)), tot AS (SELECT h, wd, sum(rate) AS sr FROM r GROUP BY h, wd),
ll AS (SELECT t_bin, r.h, r.wd, sum(n * ln(rate)) - 3 * max(sr) AS lp FROM wn JOIN r USING (series_id) JOIN tot ON tot.h = r.h AND tot.wd = r.wd WHERE n > 0 GROUP BY ALL),
e AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY t_bin)) AS x FROM ll), post AS (SELECT t_bin, h, wd, x / sum(x) OVER (PARTITION BY t_bin) AS p FROM e)
SELECT DISTINCT ON (t_bin) t_bin, h AS mode_h, wd AS mode_wd FROM post ORDER BY t_bin, round(p, 9) DESC, h, wd""")
def _(s, d):
    wide = D.windowed(_dense(s, d)[0], "day", 3, partial=True)
    post = D.posterior_nd(wide, _map(s, d, ("h", "wd"), 0.01), ["h", "wd"], w=3)
    return D.mode_nd(post, ["h", "wd"]).withColumnsRenamed({"h": "mode_h", "wd": "mode_wd"})


@_query("dec_uniform_if_empty", f"""WITH {_TB}, {_rates_sql('h', '0.01e0')}, tot AS (SELECT h, sum(rate) AS sr FROM r GROUP BY h), c2 AS (SELECT series_id, t_bin, CASE WHEN t_bin % 5 = 0 THEN 0 ELSE n END AS n FROM cn),
ll AS (SELECT t_bin, r.h, sum(n * ln(rate)) - max(sr) AS lp FROM c2 JOIN r USING (series_id) JOIN tot ON tot.h = r.h WHERE n > 0 GROUP BY t_bin, r.h), e AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY t_bin)) AS x FROM ll)
SELECT t_bin, h, round(x / sum(x) OVER (PARTITION BY t_bin), 6) AS p FROM e UNION ALL SELECT t_bin, h, round(1e0 / count(*) OVER (PARTITION BY t_bin), 6) FROM (SELECT t_bin FROM c2 GROUP BY t_bin HAVING sum(n) = 0), tot""")
def _(s, d):
    counts, _ = _tuning(s, d)
    some = counts.withColumn("n", F.when(F.col("t_bin") % 5 == 0, 0).otherwise(F.col("n")))
    return _round(D.posterior_nd(some, _map(s, d, ("h",), 0.01), ["h"], uniform_if_empty=True), "p")


@_query("dec_decoder", f"WITH {_POST} SELECT t_bin, round(mean, 6) AS h FROM mean")
def _(s, d):
    counts, bins = _tuning(s, d)
    return _round(D.BayesianDecoder(["h"]).fit(counts, bins).predict(counts), "h")


@_query("dec_error_quantiles", f"""WITH {_POST}, er AS (SELECT abs(mode - tb.h) AS error, count(*) AS n FROM mode JOIN tb USING (t_bin) GROUP BY ALL),
c AS (SELECT error, sum(n) OVER (ORDER BY error ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS share FROM er), g AS (SELECT *, coalesce(lag(error) OVER (ORDER BY error), 0) AS e0, coalesce(lag(share) OVER (ORDER BY error), 0) AS s0 FROM c)
SELECT CAST(q AS DOUBLE) AS share, round(e0 + (error - e0) * (q - s0) / (share - s0), 6) AS error FROM g, (SELECT unnest([0.25e0, 0.5e0, 0.9e0]) AS q) WHERE q > s0 AND q <= share""")
def _(s, d):
    post, truth = _posterior(s, d)
    return _round(D.quantile_of(D.error_cdf(D.mode_path(post, "h"), truth, "mode"), [0.25, 0.5, 0.9]), "error")


@_query("dec_cross_validated", f"""WITH {_TB}, fb AS (SELECT *, (t_bin // 24) % 3 AS fold FROM tb), oc AS (SELECT f.fold, h, count(*) AS occ FROM fb, (SELECT DISTINCT fold FROM fb) f WHERE fb.fold <> f.fold GROUP BY ALL),
nf AS (SELECT f.fold, series_id, h, sum(n) AS n FROM cn JOIN fb USING (t_bin), (SELECT DISTINCT fold FROM fb) f WHERE fb.fold <> f.fold GROUP BY ALL),
r AS (SELECT fold, series_id, h, greatest(coalesce(n, 0) / occ, 0.01e0) AS rate FROM (SELECT DISTINCT series_id FROM cn) CROSS JOIN oc LEFT JOIN nf USING (fold, series_id, h)), tot AS (SELECT fold, h, sum(rate) AS sr FROM r GROUP BY ALL),
ll AS (SELECT fb.fold, t_bin, r.h, sum(n * ln(rate)) - max(sr) AS lp FROM cn JOIN fb USING (t_bin) JOIN r ON r.series_id = cn.series_id AND r.fold = fb.fold JOIN tot ON tot.h = r.h AND tot.fold = r.fold GROUP BY ALL),
e AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY t_bin)) AS x FROM ll), p AS (SELECT fold, t_bin, h, x / sum(x) OVER (PARTITION BY t_bin) AS p FROM e)
SELECT p.fold, p.t_bin, round(sum(p * (p.h + 0.5e0)), 6) AS mean, tb.h AS x FROM p JOIN tb ON tb.t_bin = p.t_bin GROUP BY ALL""")
def _(s, d):
    counts, bins = _tuning(s, d)
    return _round(D.cross_validated(counts, bins, "h", F.pmod(floordiv(F.col("t_bin"), 24), F.lit(3)), 3), "mean")


# --- shuffles --------------------------------------------------------------------------------------

_MD = "md5(concat_ws('/', '{}', {}))"


@_query("rp_time_swap", f"""WITH {_BIN}, o AS (SELECT interval_id, bin_idx, row_number() OVER (PARTITION BY interval_id ORDER BY {_MD.format(5, 'interval_id, bin_idx')}, bin_idx) - 1 AS k FROM (SELECT DISTINCT interval_id, bin_idx FROM bins))
SELECT series_id, interval_id, CAST(k AS INTEGER) AS bin_idx, n FROM bins JOIN o USING (interval_id, bin_idx)""")
def _(s, d):
    return P.time_swapped(_bins(s, d), 5)


@_query("rp_pooled_time_swap", f"""WITH {_BIN}, g AS (SELECT DISTINCT interval_id, bin_idx FROM bins), a AS (SELECT *, row_number() OVER (ORDER BY interval_id, bin_idx) AS k FROM g), b AS (SELECT interval_id AS i, bin_idx AS j, row_number() OVER (ORDER BY {_MD.format(6, 'interval_id, bin_idx')}, interval_id, bin_idx) AS k FROM g)
SELECT series_id, a.interval_id, CAST(a.bin_idx AS INTEGER) AS bin_idx, n FROM a JOIN b USING (k) JOIN bins ON bins.interval_id = b.i AND bins.bin_idx = b.j""")
def _(s, d):
    return P.time_swapped(_bins(s, d), 6, pooled=True)


@_query("rp_series_swap", f"""WITH {_BIN}, w AS (SELECT DISTINCT interval_id, series_id FROM bins), a AS (SELECT *, row_number() OVER (PARTITION BY interval_id ORDER BY series_id) AS k FROM w),
b AS (SELECT interval_id, series_id AS new_id, row_number() OVER (PARTITION BY interval_id ORDER BY {_MD.format(7, 'interval_id, series_id')}, series_id) AS k FROM w)
SELECT new_id AS series_id, bins.interval_id, CAST(bin_idx AS INTEGER) AS bin_idx, n FROM bins JOIN a USING (interval_id, series_id) JOIN b ON b.interval_id = a.interval_id AND b.k = a.k""")
def _(s, d):
    return P.series_swapped(_bins(s, d), 7)


@_query("rp_event_swap", f"""WITH {_EV}, a AS (SELECT event_id, user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM ev), b AS (SELECT user_id, series_id, row_number() OVER (PARTITION BY user_id ORDER BY {_MD.format(8, 'event_id')}, event_id) AS k FROM ev)
SELECT event_id, user_id, t, series_id FROM a JOIN b USING (user_id, k)""")
def _(s, d):
    return P.events_swapped(_ev(s, d)[0].select("event_id", "user_id", "series_id", "t"), "user_id", 8)


_UN = "CAST(('0x' || substr(md5(concat_ws('/', '9', series_id, interval_id, bin_idx)), 1, 13)) AS BIGINT) / 4503599627370496e0"


@_query("rp_poisson", f"""WITH {_BIN}, m AS (SELECT *, avg(n) OVER (PARTITION BY series_id, interval_id) AS m, {_UN} AS u FROM bins), c AS (SELECT series_id, interval_id, bin_idx, u, k, sum(exp(k * ln(nullif(m, 0)) - m - lgamma(k + 1))) OVER (PARTITION BY series_id, interval_id, bin_idx ORDER BY k ROWS UNBOUNDED PRECEDING) AS c
FROM m, (SELECT unnest(generate_series(0, (SELECT CAST(max(m) + 12 * sqrt(max(m)) + 40 AS BIGINT) FROM m))) AS k)) SELECT series_id, interval_id, CAST(bin_idx AS INTEGER) AS bin_idx, count(*) FILTER (WHERE c <= u) AS n FROM c GROUP BY ALL""")
def _(s, d):
    return P.poisson_surrogate(_bins(s, d), 9).select("series_id", "interval_id", "bin_idx", "n")


for _by, _other in (("i", "j"), ("j", "i")):
    @_query(f"mk_shuffled_by_{_by}", f"""WITH {_MK}, o AS (SELECT * FROM tr WHERE i <> j), a AS (SELECT i, j, row_number() OVER (PARTITION BY {_by} ORDER BY {_other}) AS k FROM o),
b AS (SELECT {_by} AS g, p, row_number() OVER (PARTITION BY {_by} ORDER BY {_MD.format(10, 'i, j')}, {_other}) AS k FROM o)
SELECT i, j, round(p, 9) AS p FROM a JOIN b ON a.{_by} = b.g AND a.k = b.k UNION ALL SELECT i, j, round(p, 9) FROM tr WHERE i = j""")
    def _(s, d, by=_by):
        return _round(P.shuffled_transitions(_trans(s, d)[1].select("i", "j", "p"), 10, by), "p", digits=9)


@_query("mk_graph_edges", f"WITH {_MK} SELECT i, j, round(p, 9) AS p FROM tr WHERE p >= 0.2e0 AND i <> j")
def _(s, d):
    return _round(M.edges(_trans(s, d)[1], 0.2), "p", digits=9)


@_query("mk_gini_of_departures", f"""WITH {_MK}, o AS (SELECT i, j, p / sum(p) OVER (PARTITION BY i) AS p FROM tr WHERE i <> j), r AS (SELECT i, p, row_number() OVER (PARTITION BY i ORDER BY p) AS k, count(*) OVER (PARTITION BY i) AS n FROM o)
SELECT i, round(sum((2 * k - n - 1) * p) / (max(n) * sum(p)), 6) AS gini FROM r GROUP BY i""")
def _(s, d):
    return _round(M.gini(M.departures(_trans(s, d)[1]), ["i"], "p"), "gini")


# --- trajectories: days as events, hours as bins, decoded hours as cells -----------------------------

_EVENTS = f"{_POST}, pe AS (SELECT t_bin // 24 AS interval_id, t_bin % 24 AS bin_idx, h AS cell, p FROM post), pm AS (SELECT t_bin // 24 AS interval_id, t_bin % 24 AS bin_idx, mode AS x FROM mode), li AS (SELECT interval_id, regr_slope(x, bin_idx) AS slope, regr_intercept(x, bin_idx) AS intercept, regr_r2(x, bin_idx) AS r2 FROM pm GROUP BY interval_id)"


def _events_post(s, d):
    post, _ = _posterior(s, d)
    day, hour = floordiv(F.col("t_bin"), 24), F.pmod("t_bin", F.lit(24)).cast("int")
    rows = post.select(day.alias("interval_id"), hour.alias("bin_idx"), F.col("h").cast("int").alias("cell"), "p")
    path = D.mode_path(post, "h").select(day.alias("interval_id"), hour.alias("bin_idx"), F.col("mode").alias("x"))
    return rows, path


@_query("rp_line", f"WITH {_EVENTS} SELECT interval_id, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(r2, 5) AS r2 FROM li")
def _(s, d):
    return _round(P.line_of(_events_post(s, d)[1]), "slope", "intercept", "r2", digits=5)


@_query("rp_trajectory_score", f"""WITH {_EVENTS}, ln AS (SELECT pe.*, CAST(round(0.5e0 * bin_idx + 3) AS BIGINT) AS l FROM pe)
SELECT interval_id, round(sum(CASE WHEN ((cell - l + 2) % 24 + 24) % 24 <= 4 THEN p ELSE 0 END) / count(DISTINCT bin_idx), 6) AS score FROM ln GROUP BY interval_id""")
def _(s, d):
    rows, _ = _events_post(s, d)
    lines = rows.select("interval_id").distinct().select("interval_id", F.lit(0.5).alias("slope"), F.lit(3.0).alias("intercept"))
    return _round(P.trajectory_score(rows, lines, 24, 2, True), "score")


@_query("rp_consecutive_above", f"""WITH {_BIN}, pv AS (SELECT interval_id, bin_idx, sum(n) / 40e0 AS p FROM bins GROUP BY ALL), r AS (SELECT interval_id, min(bin_idx) AS a, max(bin_idx) AS z, count(*) AS c FROM (SELECT *, bin_idx - row_number() OVER (PARTITION BY interval_id ORDER BY bin_idx) AS g FROM pv WHERE p > 0.3e0) GROUP BY interval_id, g)
SELECT e.interval_id, CAST(coalesce(max(c), 0) AS INTEGER) AS longest, coalesce(max(c), 0) >= 3 AS passes, coalesce(max(CASE WHEN z = m THEN c END), 0) >= 3 AS trailing FROM (SELECT interval_id, max(bin_idx) AS m FROM pv GROUP BY interval_id) e LEFT JOIN r USING (interval_id) GROUP BY e.interval_id""")
def _(s, d):
    p = _bins(s, d).groupBy("interval_id", "bin_idx").agg((F.sum("n") / 40).alias("p"))
    return P.consecutive_above(p, 0.3, 3)


@_query("rp_against_null", f"""WITH {_BIN}, sc AS (SELECT interval_id, sum(n) * 1e0 AS score FROM bins WHERE series_id = 'view' GROUP BY ALL), nu AS (SELECT interval_id, series_id, sum(n) AS s FROM bins WHERE series_id <> 'view' GROUP BY ALL)
SELECT interval_id, score, round((count(*) FILTER (WHERE s >= score) + 1) / (count(*) + 1), 9) AS p, round((score - avg(s)) / nullif(stddev_pop(s), 0), 6) AS z FROM sc JOIN nu USING (interval_id) GROUP BY interval_id, score""")
def _(s, d):
    b = _bins(s, d)
    own = b.where("series_id = 'view'").groupBy("interval_id").agg((F.sum("n") * 1.0).alias("score"))
    null = b.where("series_id <> 'view'").groupBy("interval_id", "series_id").agg(F.sum("n").alias("score"))
    return _round(_round(P.against_null(own, null, ["interval_id"]), "p", digits=9), "z")


# --- hidden states (no SQL; tests hold them against sums over all paths) ------------------------------

def _fitted(s, d):
    b = _bins(s, d)
    series = H.series_of(b)
    w = written(H.wide(b, series), "wide")  # every round reads it
    return w, H.fit(w, H.initial(w, series, 3), 2), series


def _hour_of(w):
    return w.select("interval_id", "bin_idx", (F.col("bin_idx") + 9).alias("x"))


def _posteriors(s, d):
    w, m, _ = _fitted(s, d)
    return _round(H.posteriors(w, m), "p")


def _increments(s, d):
    w, m, _ = _fitted(s, d)
    return _round(H.increments(w, m), "loglik", "total")


def _covariate(s, d):
    w, m, _ = _fitted(s, d)
    return _round(H.covariate_map(H.posteriors(w, m), _hour_of(w)), "weight")


def _decoded(s, d):
    w, m, _ = _fitted(s, d)
    post = written(H.posteriors(w, m), "post")  # read for the map and to decode
    return _round(H.decoded_covariate(post, H.covariate_map(post, _hour_of(w))), "p")


def _memoryless(s, d):
    b = _bins(s, d)
    m = _fitted(s, d)[1]
    return _round(H.memoryless(b.select("series_id", (F.col("interval_id") * 100 + F.col("bin_idx")).alias("t_bin"), "n"), m), "p")


def _cross(s, d):
    w, _, series = _fitted(s, d)
    return _round(H.cross_scores(w, series, 3, 2, 1, 4), "score", "p", "z")


def _quality(s, d):
    w, _, series = _fitted(s, d)
    return _round(H.quality(w, series, 3, 2, 1, 3), "score", "quality")


def _shuffled(s, d):
    b = _bins(s, d)
    model = _fitted(s, d)[1]
    out = None
    for kind in ("time", "pooled", "cycle", "series", "poisson", "transitions"):
        one = _round(H.shuffled_scores(b, model, kind, 3, 17), "score", "p", "z").withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


_QUERIES.update({"hmm_shuffled_scores": _shuffled, "hmm_posteriors": _posteriors, "hmm_increments": _increments, "hmm_covariate_map": _covariate, "hmm_decoded_covariate": _decoded, "hmm_memoryless": _memoryless, "hmm_cross_scores": _cross, "hmm_quality": _quality})
