"""Registered queries of hidden Markov models whose parameters SQL can state, of long intervals, windows, and surrogates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeops import HOUR, floordiv
from ..operators import hmm as H
from ..operators import markov as M
from ..operators import shuffles as P
from ..scratch import written
from ..sources.tables import events
from .catalogue import _BIN, _MK, _QUERIES, _bins, _query, _round, _trans
from .fields import _EVENTS, _events_post, _hour_of

#: The forward pass of three states over the bins of each interval: rates at half, once and one and a half times the
#: mean, 0.8 to stay, 0.1 to each other state; a row has the scaled chances of all three.
_STEP = "(a0 * {p0} + a1 * {p1} + a2 * {p2}) * exp(e.e{i} - e.top)"
_NEXT = ", ".join(_STEP.format(i=i, **{f"p{j}": "0.8e0" if i == j else "0.1e0" for j in range(3)}) + f" AS x{i}" for i in range(3))
_LL = ", ".join(f"sum(n * ln(greatest({f} * m, 1e-3)) - greatest({f} * m, 1e-3) - lgamma(n + 1)) AS e{i}" for i, f in enumerate(("0.5e0", "1e0", "1.5e0")))
_FORWARD = f"""{_BIN}, mean AS (SELECT series_id, avg(n) AS m FROM bins GROUP BY series_id), em AS (SELECT *, greatest(e0, e1, e2) AS top FROM (SELECT interval_id, bin_idx, {_LL} FROM bins JOIN mean USING (series_id) GROUP BY ALL)),
f(interval_id, bin_idx, a0, a1, a2, step, total) AS (
 SELECT interval_id, bin_idx, x0 / s, x1 / s, x2 / s, ln(s) + top, ln(s) + top FROM (SELECT *, x0 + x1 + x2 AS s FROM (SELECT interval_id, bin_idx, top, exp(e0 - top) / 3 AS x0, exp(e1 - top) / 3 AS x1, exp(e2 - top) / 3 AS x2 FROM em WHERE bin_idx = 0))
 UNION ALL SELECT interval_id, bin_idx, x0 / s, x1 / s, x2 / s, ln(s) + top, total + ln(s) + top FROM (SELECT *, x0 + x1 + x2 AS s FROM (SELECT e.interval_id, e.bin_idx, e.top, f.total, {_NEXT} FROM f JOIN em e ON e.interval_id = f.interval_id AND e.bin_idx = f.bin_idx + 1)))"""


def _wide(s, d):
    b = _bins(s, d)
    series = H.series_of(b)
    w = written(H.wide(b, series), "wide")  # read once for the model and once for each pass
    return w, H.initial(w, series, 3), series


@_query("hmm_forward", f"WITH RECURSIVE {_FORWARD} SELECT interval_id, count(*) AS n_bins, round(max_by(total, bin_idx), 5) AS loglik FROM f GROUP BY interval_id")
def _(s, d):
    w, model, _ = _wide(s, d)
    return _round(H.scores(w, model), "loglik", digits=5)


@_query("hmm_forward_in_stretches", f"WITH RECURSIVE {_FORWARD} SELECT interval_id, CAST(bin_idx AS INTEGER) AS bin_idx, round(step, 5) AS loglik, round(total, 5) AS total FROM f")
def _(s, d):
    w, model, _ = _wide(s, d)
    return _round(H.increments(w, model, chunk=3), "loglik", "total", digits=5)


def _one_interval(s, d):
    """All hours from the first event to the last as one interval."""
    ev = events(s, d).select("series_id", floordiv(F.col("t"), HOUR).alias("h"))
    ends = ev.agg(F.min("h").alias("a"), F.max("h").alias("z"))
    hours = ends.select("a", F.explode(F.sequence("a", "z")).alias("h"))
    some = ev.groupBy("series_id", "h").agg(F.count("*").alias("n"))
    rows = hours.crossJoin(ev.select("series_id").distinct()).join(some, ["series_id", "h"], "left")
    return rows.select("series_id", F.lit(0).cast("long").alias("interval_id"), (F.col("h") - F.col("a")).cast("int").alias("bin_idx"), F.coalesce("n", F.lit(0)).alias("n"))


def _long_paths(s, d):
    b = _one_interval(s, d)
    series = H.series_of(b)
    w = written(H.wide(b, series), "wide")
    return H.paths(w, H.fit(w, H.initial(w, series, 3), 2, chunk=256), chunk=256)


def _windows(s, d):
    b = H.sliding(_bins(s, d), 3)
    series = H.series_of(b)
    w = written(H.wide(b, series), "wide")
    return _round(H.posteriors(w, H.fit(w, H.initial(w, series, 3), 2)), "p")


def _states_of(s, d):
    w, model, _ = _wide(s, d)
    return _round(H.states_of_covariate(H.posteriors(w, H.fit(w, model, 2)), _hour_of(w)), "weight")


def _surrogates(s, d):
    w, _, series = _wide(s, d)
    rows, _ = H.surrogates(w, series, 3, 2)
    return _round(rows, "loglik")


def _null(s, d):
    w, _, series = _wide(s, d)
    f, models, _ = H.held_out(w, series, 3, 5, 1)
    return _round(H.null_scores(f, models, "time", 20, 3), "loglik").select("interval_id", "shuffle", "n_bins", "loglik")


_QUERIES.update({"hmm_long_interval_paths": _long_paths, "hmm_windowed_posteriors": _windows, "hmm_states_of_covariate": _states_of, "hmm_surrogates": _surrogates, "hmm_null_scores": _null})


_U = "CAST(('0x' || substr(md5(concat_ws('/', '{}', interval_id, k)), 1, 8)) AS BIGINT) / 4294967296e0"


@_query("rp_best_line", f"""WITH {_EVENTS}, near AS (SELECT interval_id, bin_idx, cell, sum(p) OVER (PARTITION BY interval_id, bin_idx ORDER BY cell RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS q FROM pe),
mid AS (SELECT interval_id, bin_idx, median(p) AS med FROM pe GROUP BY ALL), size AS (SELECT interval_id, max(bin_idx) + 1 AS n FROM mid GROUP BY ALL),
ln AS (SELECT *, ({_U.format(11)} - 0.5e0) * pi() AS phi, ({_U.format(12)} - 0.5e0) * sqrt(n * n + 576e0) AS rho FROM size, (SELECT unnest(generate_series(0, 199)) AS k)),
li2 AS (SELECT *, tan(phi) AS sl, 11.5e0 + rho / cos(phi) - tan(phi) * (n - 1) / 2 AS ic FROM ln),
pl AS (SELECT interval_id, k, sl, ic, bin_idx, least(greatest(round(sl * bin_idx + ic), -1e6), 1e6) AS cell FROM (SELECT *, unnest(generate_series(0, n - 1)) AS bin_idx FROM li2)),
sc AS (SELECT pl.interval_id, k, any_value(sl) AS sl, any_value(ic) AS ic, avg(coalesce(q, med, 0)) AS score FROM pl LEFT JOIN near ON near.interval_id = pl.interval_id AND near.bin_idx = pl.bin_idx AND near.cell = pl.cell LEFT JOIN mid ON mid.interval_id = pl.interval_id AND mid.bin_idx = pl.bin_idx GROUP BY ALL)
SELECT DISTINCT ON (interval_id) interval_id, round(sl, 5) AS slope, round(ic, 5) AS intercept, round(score, 5) AS score FROM sc ORDER BY interval_id, score DESC, k""")
def _(s, d):
    return _round(P.best_line(_events_post(s, d)[0], 24, 200, 2, 11), "slope", "intercept", "score", digits=5)


_RS = "md5(concat_ws('/', '13', k, interval_id, bin_idx))"


@_query("rp_line_shuffles", f"""WITH {_EVENTS}, many AS (SELECT pm.*, k FROM pm, (SELECT unnest(generate_series(0, 20)) AS k)), a AS (SELECT *, row_number() OVER (PARTITION BY interval_id, k ORDER BY bin_idx) AS r FROM many),
b AS (SELECT interval_id, k, bin_idx AS place, row_number() OVER (PARTITION BY interval_id, k ORDER BY CASE WHEN k > 0 THEN {_RS} END, bin_idx) AS r FROM many)
SELECT a.interval_id, CAST(a.k AS INTEGER) AS shuffle, round(regr_r2(x, place), 5) AS r2 FROM a JOIN b ON a.interval_id = b.interval_id AND a.k = b.k AND a.r = b.r GROUP BY ALL""")
def _(s, d):
    return _round(P.line_shuffles(_events_post(s, d)[1], 20, 13), "r2", digits=5)


def _event_scores(s, d):
    w, _, series = _wide(s, d)
    return _round(H.event_scores(w, series, 3, 50, "columns", 5, 1, 3)[0], "score", "percentile")


_QUERIES["hmm_event_scores"] = _event_scores


# --- chains: SQL goes on step by step until nothing changes -------------------------------------

@_query("mk_stationary", f"""WITH RECURSIVE {_MK}, v(k, state, p) AS (SELECT 0, i, 1e0 / count(*) OVER () FROM (SELECT DISTINCT i FROM tr)
UNION ALL SELECT k + 1, tr.j, sum(v.p * tr.p) FROM v JOIN tr ON v.state = tr.i WHERE k < 200 GROUP BY k + 1, tr.j) SELECT state, round(p, 6) AS p FROM v WHERE k = 200""")
def _(s, d):
    return _round(M.stationary(_trans(s, d)[1]), "p")


@_query("mk_passages", f"""WITH RECURSIVE {_MK}, st AS (SELECT DISTINCT i AS s FROM tr), m(k, i, j, a, b) AS (SELECT 0, x.s, y.s, 0e0, 0e0 FROM st x, st y
UNION ALL SELECT k + 1, tr.i, m.j, 1 + sum(CASE WHEN tr.j <> m.j THEN tr.p * m.a ELSE 0 END), 1 + sum(CASE WHEN tr.j <> m.j THEN tr.p * (2 * m.a + m.b) ELSE 0 END) FROM tr JOIN m ON tr.j = m.i WHERE k < 600 GROUP BY k + 1, tr.i, m.j)
SELECT i, j, round(a, 5) AS steps, round(b - a * a, 4) AS variance FROM m WHERE k = 600""")
def _(s, d):
    return _round(_round(M.passages(_trans(s, d)[1]), "steps", digits=5), "variance", digits=4)


def _sparsity(s, d):
    """A fitted model's Gini coefficients and bottleneck: as many rows as the model has states and series."""
    w, model, _ = _wide(s, d)
    rows = [(name, k, v) for name, values in H.sparsity(H.fit(w, model, 2)).items() for k, v in enumerate(values)]
    return _round(s.createDataFrame(rows, "measure string, place int, value double"), "value")


_QUERIES["hmm_sparsity"] = _sparsity
