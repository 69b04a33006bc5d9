"""Hidden states, curves, shuffles and selections on small cases and against sums over all paths."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions import texts
from spanforge.operators import decode, hmm, intervals, markov, ratemap, selection, shuffles, signals

MODEL = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[1.0, 3.0], [4.0, 0.5]]), ("a", "b"))
X = np.array([[1, 2], [5, 0], [0, 3], [4, 1]], float)


def _wide(spark, x=X, interval=1):
    return spark.createDataFrame([(interval, i, v.tolist()) for i, v in enumerate(x)], "interval_id long, bin_idx int, x array<double>")


def _paths():
    for path in itertools.product(range(2), repeat=len(X)):
        p = MODEL.start[path[0]] * np.prod([MODEL.trans[a, b] for a, b in zip(path, path[1:])])
        for s, x in zip(path, X):
            p *= np.prod([math.exp(-r) * r**n / math.factorial(int(n)) for r, n in zip(MODEL.rates[s], x)])
        yield path, p


def test_posteriors_and_increments(spark):
    total = sum(p for _, p in _paths())
    want = np.array([[sum(p for path, p in _paths() if path[t] == s) / total for s in range(2)] for t in range(len(X))])
    got = {(r.bin_idx, r.state): r.p for r in hmm.posteriors(_wide(spark), MODEL).collect()}
    assert all(abs(got[t, s] - want[t, s]) < 1e-9 for t in range(4) for s in range(2))
    steps = sorted(hmm.increments(_wide(spark), MODEL).collect(), key=lambda r: r.bin_idx)
    assert abs(steps[-1].total - math.log(total)) < 1e-9 and abs(sum(r.loglik for r in steps) - math.log(total)) < 1e-9


def test_covariates_of_states(spark):
    post = hmm.posteriors(_wide(spark), MODEL)
    ext = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 5), (1, 3, 6)], "interval_id long, bin_idx int, x int")
    w = {(r.state, r.x): r.weight for r in hmm.covariate_map(post, ext).collect()}
    assert all(abs(w[s, 5] + w[s, 6] - 1) < 1e-9 for s in range(2))
    back = hmm.decoded_covariate(post, hmm.covariate_map(post, ext)).groupBy("bin_idx").agg(F.sum("p").alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-9 for r in back)


def test_order_samples_and_shuffles(spark):
    m = hmm.Model(np.ones(3) / 3, np.array([[0.1, 0.2, 0.7], [0.5, 0.4, 0.1], [0.2, 0.6, 0.2]]), np.ones((3, 2)), ("a", "b"))
    assert hmm.state_order(m, 0) == [0, 2, 1]
    r = hmm.reordered(m, [2, 0, 1], ["b", "a"])
    assert r.trans[0, 1] == 0.2 and r.series == ("b", "a")
    s = hmm.with_shuffled_transitions(m, 3).trans
    assert np.allclose(s.sum(1), 1) and np.allclose(np.diag(s), np.diag(m.trans)) and np.allclose(np.sort(s, 1), np.sort(m.trans, 1))
    iv = spark.createDataFrame([(k, 300) for k in range(20)], "interval_id long, n_bins int")
    got = hmm.sampled(spark, MODEL, iv, 1).toPandas().sort_values(["interval_id", "bin_idx"])
    assert len(got) == 6000 and abs((got.state == 0).mean() - 0.4) < 0.05
    assert abs(np.stack(got[got.state == 1].x).mean(0) - MODEL.rates[1]).max() < 0.2
    again = hmm.sampled(spark, MODEL, iv, 1).toPandas().sort_values(["interval_id", "bin_idx"])
    assert (again.state.to_numpy() == got.state.to_numpy()).all()


def test_ordered_data_score_above_their_shuffles(spark):
    iv = spark.createDataFrame([(k, 60) for k in range(6)], "interval_id long, n_bins int")
    m = hmm.Model(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.05, 0.95]]), np.array([[0.5, 5.0], [5.0, 0.5]]), ("a", "b"))
    w = hmm.sampled(spark, m, iv, 5).select("interval_id", "bin_idx", "x")
    got = hmm.quality(w, ("a", "b"), 2, 2, 3, 4).first()
    assert got.quality > 3
    scores = hmm.cross_scores(w, ("a", "b"), 2, 2, 3, 4, kind="time").collect()
    assert len(scores) == 6 and all(r.p <= 0.2 + 1e-9 for r in scores)


@pytest.mark.parametrize("kind", ["time", "pooled", "cycle", "series", "poisson", "transitions"])
def test_shuffles_score_every_interval(spark, kind):
    rng = np.random.default_rng(2)
    rows = [(k, i, b, int(rng.poisson(2))) for k in ("a", "b") for i in range(3) for b in range(8)]
    b = spark.createDataFrame(rows, "series_id string, interval_id long, bin_idx int, n long")
    got = hmm.shuffled_scores(b, MODEL, kind, 3, 1).collect()
    assert sorted(r.interval_id for r in got) == [0, 1, 2] and all(0.25 <= r.p <= 1 for r in got)


def test_best_line_finds_a_diagonal(spark):
    rows = [(1, b, c, 0.8 if c == b else 0.2 / 19) for b in range(20) for c in range(20)]
    post = spark.createDataFrame(rows, "interval_id long, bin_idx int, cell int, p double")
    r = shuffles.best_line(post, 20, 3000, 1, 4).first()
    assert abs(r.slope - 1) < 0.25 and r.score > 0.75
    line = spark.createDataFrame([(1, 1.0, 0.0)], "interval_id long, slope double, intercept double")
    assert abs(shuffles.trajectory_score(post, line, 20, 0, True).first().score - 0.8) < 1e-9


def test_poisson_surrogates_have_the_mean(spark):
    b = spark.createDataFrame([("a", 1, i, 3) for i in range(4000)] + [("b", 1, i, 0) for i in range(10)], "series_id string, interval_id long, bin_idx int, n long")
    got = shuffles.poisson_surrogate(b, 1).groupBy("series_id").agg(F.avg("n").alias("m"), F.var_pop("n").alias("v")).collect()
    of = {r.series_id: r for r in got}
    assert abs(of["a"].m - 3) < 0.15 and abs(of["a"].v - 3) < 0.3 and of["b"].m == 0


def test_places_from_the_end(spark):
    rows = [(k, s, s + 1) for k, n in (("a", 9), ("b", 3), ("c", 1)) for s in range(0, 2 * n, 2)]
    iv = spark.createDataFrame(rows, "k string, start long, stop long")
    for pick in (slice(-4, -1, 2), slice(-20, 3), slice(2, -2), slice(None, None, 3), slice(-2, None)):
        want = [r for k in "abc" for r in [x for x in rows if x[0] == k][pick]]
        assert sorted(map(tuple, selection.intervals_by_place(iv, ["k"], pick).collect())) == sorted(want)
    ev = spark.createDataFrame([(x, i) for i, x in enumerate("abcdefab")], "series_id string, t long")
    assert {r.series_id for r in selection.series_by_place(ev, slice(-3, -1)).collect()} == {"d", "e"}


@pytest.mark.parametrize("mean", [0.1, 3.0, 100.0, 2000.0, 1e5])
def test_poisson_surrogates_of_any_mean(spark, mean):
    n = 100_000
    b = spark.range(n).select(F.lit("a").alias("series_id"), F.lit(1).cast("long").alias("interval_id"), F.col("id").cast("int").alias("bin_idx"), F.lit(mean).alias("n"))
    got = shuffles.poisson_surrogate(b, 1).agg(F.avg("n").alias("m"), F.var_pop("n").alias("v"), F.min("n").alias("a"), F.count("*").alias("c")).first()
    assert got.c == n and got.a >= 0
    assert abs(got.m / mean - 1) < 0.01 * max(1, 1 / mean / 5) and abs(got.v / mean - 1) < 0.02


def test_poisson_chances_are_exact():
    first, below = shuffles._likely(7.5)
    want = np.cumsum([math.exp(k * math.log(7.5) - 7.5 - math.lgamma(k + 1)) for k in range(60)])
    assert first == 0 and np.abs(below[:60] - want).max() < 1e-13


def test_partial_windows(spark):
    c = spark.createDataFrame([("a", 1, t, t) for t in range(5)] + [("a", 2, 9, 7), ("a", 2, 10, 1)], "series_id string, day long, t_bin long, n long")
    assert sorted((r.day, r.t_bin, r.n) for r in decode.windowed(c, "day", 3, partial=True).collect()) == [(1, 0, 3), (1, 1, 6), (1, 2, 9), (2, 9, 8)]


def test_bottleneck_and_passage_variance():
    p = np.array([[0.5, 0.25, 0.25], [0.5, 0, 0.5], [0.25, 0.25, 0.5]])
    assert np.abs(markov.first_passage(p) - [[2.5, 4, 10 / 3], [8 / 3, 5, 8 / 3], [10 / 3, 4, 2.5]]).max() < 1e-9
    assert np.abs(markov.first_passage_variance(p) - [[5.58333, 12, 6.88889], [6.22222, 12, 6.22222], [6.88889, 12, 5.58333]]).max() < 1e-4
    both = np.array([[0.9, 0.1], [0.1, 0.9]])
    assert abs(shuffles.bottleneck(both, np.array([[True, False], [False, True]])) - 0.1) < 1e-12


def test_estimators(spark):
    bins = spark.createDataFrame([(t, t % 4) for t in range(40)], "t_bin long, x int")
    counts = spark.createDataFrame([("u", t, 6 if t % 4 == 1 else 1) for t in range(40)] + [("v", t, 5 if t % 4 == 3 else 1) for t in range(40)], "series_id string, t_bin long, n long")
    m = ratemap.RateMap.fit(counts, bins, ["x"])
    assert {(r.series_id, r.x): r.rate for r in m.rates.collect()}["u", 1] == 6
    assert m.predict(bins).count() == 80 and m.score(counts, bins).first().n_bins == 40
    got = decode.BayesianDecoder(["x"], floor=0.1).fit(counts, bins).predict(counts, "mode").collect()
    assert all(r.x == r.t_bin % 4 for r in got if r.t_bin % 4 in (1, 3))
    assert decode.cross_validated(counts, bins, "x", F.pmod(F.col("t_bin"), F.lit(5)), 5).count() == 40


def test_windows_of_several_bins(spark):
    c = spark.createDataFrame([("a", 1, t, t) for t in range(5)] + [("a", 2, 9, 7)], "series_id string, day long, t_bin long, n long")
    assert sorted((r.t_bin, r.n) for r in decode.windowed(c, "day", 3).collect()) == [(0, 3), (1, 6), (2, 9)]


def test_selection_refuses_what_it_cannot_know(spark):
    with pytest.raises(ValueError):
        selection.series_by_place(spark.createDataFrame([("a",)], "series_id string"), slice(None, None, -1))
    bad = spark.createDataFrame([(1, 5, 3)], "set_id long, start long, stop long")
    with pytest.raises(Exception, match="stops before"):
        intervals.checked(bad).collect()


def test_interpolation_in_chunks_at_the_ends(spark):
    s = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 3.0), ("a", 95, 0.0)], "series_id string, t long, y double")
    p = spark.createDataFrame([("a", t) for t in (0, 10, 15, 57, 95, 200)] + [("b", 1)], "series_id string, t long")
    want = {0: 1.0, 10: 1.0, 15: 2.0, 57: 3.0 - 37 / 25, 95: 0.0, 200: 0.0}
    for chunk in (None, 7, 1000):
        got = {(r.series_id, r.t): r.y for r in signals.interpolate(p, s, ["series_id"], chunk).collect()}
        assert all(abs(got["a", t] - y) < 1e-9 for t, y in want.items()) and got["b", 1] is None


def test_chunks_change_no_derivative_and_no_turn(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(t), float(y)) for k in ("a", "b") for t, y in zip(np.sort(rng.choice(1000, 80, False)), rng.uniform(0, 10, 80))] + [("c", 5, 1.0)]
    s = spark.createDataFrame(rows, "series_id string, t long, y double")
    for f, col in ((signals.gradient, "dy"), (lambda d, k, chunk=None: signals.unwrap(d, k, 10.0, chunk), "unwrapped")):
        plain, cut = ({(r.series_id, r.t): r[col] for r in f(s, ["series_id"], chunk=c).collect()} for c in (None, 37))
        assert len(plain) == 161 and plain.keys() == cut.keys() and all(abs(plain[k] - cut[k]) < 1e-9 for k in plain)


def test_durations_as_text(spark):
    want = {3661.0: "1:01:01 hours", 0.0: "0.0 milliseconds", -61.0: "-1:01 minutes", 0.0125: "12.5 milliseconds", 7.25: "7.25 seconds", 61.25: "1:01:250 minutes", 90061.0: "1 days 1:01:01 hours", float("inf"): "inf", 59.9996: "1:00 minutes"}
    df = spark.createDataFrame([(k,) for k in want], "x double").withColumn("t", texts.duration_text(F.col("x")))
    assert {r.x: r.t for r in df.collect()} == want
