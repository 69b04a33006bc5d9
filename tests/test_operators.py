"""Literal vectors: intervals, events, bins, signals, detection, curves, decoding, states."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions.timeops import gaussian_weights
from spanforge.operators import binned as B
from spanforge.operators import decode as D
from spanforge.operators import detect as X
from spanforge.operators import events as E
from spanforge.operators import intervals as I
from spanforge.operators import markov as M
from spanforge.operators import ratemap as R
from spanforge.operators import signals as S

K = ["k"]


def iv(spark, *pairs):
    return spark.createDataFrame([(0, a, b) for a, b in pairs], "k int, start long, stop long")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merge(spark):
    a = iv(spark, (1, 3), (4, 8), (12, 13), (20, 25), (1, 5), (6, 7), (15, 18), (30, 35))
    assert rows(I.merge(a, K), "start", "stop") == [(1, 8), (12, 13), (15, 18), (20, 25), (30, 35)]


def test_merge_bridges_gaps_from_the_running_end(spark):
    assert rows(I.merge(iv(spark, (0, 100), (1, 2), (103, 110)), K, 5), "start", "stop") == [(0, 110)]


def test_touching_intervals_stay_apart_when_intersected(spark):
    x, y = iv(spark, (2, 3), (3, 4), (5, 7)), iv(spark, (2, 8))
    assert rows(I.intersect(x, y, K), "start", "stop") == rows(I.intersect(y, x, K), "start", "stop") == [(2, 3), (3, 4), (5, 7)]


def test_partition(spark):
    assert rows(I.partition(iv(spark, (0, 10)), K, n=5), "start", "stop") == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]


def test_complement_and_difference(spark):
    a = iv(spark, (2, 4), (3, 6), (8, 9))
    assert rows(I.complement(a, K, 0, 10), "start", "stop") == [(0, 2), (6, 8), (9, 10)]
    assert rows(I.difference(a, iv(spark, (3, 5)), K), "start", "stop") == [(2, 3), (5, 6), (8, 9)]
    assert rows(I.difference(a, iv(spark).where("false"), K), "start", "stop") == [(2, 6), (8, 9)]


@pytest.mark.parametrize("seed", range(3))
def test_set_identities(spark, seed):
    rng = np.random.default_rng(seed)
    pick = lambda: iv(spark, *[(int(s), int(s + n)) for s, n in zip(rng.integers(0, 90, 12), rng.integers(1, 9, 12), strict=True)])
    a, b = pick(), pick()
    assert rows(I.merge(I.intersect(a, b, K), K), "start", "stop") == rows(I.merge(I.intersect(b, a, K), K), "start", "stop")
    twice = I.complement(I.complement(a, K, 0, 100), K, 0, 100)
    assert rows(twice, "start", "stop") == rows(I.merge(a, K), "start", "stop")
    inside = I.measure(a, K).first()["length"] + I.measure(I.complement(a, K, 0, 100), K).first()["length"]
    assert inside == 100


def test_segments(spark):
    t = spark.createDataFrame([(0, x) for x in (1, 11, 21, 31, 51, 61)], "k int, t long")
    assert rows(E.segments(t, K, 10), "start", "stop") == [(1, 41), (51, 71)]


def test_bins_and_statistics(spark):
    ev = spark.createDataFrame([(0, t) for t in (3, 4, 5, 6, 7)] + [(1, t) for t in (2, 4, 5)], "series_id int, t long")
    b = B.bin_events(ev, spark.createDataFrame([(0, 0, 8)], "interval_id int, start long, stop long"), 1)
    assert [r["mean"] for r in B.stats(b).orderBy("series_id").collect()] == [0.625, 0.375]
    assert [r["n"] / 2 for r in B.flatten(b).orderBy("bin_idx").collect()] == [0, 0, 0.5, 0.5, 1, 1, 0.5, 0.5]
    assert B.rebin(b, 1).count() == b.count()


def test_bins_inside_intervals_only(spark):
    at = [4, 8, 17]
    ev = spark.createDataFrame([(1, t * 10) for t in at], "series_id int, t long")
    support = spark.createDataFrame([(0, 0, 80), (1, 120, 220)], "interval_id int, start long, stop long")
    part = spark.createDataFrame([(0, 20, 80), (0, 90, 140), (1, 90, 140), (1, 195, 250)], "interval_id int, start long, stop long")
    got = B.inside(B.bin_events(ev, support, 10), part, 10)
    assert [r.bin_start for r in got.orderBy("bin_start").collect()] == [20, 30, 40, 50, 60, 70, 120, 130, 200, 210]


def test_gradient_and_gini(spark):
    s = spark.createDataFrame([(0, i, float(y)) for i, y in enumerate((1, 4, 9, 16))], "k int, t long, y double")
    assert [r.dy for r in S.gradient(s, K).orderBy("t").collect()] == [3, 4, 6, 7]
    assert M.gini(spark.createDataFrame([(0, v) for v in (1, 2, 3, 4)], "k int, v int"), K, "v").first().gini == pytest.approx(0.25)


def test_statistics_skip_nulls(spark):
    s = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0), (0, 3, 4.0)], "k int, t long, y double")
    r = S.stats(s, K).first()
    assert (r["min"], r["max"], r["n"]) == (1, 4, 3) and r["std"] == pytest.approx(np.std([1, 3, 4]))


def test_interpolation_holds_the_ends(spark):
    s = spark.createDataFrame([(0, 10, 1.0), (0, 20, 3.0)], "k int, t long, y double")
    p = spark.createDataFrame([(0, t) for t in (0, 10, 15, 20, 30)], "k int, t long")
    assert [r.y for r in S.interpolate(p, s, K).orderBy("t").collect()] == [1, 1, 2, 3, 3]


def test_threshold_runs(spark):
    x = spark.createDataFrame([(0, i, v) for i, v in enumerate((0, 1, 2, 3, 2, 1, 0, 0, 3, 4, 3, 2))], "k int, i int, v int")
    assert rows(X.crossings(x, K, "i", "v", 2.5), "first", "last", "best") == [(3, 3, 3), (8, 10, 4)]


def test_information(spark):
    r = spark.createDataFrame([(0, i, 1, v) for i, v in enumerate((0.5, 1.0, 2.0, 1.0, 0.5))], "series_id int, h int, occupancy long, rate double")
    got = R.information(r).first()
    assert got.si == pytest.approx(0.2) and got.selectivity == pytest.approx(2) and got.sparsity == pytest.approx(0.769231, abs=1e-6)
    assert got.info_rate == pytest.approx(got.si * got.mean_rate)


def test_posterior(spark):
    rates = spark.createDataFrame([(u, x, r) for u, rs in enumerate(((0.1, 0.2, 0.3), (0.4, 0.5, 0.6))) for x, r in enumerate(rs)], "series_id int, x int, rate double")
    counts = spark.createDataFrame([(u, t, n) for t, ns in enumerate(((1, 0), (0, 1), (1, 1))) for u, n in enumerate(ns)], "series_id int, t_bin int, n int")
    got = [r.p for r in D.posterior(counts, rates, "x").orderBy("t_bin", "x").collect()]
    assert got == pytest.approx([0.215127, 0.352262, 0.432611, 0.330154, 0.337884, 0.331963, 0.164928, 0.337578, 0.497494], abs=1e-6)


def test_passage_times():
    p = np.array([[0.5, 0.25, 0.25], [0.5, 0, 0.5], [0.25, 0.25, 0.5]])
    assert np.allclose(M.first_passage(p), [[2.5, 4, 10 / 3], [8 / 3, 5, 8 / 3], [10 / 3, 4, 2.5]])
    assert np.allclose(M.first_passage_variance(p), [[5.58333, 12, 6.88889], [6.22222, 12, 6.22222], [6.88889, 12, 5.58333]], atol=1e-4)
    assert np.allclose(M.steady_state(np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.1, 0.2, 0.7]])), [0.25, 0.5, 0.25])


def test_reflected_smoothing_equals_numpy(spark):
    v = np.random.default_rng(0).normal(size=9)
    b = spark.createDataFrame([(0, 0, i, float(x)) for i, x in enumerate(v)], "series_id int, interval_id int, bin_idx int, n double")
    w = gaussian_weights(1.5)
    got = [r.y for r in B.smooth(b, w, ["series_id", "interval_id"]).orderBy("bin_idx").collect()]
    assert np.allclose(got, np.convolve(np.pad(v, len(w) // 2, mode="symmetric"), w, mode="valid"))


def test_state_before_the_first_event_is_the_first_state(spark):
    ev = spark.createDataFrame([(0, 5, "a"), (0, 9, "b")], "k int, t long, s string")
    p = spark.createDataFrame([(0, t) for t in (1, 5, 8, 9, 20)], "k int, t long")
    assert [r.state for r in E.state_asof(p, ev, K, "s").orderBy("t").collect()] == ["a", "a", "a", "b", "b"]


def test_unwrap(spark):
    s = spark.createDataFrame([(0, i, y) for i, y in enumerate((22.0, 23.0, 1.0, 2.0, 23.0))], "k int, t int, y double")
    assert [r.unwrapped for r in S.unwrap(s, K, 24.0).orderBy("t").collect()] == [22, 23, 25, 26, 23]
    assert math.isclose(sum(gaussian_weights(2.0)), 1)


def test_restrict_is_half_open(spark):
    ev = spark.createDataFrame([(0, t) for t in (0, 5, 9, 10)], "series_id int, t long")
    win = spark.createDataFrame([(0, 0, 10)], "interval_id int, start long, stop long")
    assert rows(E.restrict(ev, win, 4), "t") == [(0,), (5,), (9,)]
    assert rows(E.restrict(ev, win, 4, closed_right=True), "t") == [(0,), (5,), (9,), (10,)]
    assert rows(E.outside(ev, win, 4), "t") == [(10,)]
    plan = E.restrict(ev, win, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert F is not None
