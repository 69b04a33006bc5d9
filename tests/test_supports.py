"""Aggregates that users write, pieces of a support, picked signals, and covariates that stay inside their interval."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import binned, ratemap, selection, signals


@pytest.fixture(scope="module")
def support(spark):
    return spark.createDataFrame([(1, 0, 40), (2, 100, 130), (3, 200, 210)], "interval_id long, start long, stop long")


def test_bins_with_functions_of_their_values(spark, support):
    rng = np.random.default_rng(0)
    rows = [(s, int(t), float(v)) for s in "ab" for t, v in zip(rng.integers(0, 220, 200), rng.normal(size=200), strict=True)]
    ev = spark.createDataFrame(rows, "series_id string, t long, value double")
    got = binned.bin_events(ev, support, 10, {"spread": lambda v: float(v.max() - v.min()), "q": lambda v: float(np.quantile(v, 0.25)), "top": F.max("value")}).collect()
    assert len(got) == 2 * (4 + 3 + 1)
    for r in got:
        start = {1: 0, 2: 100, 3: 200}[r.interval_id] + 10 * r.bin_idx
        v = np.array([x for s, t, x in rows if s == r.series_id and start <= t < start + 10])
        assert r.n == len(v)
        if len(v):
            assert abs(r.spread - np.ptp(v)) < 1e-12 and abs(r.q - np.quantile(v, 0.25)) < 1e-12 and r.top == v.max()
        else:
            assert r.spread is None and r.q is None


def test_pieces_of_a_support(spark, support):
    ev = spark.createDataFrame([("a", t) for t in range(0, 220, 3)], "series_id string, t long")
    got = selection.partitioned(ev, support, n=3).collect()
    assert len(got) == sum(any(a <= t < z for a, z in ((0, 40), (100, 130), (200, 210))) for t in range(0, 220, 3))
    assert all(r.start <= r.t < r.stop for r in got)
    assert {(r.piece, r.start, r.stop) for r in got if r.interval_id == 1} == {(0, 0, 14), (1, 14, 28), (2, 28, 40)}
    assert {(r.piece, r.start, r.stop) for r in selection.partitioned(ev, support, ds=25).collect() if r.interval_id == 2} == {(0, 100, 125), (1, 125, 130)}


@pytest.mark.parametrize("width", [None, 0, 9])
def test_derivatives(spark, width):
    rng = np.random.default_rng(1)
    data = {k: rng.normal(size=(n, 2)) for k, n in ((1, 40), (2, 1), (3, 2))}
    s = spark.createDataFrame([(k, t, *map(float, r)) for k, v in data.items() for t, r in enumerate(v)], "interval_id long, t long, a double, b double")
    grad = {k: np.gradient(v, axis=0) * 4 if len(v) > 1 else v * 0 for k, v in data.items()}
    got = {(r.interval_id, r.t): (r.a, r.b) for r in signals.derivative(s, ["interval_id"], ["a", "b"], 4.0, rectify=False, width=width).collect()}
    assert all(np.allclose(got[k, t], g) for k, v in grad.items() for t, g in enumerate(v))
    got = {(r.interval_id, r.t): r["norm"] for r in signals.derivative(s, ["interval_id"], ["a", "b"], 4.0, norm=True, sigma=0.25, width=width).collect()}
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    for k, v in grad.items():
        y = np.hypot(*v.T)
        m = len(y)
        want = [sum(c * y[min(i % (2 * m), 2 * m - 1 - i % (2 * m))] for c, i in zip(w, range(t - 4, t + 5), strict=True)) / w.sum() for t in range(m)]
        assert np.allclose([got[k, t] for t in range(m)], want)


def test_picked_signals(spark, support):
    s = spark.createDataFrame([(k, t, 1.0) for k in "abcd" for t in range(0, 220, 10)], "series_id string, t long, y double")
    got = {(r.series_id, r.t) for r in selection.sliced(s, support, slice(-2, None), slice(None, None, 2)).collect()}
    assert got == {(k, t) for k in "ac" for t in (100, 110, 120, 200)}
    assert {(r.series_id, r.t) for r in selection.sliced(s, support, [3], ["b"]).collect()} == {("b", 200)}
    assert selection.sliced(s, support).count() == 4 * (4 + 3 + 1)


def test_covariates_stay_inside_their_interval(spark, support):
    s = spark.createDataFrame([(5, 1.0), (25, 3.0), (60, 99.0), (101, 10.0)], "t long, y double")
    got = {r.t_bin: r.y for r in ratemap.covariate_bins(support, s, 10).collect()}
    # the sample at 60 is in no interval, the third interval has none, and nothing comes from another interval
    assert got == {0: 1.0, 10: 2.0, 20: 3.0, 30: 3.0, 100: 10.0, 110: 10.0, 120: 10.0}
    b = spark.createDataFrame([("u", t, 2 if t < 50 else 6) for t in (0, 10, 20, 30, 100, 110, 120, 200)], "series_id string, bin_start long, n long")
    r = {x.y: (x.occupancy, x.rate) for x in ratemap.map_of_signal(b, support, s, 10, {"y": (0.0, 20.0, 2)}, transform=lambda d: d.where("t_bin <> 120")).collect()}
    assert r == {0: (4, 2.0), 1: (2, 6.0)}
    two = s.withColumn("k", F.lit("x"))
    pts = spark.createDataFrame([("x", 15), ("x", 55), ("y", 15)], "k string, t long")
    assert [(r.k, r.interval_id, r.t, r.y) for r in signals.in_support(pts, two, support, ["k"]).collect()] == [("x", 1, 15, 2.0)]
