"""Scans in pieces equal windows over whole series, and no window is over a whole series."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanforge import scratch
from spanforge.operators import binned, detect, events, filters, geometry, intervals, scans, selection, signals

K = ["k"]


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    rows = []
    for k, n in (("long", 3000), ("short", 7), ("one", 1), (None, 40)):
        t = 0
        for _ in range(n):
            t += rng.choice([1, 1, 1, 2, 900])
            rows.append((k, t, float(rng.randint(0, 9)), float(rng.randint(0, 5)), rng.choice([None, "a", "b"])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t long, y double, x double, state string").repartition(7)


def same(a, b, *cols):
    out = [[tuple(r) for r in df.select(*cols).collect()] for df in (a, b)]
    assert sorted(out[0], key=str) == sorted(out[1], key=str)
    assert out[0]


WIDTHS = [0, 5000, 100_000_000]


@pytest.mark.parametrize("width", WIDTHS)
def test_numbers_running_values_neighbours(series, width):
    w = Window.partitionBy("k").orderBy("t")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    p = scans.pieces(series, K, "t", width)
    same(scans.numbered(p, K, "t", "i", "n"), series.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("k"))), "k", "t", "i", "n")
    for how in ("sum", "max", "min"):
        same(scans.running(p, K, "t", F.col("y"), "r", how), series.withColumn("r", getattr(F, how)("y").over(up)), "k", "t", "r")
    some = F.when(F.col("y") > 4, F.col("y"))
    same(scans.running(p, K, "t", some, "r"), series.withColumn("r", F.sum(some).over(up)), "k", "t", "r")
    got = scans.neighbours(p, K, "t", ["y", "state"]).select("k", "t", F.col("_before.y").alias("a"), F.col("_before.state").alias("s"), F.col("_after.y").alias("z"), F.col("_after.t").alias("n"))
    same(got, series.select("k", "t", F.lag("y").over(w).alias("a"), F.lag("state").over(w).alias("s"), F.lead("y").over(w).alias("z"), F.lead("t").over(w).alias("n")), "k", "t", "a", "s", "z", "n")
    same(scans.filled(p, K, "t", "state", "f"), series.withColumn("f", F.last("state", ignorenulls=True).over(up)), "k", "t", "f")


@pytest.mark.parametrize("width", WIDTHS)
def test_runs_and_stretches(series, width):
    for flag in (F.col("y") > 3, F.lit(True), F.lit(False), F.col("state") == "a"):
        a, b = (detect.runs(series, K, "t", flag, F.col("y"), w) for w in (width, None))
        assert sorted(map(str, a.select("k", "first", "last", "best", "n").collect())) == sorted(map(str, b.select("k", "first", "last", "best", "n").collect()))
    known = series.where("k is not null")
    same(detect.epochs(known, K, 8.0, second=4.0, width=width), detect.epochs(known, K, 8.0, second=4.0), "k", "start", "stop")
    same(events.segments(series, K, 2, width=width), events.segments(series, K, 2), "k", "start", "stop", "n")
    same(signals.directions(series, K, width), signals.directions(series, K), "k", "direction", "start", "stop")
    same(geometry.laps(series, K, 10.0, width), geometry.laps(series, K, 10.0), "k", "t", "lap")
    same(geometry.lap_epochs(series, K, 10.0, width), geometry.lap_epochs(series, K, 10.0), "k", "lap", "start", "stop")
    for least in (1, 2):
        same(detect.boundaries(known, K, "t", "y", 1.0, least, width=width), detect.boundaries(known, K, "t", "y", 1.0, least), "k", "start", "stop", "best")


@pytest.mark.parametrize("width", WIDTHS)
def test_signals_in_pieces(series, width):
    a, b = (df.select("k", "t", F.round("speed", 9).alias("s"), F.round("heading", 9).alias("h")) for df in (signals.velocity(series, K, "x", "y", 2.0, width), signals.velocity(series, K, "x", "y", 2.0)))
    same(a, b, "k", "t", "s", "h")
    same(signals.path_length(series, K, "x", "y", width).withColumn("length", F.round("length", 6)), signals.path_length(series, K, "x", "y").withColumn("length", F.round("length", 6)), "k", "length")
    same(signals.sampling(series, K, width), signals.sampling(series, K), "k", "n_samples", "step", "first", "last", "low", "high")
    same(signals.cdf(series, K, width and 3), signals.cdf(series, K), "k", "t", "p")


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("gap", [0, 3])
def test_merged_intervals(spark, width, gap):
    rng = random.Random(width + gap)
    rows = []
    for k in ("a", "b", None):
        for _ in range(400):
            s = rng.randrange(60_000)
            rows.append((k, s, s + rng.choice([0, 1, 5, 60, 60, 9000 if rng.random() < 0.02 else 20])))
    iv = spark.createDataFrame(rows, "k string, start long, stop long").repartition(5)
    same(scans.merged(iv, K, width, gap), intervals.merge(iv, K, gap), "k", "start", "stop")
    same(scans.merged(iv.drop("k"), [], width, gap).withColumn("k", F.lit(1)), intervals.merge(iv.withColumn("k", F.lit(1)), K, gap), "k", "start", "stop")


@pytest.mark.parametrize("width", WIDTHS)
def test_algebra_of_long_sets(spark, width):
    rng = random.Random(width)
    make = lambda n: spark.createDataFrame([(rng.choice("ab"), s, s + rng.choice([0, 3, 40, 900])) for s in (rng.randrange(40_000) for _ in range(n))], "k string, start long, stop long").repartition(4)
    a, b = make(300), make(200)
    same(intervals.union(a, b, K, width), intervals.union(a, b, K), "k", "start", "stop")
    same(intervals.complement(a, K, -50, 50_000, width), intervals.complement(a, K, -50, 50_000), "k", "start", "stop")
    same(intervals.difference(a, b, K, width), intervals.difference(a, b, K), "k", "start", "stop")
    same(intervals.collapse(a, K, 5, width), intervals.collapse(a, K, 5), "k", "start", "stop", "new_start", "new_stop")
    pts = spark.createDataFrame([(rng.choice("ab"), rng.randrange(41_000)) for _ in range(500)], "k string, t long")
    same(intervals.contains(pts, a, K, width), intervals.contains(pts, a, K), "k", "t")


def test_states_in_pieces(series):
    known = series.where("k is not null")
    pts = known.select("k", (F.col("t") - 3).alias("t"))
    same(events.state_asof(pts, known, K, "state", pieces=True), events.state_asof(pts, known, K, "state"), "k", "t", "state")


def test_boundaries_with_given_thresholds(spark):
    y = [0, 2, 5, 3, 0, 2, 2, 0, 9, 9, 1, -4, -6, -4, 0]
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, t long, y double")
    find = lambda **o: sorted((r.start, r.stop, r.best) for r in detect.boundaries(s, K, "t", "y", **o).collect())
    assert find(primary=4, secondary=2) == [(1, 3, 5.0), (8, 9, 9.0)]
    assert find(primary=4, secondary=2, least_primary=2) == [(8, 9, 9.0)]
    assert find(primary=-5, secondary=-4, mode="below") == [(11, 13, -6.0)]
    assert find(primary=4, secondary=2, most=2) == [(8, 9, 9.0)]


def test_one_long_series_is_many_tasks(spark):
    one = spark.range(200_000).select(F.lit("a").alias("k"), (F.col("id") * 3).alias("t"), F.sin(F.col("id") / 50).alias("y")).repartition(5)
    for width in (0, 30_000):
        n = scans.numbered(scans.pieces(one, K, "t", width), K, "t", "i")
        share = n.groupBy("_p").agg(F.count("*").alias("c"), F.min("i").alias("a"), F.max("i").alias("z")).orderBy("a").collect()
        assert len(share) >= 4 and max(r.c for r in share) < 100_000
        assert all(x.z + 1 == y.a for x, y in zip(share, share[1:], strict=False)) and share[-1].z == 199_999
    plan = filters.zero_phase(one, K, 100.0, high=5.0, chunk=4096, halo=64, width=30_000)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window" in x and "row_number" in x]
    assert windows and all("_p#" in x for x in windows)


def test_filters_do_not_depend_on_pieces(spark):
    one = spark.range(4000).select(F.lit("a").alias("k"), (F.col("id") * 10).alias("t"), (F.sin(F.col("id") / 5) + F.sin(F.col("id") / 90)).alias("y"))
    want = {r.t: r.y for r in filters.zero_phase(one, K, 100.0, high=5.0, chunk=1 << 20, halo=400).collect()}
    got = {r.t: r.y for r in filters.zero_phase(one, K, 100.0, high=5.0, chunk=500, halo=400, width=7000).collect()}
    assert got.keys() == want.keys() and max(abs(got[t] - want[t]) for t in want) < 1e-6
    few = filters.decimated(one, K, 100.0, 25.0, chunk=500, halo=400, width=7000).collect()
    assert sorted(r.t for r in few) == list(range(0, 40_000, 40))


def test_places_and_midpoints(spark):
    rng = random.Random(1)
    keys = rng.sample(range(100_000), 5000)
    df = spark.createDataFrame([(k,) for k in keys + keys[:100]], "id long").repartition(6)
    assert {r.id: r.place for r in selection.places(df, "id").collect()} == {k: i for i, k in enumerate(sorted(keys))}
    b = spark.createDataFrame([("s", i, j, i * 100 + j * 5) for i, n in ((3, 4), (1, 2), (9, 1)) for j in range(n)], "series_id string, interval_id long, bin_idx int, bin_start long")
    assert {r.interval_id: r.midpoint for r in binned.centers(b, 5).collect()} == {1: 0.5, 3: 3.5, 9: 6.0}
    scratch.clear(spark)
