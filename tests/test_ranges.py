"""Range joins by levels against all pairs, with lengths from nothing to most of the time line."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import events, intervals, ranges


def some(rng, n, unit=1):
    out = []
    for _ in range(n):
        s = rng.randrange(-50_000, 50_000)
        out.append((s * unit, (s + rng.choice([0, 1, 2, 7, 8, 9, 100, 127, 128, 129, 2048, 40_000]) + rng.choice([0, 0, 1])) * unit))
    return out


@pytest.mark.parametrize(("unit", "kind"), [(1, "long"), (10**12, "long"), (0.001, "double")])
@pytest.mark.parametrize("most", [None, 5])
def test_points(spark, unit, kind, most):
    rng = random.Random(1)
    iv = [(i, *x) for i, x in enumerate(some(rng, 60, unit))]
    pts = [(i, rng.choice([rng.randrange(-60_000, 60_000) * unit, iv[i % 60][1], iv[i % 60][2]])) for i in range(300)] + [(i, 5 * unit) for i in range(300, 340)]
    if kind == "double":
        iv, pts = [(i, float(a), float(b)) for i, a, b in iv], [(i, float(t)) for i, t in pts]
    p = spark.createDataFrame(pts, f"id long, t {kind}")
    v = spark.createDataFrame(iv, f"interval_id long, start {kind}, stop {kind}")
    for closed in (False, True):
        got = sorted((r.id, r.interval_id) for r in events.restrict(p, v, closed_right=closed, most=most).collect())
        assert got == sorted((i, j) for i, t in pts for j, a, b in iv if a <= t and (t <= b if closed else t < b))
    if kind == "long" and unit == 1 and not most:
        got = sorted(r.id for r in events.outside(p, v).collect())
        assert got == sorted(i for i, t in pts if not any(a <= t < b for _, a, b in iv))
        assert events.restrict(p, v.where("false")).collect() == []


def test_overlaps(spark):
    rng = random.Random(2)
    a = [(rng.choice("xyz"), *x) for x in some(rng, 150)]
    b = [(rng.choice("xyz"), *x) for x in some(rng, 150)]
    da, db = (spark.createDataFrame(x, "k string, start long, stop long") for x in (a, b))
    want = sorted((k, max(s, u), min(e, v)) for k, s, e in a for j, u, v in b if j == k and s < v and u < e)
    assert sorted(map(tuple, intervals.intersect(da, db, ["k"]).collect())) == want
    assert sorted(map(tuple, intervals.intersect(da, db, ["k"], bucket=512).collect())) == want
    hull = sorted((k, min(s, u), max(e, v)) for k, s, e in a for j, u, v in b if j == k and s < v and u < e)
    assert sorted(map(tuple, intervals.intersect(da, db, ["k"], boundaries=False).collect())) == hull
    none = sorted(map(tuple, intervals.intersect(da.drop("k"), db.drop("k"), []).collect()))
    assert none == sorted((max(s, u), min(e, v)) for _, s, e in a for _, u, v in b if s < v and u < e)


def test_rows_made_follow_the_overlaps(spark):
    # many short intervals and one that spans them all: no pair of short ones that lie apart is made, and the long one is a few cells
    short = spark.range(20_000).select((F.col("id") * 1000).alias("start"), (F.col("id") * 1000 + 300).alias("stop"))
    long = spark.createDataFrame([(0, 20_000_000)], "start long, stop long")
    both = short.union(long)
    at = ranges.level(F.col("start"), F.col("stop"))
    cells = both.withColumn("_l", at).select(ranges._cells(F.col("start"), F.col("stop"), F.col("_l")))
    assert cells.count() < 3 * 20_001
    df = intervals.intersect(both, short, [])
    assert df.count() == 40_000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    joined = ranges.overlapping(short, short, [])
    assert joined.count() == 20_000
