"""Shuffles, hidden states and tracks; every query with SQL against DuckDB."""

import itertools
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanforge.operators import hmm as H
from spanforge.operators import replay as P
from spanforge.plans import sequences

SF = "/root/testdata/sf0.01"
NAMES = ["thr_run_epochs", "pbe", "win_stack", "win_scaler", "rp_consecutive_bins", "rp_cycle_shuffle", "rp_cycle_significance", "geo_linearize"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(x[0] for x in want.description)
    a = sorted(map(tuple, got.select(*cols).collect()), key=str)
    at = [[x[0] for x in want.description].index(c) for c in cols]
    b = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    assert len(a) and a == b


def _model():
    return H.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[1.0, 0.5], [3.0, 2.0]]), ("a", "b"))


def _all_paths(m, x):
    for p in itertools.product(range(2), repeat=len(x)):
        w = math.log(m.start[p[0]]) + sum(math.log(m.trans[i, j]) for i, j in zip(p, p[1:]))
        yield w + sum(v * math.log(m.rates[k, i]) - m.rates[k, i] - math.lgamma(v + 1) for k, row in zip(p, x) for i, v in enumerate(row)), p


def test_recursions_equal_the_sum_over_all_paths():
    m, x = _model(), np.array([[0, 1], [3, 2], [4, 0], [1, 1], [0, 0]], float)
    every = list(_all_paths(m, x))
    score, gamma, pairs = H.recursions(m, x)
    total = sum(math.exp(w) for w, _ in every)
    assert score == pytest.approx(math.log(total))
    assert gamma[2, 1] == pytest.approx(sum(math.exp(w) for w, p in every if p[2] == 1) / total)
    assert pairs[0, 1] == pytest.approx(sum(math.exp(w) * sum(a == (0, 1) for a in zip(p, p[1:])) for w, p in every) / total)
    assert tuple(H.viterbi(m, x)) == max(every)[1]


def test_fit_raises_the_likelihood(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{u}", i, t, int(rng.poisson(4 if (t // 5 + u) % 2 else 1))) for i in range(6) for t in range(30) for u in range(2)]
    b = spark.createDataFrame(rows, "series_id string, interval_id long, bin_idx int, n long")
    w = H.wide(b, H.series_of(b))
    first = H.initial(w, H.series_of(b), 2)
    total = [H.scores(w, m).agg(F.sum("loglik")).first()[0] for m in (first, H.fit(w, first, 2))]
    assert total[1] > total[0] and H.paths(w, first).count() == 180
    with pytest.raises(ValueError):
        H.series_of(b, most=1)


def test_track(spark):
    got = P.linearized(spark.createDataFrame([(1.0, 1.0), (2.0, 1.5), (-1.0, 0.0)], "x double, y double"), [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]).collect()
    assert [(r.segment, r.lin, r.off) for r in got] == [(0, 1.0, 1.0), (1, 3.5, 0.0), (0, 0.0, 1.0)]


def test_random_shift_is_the_same_each_time(spark):
    df = spark.range(50).select("id", P.random_shift(7, "id").alias("s"))
    assert sorted(df.collect()) == sorted(df.repartition(5).collect()) and sequences is not None
