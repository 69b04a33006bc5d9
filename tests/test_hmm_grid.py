"""Long intervals in stretches, and grids of models, folds and shuffles, against plain recursions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import hmm

MODEL = hmm.Model(np.array([0.6, 0.3, 0.1]), np.array([[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.05, 0.25, 0.7]]), np.array([[0.5, 3.0], [4.0, 0.4], [1.5, 1.5]]), ("a", "b"))


def sampled(model, n, seed):
    rng, out, s = np.random.default_rng(seed), [], 0
    for t in range(n):
        s = rng.choice(len(model.start), p=model.start if t == 0 else model.trans[s])
        out.append(rng.poisson(model.rates[s]))
    return np.array(out, float)


@pytest.fixture(scope="module")
def data():
    return {1: sampled(MODEL, 331, 1), 2: sampled(MODEL, 40, 2), 3: sampled(MODEL, 1, 3), 4: sampled(MODEL, 80, 4)}


@pytest.fixture(scope="module")
def wide(spark, data):
    rows = [(i, t, v.tolist()) for i, x in data.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "interval_id long, bin_idx int, x array<double>").repartition(5)


@pytest.mark.parametrize("chunk", [1, 7, 40, 1000])
def test_stretches_equal_whole_intervals(wide, data, chunk):
    got = {r.interval_id: (r.n_bins, r.loglik) for r in hmm.scores(wide, MODEL, chunk).collect()}
    post = {(r.interval_id, r.bin_idx, r.state): r.p for r in hmm.posteriors(wide, MODEL, chunk).collect()}
    path = {(r.interval_id, r.bin_idx): r.state for r in hmm.paths(wide, MODEL, chunk).collect()}
    steps = {(r.interval_id, r.bin_idx): r.total for r in hmm.increments(wide, MODEL, chunk).collect()}
    for i, x in data.items():
        ll, gamma, _ = hmm.recursions(MODEL, x)
        assert got[i][0] == len(x) and abs(got[i][1] - ll) < 1e-8
        assert max(abs(post[i, t, s] - gamma[t, s]) for t in range(len(x)) for s in range(3)) < 1e-9
        assert [path[i, t] for t in range(len(x))] == hmm.viterbi(MODEL, x).tolist()
        assert abs(steps[i, len(x) - 1] - ll) < 1e-8
    a, b = hmm.fit(wide, MODEL, 2, chunk), hmm.fit(wide, MODEL, 2)
    assert all(np.abs(getattr(a, k) - getattr(b, k)).max() < 1e-9 for k in ("start", "trans", "rates"))


def test_expected_transitions_count_all_of_them(data):
    x = data[1]
    whole = hmm.recursions(MODEL, x)[2]
    assert abs(whole.sum() - (len(x) - 1)) < 1e-9
    m, log = hmm.product(MODEL, x, True)
    assert abs(np.log(m.sum()) + log - hmm.recursions(MODEL, x)[0]) < 1e-9


def test_folds_of_one_grid_equal_fits_one_by_one(wide):
    f, models, own = hmm.held_out(wide, ("a", "b"), 3, 2, 2)
    for k in range(2):
        train = wide.where(F.pmod("interval_id", F.lit(2)) != k)
        one = hmm.fit(train, hmm.initial(train, ("a", "b"), 3), 2)
        assert all(np.abs(getattr(models[k], a) - getattr(one, a)).max() < 1e-9 for a in ("start", "trans", "rates"))
        held = {r.interval_id: r.loglik for r in hmm.scores(wide.where(F.pmod("interval_id", F.lit(2)) == k), one).collect()}
        assert all(abs(r.loglik - held[r.interval_id]) < 1e-9 for r in own.collect() if r.interval_id in held)


def nodes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("\n")


@pytest.mark.parametrize("kind", ["time", "transitions", "pooled", "event"])
def test_plans_do_not_grow_with_folds_or_shuffles(wide, kind):
    models = {k: MODEL for k in range(5)}
    sizes = [nodes(hmm.null_scores(hmm._folded(wide, folds), models, kind, n)) for folds, n in ((2, 2), (5, 1000))]
    assert sizes[0] == sizes[1]


def test_null_scores_are_those_of_the_shuffled_bins(wide, data):
    rows = hmm.null_scores(wide.withColumn("fold", F.lit(0)), {0: MODEL}, "cycle", 7, 5, per=3).collect()
    assert sorted((r.interval_id, r.shuffle) for r in rows) == [(i, j) for i in data for j in range(7)]
    for r in rows:
        x = hmm.shuffled(data[r.interval_id], "cycle", hmm._rng(5, r.interval_id, r.shuffle))
        assert abs(r.loglik - hmm.recursions(MODEL, x)[0]) < 1e-9
    pooled = hmm._pooled(wide.withColumn("fold", F.lit(0)), 3, 1).collect()
    every = sorted(tuple(v) for x in data.values() for v in x)
    for j in range(3):
        own = [r for r in pooled if r.shuffle == j]
        assert sorted(tuple(r.x) for r in own) == every and {(r.interval_id, r.bin_idx) for r in own} == {(i, t) for i, x in data.items() for t in range(len(x))}


def test_shuffles_keep_what_they_should():
    x = np.random.default_rng(0).poisson(2, (30, 4)).astype(float)
    rng = hmm._rng(1)
    assert sorted(map(tuple, hmm.shuffled(x, "time", rng))) == sorted(map(tuple, x))
    assert (np.sort(hmm.shuffled(x, "cycle", rng), axis=0) == np.sort(x, axis=0)).all()
    assert (np.sort(hmm.shuffled(x, "series", rng), axis=1) == np.sort(x, axis=1)).all()
    assert (hmm.shuffled(x, "event", rng).sum(axis=1) == x.sum(axis=1)).all()
    assert abs(hmm.shuffled(np.full((4000, 1), 5.0), "poisson", rng).mean() - 5) < 0.2
    with pytest.raises(ValueError, match="no shuffle"):
        hmm.shuffled(x, "other", rng)


def test_events_against_their_shuffles(wide, data):
    own, null = hmm.event_scores(wide, ("a", "b"), 3, 9, "columns", folds=2, rounds=1, seed=2)
    every = null.collect()
    for r in own.collect():
        s = [x.score for x in every if x.interval_id == r.interval_id]
        assert len(s) == 9 and abs(r.percentile - 100 * (sum(v < r.score for v in s) + sum(v == r.score for v in s) / 2) / 9) < 1e-9
    own, _ = hmm.event_scores(wide, ("a", "b"), 3, 2, "time", rounds=2, training=F.col("interval_id") <= 2)
    train = wide.where("interval_id <= 2")
    one = hmm.fit(train, hmm.initial(train, ("a", "b"), 3), 2)
    assert {r.interval_id: round(r.score, 8) for r in own.collect()} == {i: round(hmm.recursions(one, data[i])[0], 8) for i in (3, 4)}
    m = hmm.with_shuffled_columns(MODEL, 1)
    assert np.allclose(m.trans.sum(axis=1), 1) and not np.allclose(m.trans, MODEL.trans)


def test_windows_and_states_of_a_covariate(spark, data):
    b = spark.createDataFrame([("a", 1, t, t) for t in range(5)] + [("a", 2, 0, 7)], "series_id string, interval_id long, bin_idx int, n long")
    assert sorted((r.interval_id, r.bin_idx, r.n) for r in hmm.sliding(b, 3).collect()) == [(1, 0, 3), (1, 1, 6), (1, 2, 9), (2, 0, 7)]
    post = spark.createDataFrame([(1, t, s, p) for t in range(4) for s, p in ((0, 0.25), (1, 0.75))], "interval_id long, bin_idx int, state long, p double")
    ext = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 6), (1, 3, None)], "interval_id long, bin_idx int, x int")
    assert {(r.state, r.x): r.weight for r in hmm.states_of_covariate(post, ext).collect()} == {(0, 5): 0.25, (1, 5): 0.75, (0, 6): 0.25, (1, 6): 0.75}


def test_surrogates(spark):
    m = hmm.Model(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.05, 0.95]]), np.array([[0.5, 5.0], [5.0, 0.5]]), ("a", "b"))
    xs = {i: sampled(m, 60, i) for i in range(12)}
    w = spark.createDataFrame([(i, t, v.tolist()) for i, x in xs.items() for t, v in enumerate(x)], "interval_id long, bin_idx int, x array<double>")
    rows, models = hmm.surrogates(w, ("a", "b"), 2, 4, repeats=2, test_share=0.4)
    got = rows.collect()
    assert set(models) == {(k, r) for k in hmm.SURROGATES for r in range(2)}
    tests = {r.interval_id for r in got if r.part == "test"}
    assert 0 < len(tests) < 12 and len(got) == 12 * 12
    train = {i: x for i, x in xs.items() if i not in tests}
    one = hmm.initial(w.where(~F.col("interval_id").isin(list(tests))), ("a", "b"), 2)
    for _ in range(4):
        one = hmm._maximised(one, sum(hmm._expectations(one, x) for x in train.values()))
    one = hmm.reordered(one, hmm.state_order(one))
    assert np.abs(one.trans - models["actual", 0].trans).max() < 1e-9 and np.abs(one.rates - models["actual", 1].rates).max() < 1e-9
    mean = {k: np.mean([r.loglik for r in got if r.kind == k and r.part == "test"]) for k in hmm.SURROGATES}
    assert abs(mean["actual"] - np.mean([hmm.recursions(one, xs[i])[0] for i in tests])) < 1e-9
    assert mean["actual"] > mean["coherent"] and mean["actual"] > mean["poisson"] and mean["actual"] > mean["spike_id"]
    s = hmm.sparsity(models["actual", 0])
    assert s["departures"][0] > hmm.sparsity(models["coherent", 0])["departures"][0] and s["bottleneck"][0] < 0.2
    assert abs(hmm._gini(np.array([1.0, 1.0, 1.0]))) < 1e-6 and abs(hmm._gini(np.array([0.0, 0.0, 3.0])) - 2 / 3) < 1e-6


def never_there(spark):
    """Chances of two states in three bins, the second without any, and the bins' covariate."""
    post = spark.createDataFrame([(1, t, k, 1.0 - k) for t in range(3) for k in range(2)], "interval_id long, bin_idx int, state long, p double")
    return post, spark.createDataFrame([(1, t, t % 2) for t in range(3)], "interval_id long, bin_idx int, x int")


def test_a_state_without_any_chance_has_no_weights(spark):
    got = {(r.state, r.x): r.weight for r in hmm.covariate_map(*never_there(spark)).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 0.0, (1, 1): 0.0}


def test_decoding_through_a_state_without_any_chance(spark):
    post, ext = never_there(spark)
    got = {(r.bin_idx, r.x): r.p for r in hmm.decoded_covariate(post, hmm.covariate_map(post, ext)).collect()}
    assert got == {(t, x): 0.5 for t in range(3) for x in range(2)}


def test_a_first_bin_of_a_state_that_no_interval_starts_in(spark):
    model = hmm.Model(np.array([1.0, 0.0]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[2000.0], [9000.0]]), ("a",))
    x = np.array([[9000.0], [9000.0], [2000.0]])
    e = hmm._emission(model, x)
    ways = {p: np.log(model.start[p[0]]) + sum(e[t, s] for t, s in enumerate(p)) + sum(np.log(model.trans[a, b]) for a, b in zip(p, p[1:])) for p in [(0, b, c) for b in range(2) for c in range(2)]}
    ll = np.logaddexp.reduce(list(ways.values()))
    got, gamma, pairs = hmm.recursions(model, x)
    assert abs(got - ll) < 1e-8 and np.allclose(gamma, [[1, 0], [0, 1], [1, 0]]) and np.allclose(pairs, [[0, 1], [1, 0]])
    w = spark.createDataFrame([(1, t, v.tolist()) for t, v in enumerate(x)], "interval_id long, bin_idx int, x array<double>")
    for chunk in (None, 1, 2):
        assert abs(hmm.scores(w, model, chunk).first().loglik - ll) < 1e-8
        assert abs(max(r.total for r in hmm.increments(w, model, chunk).where("bin_idx = 2").collect()) - ll) < 1e-8


def test_quality_without_deviation_is_null(spark):
    w = spark.createDataFrame([(i, t, [4.0, 2.0]) for i in range(4) for t in range(3)], "interval_id long, bin_idx int, x array<double>")
    got = hmm.quality(w, ("a", "b"), 2, 2, 1, 3).first()
    assert np.isfinite(got.score) and got.quality is None


def test_decoded_query_on_even_events(spark, tmp_path):
    """168 events of each type in every hour, so that the outer states die out as on six times the events of sf0.1."""
    import __spark_entry__ as entry

    at = "timestamp_seconds(1704067200 + (id div 840) * 3600 + id % 840 * 4)"
    ev = spark.range(3 * 24 * 840).selectExpr("id AS event_id", f"{at} AS ts", "id % 7 AS user_id", "concat('s', id % 5) AS event_type", "1e0 AS value", "'{}' AS props")
    ev.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["hmm_decoded_covariate"](spark, str(tmp_path)).collect()
    assert len(got) == 3 * 8 * 8 and {r.p for r in got} == {0.125}
