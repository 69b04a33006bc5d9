"""Hidden Markov models with Poisson counts: the recursions run on each interval's bins, Spark
adds what they expect, and the driver holds only numbers of the model's own size."""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # (states)
    trans: np.ndarray  # (states, states)
    rates: np.ndarray  # (states, series)
    series: tuple[str, ...]


def series_of(b: DataFrame, most: int = 10_000) -> tuple[str, ...]:
    """The names of the series, which give the model its size; more than ``most`` are refused."""
    found = b.select("series_id").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a model holds a rate for each state and series; there are more than {most} series")
    return tuple(sorted(r[0] for r in found))


def wide(b: DataFrame, series: tuple[str, ...]) -> DataFrame:
    """(interval_id, bin_idx, x): the counts of all series in one array, in the order given."""
    by = F.map_from_entries(F.collect_list(F.struct("series_id", "n")))
    x = F.array(*[F.coalesce(F.col("m")[s], F.lit(0)).cast("double") for s in series])
    return b.groupBy("interval_id", "bin_idx").agg(by.alias("m")).select("interval_id", "bin_idx", x.alias("x"))


def _log_factorials(x: np.ndarray) -> np.ndarray:
    values, at = np.unique(x, return_inverse=True)
    return np.array([lgamma(v + 1) for v in values])[at].reshape(x.shape)


def _emission(model: Model, x: np.ndarray) -> np.ndarray:
    constant = _log_factorials(x).sum(axis=1, keepdims=True) if len(x) else 0.0
    return x @ np.log(model.rates).T - model.rates.sum(axis=1) - constant


def _first(model: Model, e: np.ndarray) -> tuple[np.ndarray, float]:
    """(chances at an interval's first bin, log of what was divided out), from its emissions' logs; of the states that
    an interval may start in even the likeliest may be far less likely there than one it may not."""
    with np.errstate(divide="ignore"):
        a = np.log(model.start) + e
    return np.exp(a - a.max()), float(a.max())


def recursions(model: Model, x: np.ndarray, entering: np.ndarray | None = None, leaving: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood, state chances at each bin, expected transitions) by scaled passes.

    Of a stretch of an interval: ``entering`` are the chances of the states at the bin before it given all
    bins up to there, ``leaving`` is in proportion to the chance of all bins after it for each
    state at its last one; the likelihood is then that of the stretch given what came before.
    """
    e = _emission(model, x)
    top = e.max(axis=1, keepdims=True)
    n, k, e0, e = len(x), len(model.start), e[0], np.exp(e - top)
    if entering is None:
        first, top[0] = _first(model, e0)
    alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    for t in range(n):
        a = first if t == 0 and entering is None else (entering if t == 0 else alpha[t - 1]) @ model.trans * e[t]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    if leaving is not None:
        beta[n - 1] = leaving
    for t in range(n - 2, -1, -1):
        beta[t] = model.trans @ (e[t + 1] * beta[t + 1]) / scale[t + 1]
    before, on = alpha[:-1], e[1:] * beta[1:] / scale[1:, None]
    if entering is not None:
        before, on = np.vstack((entering, before)), np.vstack((e[0] * beta[0] / scale[0], on))
    total = float(alpha[-1] @ beta[-1])
    return float(np.log(scale).sum() + top.sum()), alpha * beta / total, model.trans * (before.T @ on) / total


def viterbi(model: Model, x: np.ndarray, entering: int | None = None, leaving: int | None = None) -> np.ndarray:
    """The likeliest sequence of states; of equal ones the least state.  Of a stretch of an interval:
    ``entering`` is the state before it, ``leaving`` that of its last bin."""
    with np.errstate(divide="ignore"):
        e, lt, best = _emission(model, x), np.log(model.trans), np.log(model.start)
    best, back = (best if entering is None else lt[entering]) + e[0], np.zeros(e.shape, np.int64)
    for t in range(1, len(x)):
        through = best[:, None] + lt
        back[t] = through.argmax(axis=0)
        best = through.max(axis=0) + e[t]
    out = np.empty(len(x), np.int64)
    out[-1] = best.argmax() if leaving is None else leaving
    for t in range(len(x) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def product(model: Model, x: np.ndarray, first: bool) -> tuple[np.ndarray, float]:
    """(m, log of what was divided out): what a stretch of bins does to the chances of the states before it.

    Products of such matrices are those of longer stretches, in any grouping; the first stretch of
    an interval has one row, for there is no state before it.
    """
    e = _emission(model, x)
    top = e.max(axis=1)
    e0, e = e[0], np.exp(e - top[:, None])
    if first:
        start, top[0] = _first(model, e0)
    m, log = start[None] if first else model.trans * e[0], top.sum()
    for t in range(len(x)):
        m = m if t == 0 else (m @ model.trans) * e[t]
        s = m.sum()
        m, log = m / s, log + np.log(s)
    return m, float(log)


def best_product(model: Model, x: np.ndarray, first: bool) -> np.ndarray:
    """The same for the likeliest sequence: log likelihoods from each state before a stretch to each at its end."""
    with np.errstate(divide="ignore"):
        e, lt, start = _emission(model, x), np.log(model.trans), np.log(model.start)
    m = (start + e[0])[None] if first else lt + e[0]
    for t in range(1, len(x)):
        m = (m[:, :, None] + lt).max(axis=1) + e[t]
    return m


def _counts(g: pd.DataFrame) -> np.ndarray:
    return np.stack(g.sort_values("bin_idx")["x"].to_numpy())


_CARRY = "interval_id long, _c long, entering array<double>, leaving array<double>, before double, n long"


def _carried(k: int):
    """Products of an interval's stretches in order -> what enters and leaves each of them."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_c")
        ms = [np.asarray(m).reshape(-1, k) for m in g["m"]]
        alpha, log, beta = [ms[0][0] / ms[0].sum()], [g["log"].iloc[0] + np.log(ms[0].sum())], [np.ones(k)]
        for m, own in zip(ms[1:], g["log"].iloc[1:], strict=True):
            a = alpha[-1] @ m
            alpha.append(a / a.sum())
            log.append(log[-1] + own + np.log(a.sum()))
        for m in ms[:0:-1]:
            b = m @ beta[-1]
            beta.append(b / b.sum())
        return pd.DataFrame({"interval_id": g["interval_id"], "_c": g["_c"], "entering": [None, *alpha[:-1]], "leaving": beta[::-1], "before": [0.0, *log[:-1]], "n": len(g)})

    return run


def _along(w: DataFrame, model: Model, chunk: int | None, change, schema: str) -> DataFrame:
    """change(bins in order, counts, entering, leaving, log likelihood before) of each interval, or of each stretch of
    ``chunk`` bins.

    Stretches are worked on twice: once for their products, and once with what the products of the
    others carry to them; in between an interval is as many rows as it has stretches.
    """
    if chunk is None:
        def whole(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("bin_idx")
            return change(g, np.stack(g["x"].to_numpy()), None, None, 0.0)

        return w.groupBy("interval_id").applyInPandas(whole, schema)
    k = len(model.start)
    c = w.withColumn("_c", F.floor(F.col("bin_idx") / chunk))

    def reduce(g: pd.DataFrame) -> pd.DataFrame:
        m, log = product(model, _counts(g), int(g["bin_idx"].min()) == 0)
        return pd.DataFrame({"interval_id": g["interval_id"].iloc[:1], "_c": g["_c"].iloc[:1], "m": [m.ravel()], "log": [log]})

    def part(g: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bin_idx")
        r = carry.iloc[0]
        entering = None if r["entering"] is None else np.asarray(r["entering"])
        return change(g, np.stack(g["x"].to_numpy()), entering, np.asarray(r["leaving"]), float(r["before"]))

    made = c.groupBy("interval_id", "_c").applyInPandas(reduce, "interval_id long, _c long, m array<double>, log double")
    carry = made.groupBy("interval_id").applyInPandas(_carried(k), _CARRY)
    return c.groupBy("interval_id", "_c").cogroup(carry.groupBy("interval_id", "_c")).applyInPandas(part, schema)


def scores(w: DataFrame, model: Model, chunk: int | None = None) -> DataFrame:
    """(interval_id, n_bins, loglik) of each interval of wide bins (bin_idx from 0); ``chunk``: see ``_along``."""
    def score(g, x, entering, leaving, before) -> pd.DataFrame:
        return pd.DataFrame({"interval_id": [g.interval_id.iloc[0]], "n_bins": [len(g)], "loglik": [recursions(model, x, entering, leaving)[0]]})

    out = _along(w, model, chunk, score, "interval_id long, n_bins long, loglik double")
    return out if chunk is None else out.groupBy("interval_id").agg(F.sum("n_bins").alias("n_bins"), F.sum("loglik").alias("loglik"))


def paths(w: DataFrame, model: Model, chunk: int | None = None) -> DataFrame:
    """(interval_id, bin_idx, state) of the likeliest sequences.

    With ``chunk``, the states at the ends of stretches come from the stretches' best products; of several
    sequences that are equally likely, another may be taken then.
    """
    schema = "interval_id long, bin_idx int, state long"

    def path(g: pd.DataFrame, ends: pd.DataFrame | None = None) -> pd.DataFrame:
        g = g.sort_values("bin_idx")
        entering, leaving = (None, None) if ends is None else (int(v) if v >= 0 else None for v in ends[["entering", "leaving"]].iloc[0])
        return pd.DataFrame({"interval_id": g.interval_id, "bin_idx": g.bin_idx, "state": viterbi(model, _counts(g), entering, leaving)})

    if chunk is None:
        return w.groupBy("interval_id").applyInPandas(lambda g: path(g), schema)
    k = len(model.start)

    def reduce(g: pd.DataFrame) -> pd.DataFrame:
        m = best_product(model, _counts(g), int(g["bin_idx"].min()) == 0)
        return pd.DataFrame({"interval_id": g["interval_id"].iloc[:1], "_c": g["_c"].iloc[:1], "m": [m.ravel()]})

    def ends(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_c")
        ms = [np.asarray(m).reshape(-1, k) for m in g["m"]]
        best, back = ms[0][0], []
        for m in ms[1:]:
            back.append((best[:, None] + m).argmax(axis=0))
            best = (best[:, None] + m).max(axis=0)
        last = [int(best.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last.reverse()
        return pd.DataFrame({"interval_id": g["interval_id"], "_c": g["_c"], "entering": [-1, *last[:-1]], "leaving": last})

    c = w.withColumn("_c", F.floor(F.col("bin_idx") / chunk))
    made = c.groupBy("interval_id", "_c").applyInPandas(reduce, "interval_id long, _c long, m array<double>")
    at = made.groupBy("interval_id").applyInPandas(ends, "interval_id long, _c long, entering long, leaving long")
    return c.groupBy("interval_id", "_c").cogroup(at.groupBy("interval_id", "_c")).applyInPandas(path, schema)


def initial(w: DataFrame, series: tuple[str, ...], states: int) -> Model:
    """Rates spread evenly around the series' means, from 0.5 to 1.5 of it; sticky transitions."""
    return _spread(np.array(w.select(*[F.avg(F.col("x")[i]) for i in range(len(series))]).first(), float), series, states)


def _spread(mean: np.ndarray, series: tuple[str, ...], states: int) -> Model:
    level = np.linspace(0.5, 1.5, states) if states > 1 else np.ones(1)
    trans = np.full((states, states), 0.2 / max(states - 1, 1))
    np.fill_diagonal(trans, 0.8 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), trans, np.maximum(level[:, None] * mean, 1e-3), series)


def _expectations(model: Model, x: np.ndarray, entering=None, leaving=None) -> np.ndarray:
    _, gamma, pairs = recursions(model, x, entering, leaving)
    start = gamma[0] if entering is None else np.zeros(len(model.start))
    return np.concatenate((start, pairs.ravel(), gamma.sum(axis=0), (gamma.T @ x).ravel()))


def _maximised(model: Model, total: np.ndarray) -> Model:
    k, s = len(model.start), len(model.series)
    start, pairs, weight, counts = np.split(total, [k, k + k * k, 2 * k + k * k])
    pairs = pairs.reshape(k, k) + 1e-9
    return Model(start / start.sum(), pairs / pairs.sum(axis=1, keepdims=True), np.maximum(counts.reshape(k, s) / np.maximum(weight, 1e-9)[:, None], 1e-3), model.series)


def fit(w: DataFrame, model: Model, rounds: int, chunk: int | None = None) -> Model:
    """Expectation maximisation; each round is one pass, added up by Spark to a row for each number of the model.
    ``chunk``: see ``_along``."""
    for _ in range(rounds):
        def expect(g, x, entering, leaving, before, model=model) -> pd.DataFrame:
            values = _expectations(model, x, entering, leaving)
            return pd.DataFrame({"at": np.arange(len(values)), "v": values})

        added = _along(w, model, chunk, expect, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        if not added:
            return model
        total = np.zeros(len(added))
        for r in added:
            total[r["at"]] = r["v"]
        model = _maximised(model, total)
    return model


# --- covariates, order of states, samples and quality -----------------------------------------

def posteriors(w: DataFrame, model: Model, chunk: int | None = None) -> DataFrame:
    """(interval_id, bin_idx, state, p): chances of the states given the whole interval; ``chunk``: see ``_along``."""
    k = len(model.start)

    def each(g, x, entering, leaving, before) -> pd.DataFrame:
        gamma = recursions(model, x, entering, leaving)[1]
        return pd.DataFrame({"interval_id": np.repeat(g.interval_id.to_numpy(), k), "bin_idx": np.repeat(g.bin_idx.to_numpy(), k), "state": np.tile(np.arange(k), len(g)), "p": gamma.ravel()})

    return _along(w, model, chunk, each, "interval_id long, bin_idx int, state long, p double")


def increments(w: DataFrame, model: Model, chunk: int | None = None) -> DataFrame:
    """(interval_id, bin_idx, loglik, total): each bin's log likelihood given those before, and the sum so far."""
    def each(g, x, entering, leaving, before) -> pd.DataFrame:
        e = _emission(model, x)
        top, a, out = e.max(axis=1), entering, []
        if entering is None:
            first, top[0] = _first(model, e[0])
        for t in range(len(g)):
            a = first if a is None else a @ model.trans * np.exp(e[t] - top[t])
            out.append(float(np.log(a.sum()) + top[t]))
            a = a / a.sum()
        return pd.DataFrame({"interval_id": g.interval_id, "bin_idx": g.bin_idx, "loglik": out, "total": before + np.cumsum(out)})

    return _along(w, model, chunk, each, "interval_id long, bin_idx int, loglik double, total double")


def sliding(b: DataFrame, width: int) -> DataFrame:
    """Bins (series_id, interval_id, bin_idx, n) of sums over ``width`` neighbours, one for each first bin with a whole
    window; a shorter interval has one window of all its bins."""
    from .decode import windowed

    rows = b.select("series_id", "interval_id", F.col("bin_idx").alias("t_bin"), "n")
    return windowed(rows, "interval_id", width, partial=True).select("series_id", "interval_id", F.col("t_bin").cast("int").alias("bin_idx"), "n")


def memoryless(b: DataFrame, model: Model) -> DataFrame:
    """(t_bin, state, p): states by the rates alone, every bin by itself; b: (series_id, t_bin, n)."""
    from .decode import posterior

    rates = [(s, i, float(model.rates[i, j])) for j, s in enumerate(model.series) for i in range(len(model.start))]
    table = b.sparkSession.createDataFrame(rates, "series_id string, state int, rate double")  # of the model's size
    return posterior(b, table, "state")


def covariate_map(post: DataFrame, ext: DataFrame, normalize: bool = True, by_occupancy: bool = True) -> DataFrame:
    """(state, x, weight): the states' chances summed by a covariate's value (interval_id, bin_idx, x),
    over the time spent there, and so that each state's weights add up to 1 (0 where there is no chance)."""
    m = post.join(ext, ["interval_id", "bin_idx"])
    g = m.groupBy("state", "x").agg(F.sum("p").alias("weight"))
    if by_occupancy:
        g = g.join(ext.groupBy("x").agg(F.count("*").alias("_o")), "x").withColumn("weight", F.col("weight") / F.col("_o")).drop("_o")
    if normalize:
        total = g.groupBy("state").agg(F.sum("weight").alias("_t"))
        g = g.join(total, "state").withColumn("weight", F.col("weight") / F.when(F.col("_t") > 1e-8, F.col("_t")).otherwise(1.0)).drop("_t")
    return g.select("state", "x", "weight")


def states_of_covariate(post: DataFrame, ext: DataFrame) -> DataFrame:
    """(state, x, weight): the states' chances summed by a covariate's value (interval_id, bin_idx, x), so that the
    weights of each value add up to 1 (0 where there is no chance); bins without a value are left out."""
    g = post.join(ext.where("x is not null"), ["interval_id", "bin_idx"]).groupBy("state", "x").agg(F.sum("p").alias("_w"))
    total = g.groupBy("x").agg(F.sum("_w").alias("_t"))
    return g.join(total, "x").select("state", "x", (F.col("_w") / F.when(F.col("_t") > 1e-8, F.col("_t")).otherwise(1.0)).alias("weight"))


def decoded_covariate(post: DataFrame, weights: DataFrame) -> DataFrame:
    """(interval_id, bin_idx, x, p): the covariate's chances through the states'."""
    return post.join(weights, "state").groupBy("interval_id", "bin_idx", "x").agg(F.sum(F.col("p") * F.col("weight")).alias("p"))


def state_order(model: Model, start: int = 0) -> list[int]:
    """States from ``start`` on, each followed by the likeliest of those that are left."""
    left, out = set(range(len(model.start))) - {start}, [start]
    while left:
        out.append(max(left, key=lambda j: (model.trans[out[-1], j], -j)))
        left.remove(out[-1])
    return out


def reordered(model: Model, states: list[int] | None = None, series: list[str] | None = None) -> Model:
    """The same model with its states or series in another order."""
    i = list(range(len(model.start))) if states is None else states
    j = list(range(len(model.series))) if series is None else [model.series.index(s) for s in series]
    return Model(model.start[i], model.trans[np.ix_(i, i)], model.rates[np.ix_(i, j)], tuple(model.series[x] for x in j))


def sampled(spark, model: Model, intervals: DataFrame, seed: int) -> DataFrame:
    """(interval_id, bin_idx, state, x) drawn from the model for each interval (interval_id, n_bins)."""
    def draw(g: pd.DataFrame) -> pd.DataFrame:
        i, n = int(g.interval_id.iloc[0]), int(g.n_bins.iloc[0])
        rng = np.random.default_rng([seed, i % 2**32])
        path, k = [], len(model.start)
        for t in range(n):
            path.append(int(rng.choice(k, p=model.start if t == 0 else model.trans[path[-1]])))
        x = rng.poisson(model.rates[path]).astype(float)
        return pd.DataFrame({"interval_id": i, "bin_idx": np.arange(n, dtype=np.int32), "state": path, "x": list(x)})

    return intervals.groupBy("interval_id").applyInPandas(draw, "interval_id long, bin_idx int, state long, x array<double>")


def swapped_in_time(w: DataFrame, seed: int, pooled: bool = False) -> DataFrame:
    """Wide bins in random order within each interval, or over all of them."""
    from .shuffles import time_swapped

    return time_swapped(w.withColumnRenamed("x", "n").withColumn("series_id", F.lit("all")), seed, pooled).select("interval_id", "bin_idx", F.col("n").alias("x"))


def with_shuffled_transitions(model: Model, seed: int | list[int]) -> Model:
    """Each row's chances off the diagonal in random order."""
    rng, trans = np.random.default_rng(seed), model.trans.copy()
    for i in range(len(trans)):
        off = np.delete(np.arange(len(trans)), i)
        trans[i, off] = rng.permutation(trans[i, off])
    return Model(model.start, trans, model.rates, model.series)


# --- folds, shuffles and surrogates as columns of one plan --------------------------------------

def shuffled(x: np.ndarray, kind: str, rng: np.random.Generator, means: np.ndarray | None = None) -> np.ndarray:
    """The bins of an interval: in another order (``time``), each series turned by itself (``cycle``), series exchanged
    (``series``), counts drawn with the series' means (``poisson``; those given, or the interval's own), or each event given
    to any series (``event``)."""
    if kind == "time":
        return x[rng.permutation(len(x))]
    if kind == "cycle":
        return np.stack([np.roll(c, rng.integers(len(x))) for c in x.T], axis=1)
    if kind == "series":
        return x[:, rng.permutation(x.shape[1])]
    if kind == "poisson":
        return rng.poisson(np.broadcast_to(x.mean(axis=0) if means is None else means, x.shape)).astype(float)
    if kind == "event":
        return rng.multinomial(x.sum(axis=1).astype(int), np.full(x.shape[1], 1 / x.shape[1])).astype(float)
    if kind == "actual":
        return x
    raise ValueError(f"no shuffle is called {kind}")


def _rng(*seed: int) -> np.random.Generator:
    return np.random.default_rng([int(s) % 2**32 for s in seed])


def fit_grid(w: DataFrame, models: dict[int, Model], rounds: int, change=None) -> dict[int, Model]:
    """All models at once: rows of w (interval_id, bin_idx, x, uses) train those models whose numbers are in ``uses``.

    A round is one pass however many models there are; the driver gets one row for each of their numbers.
    ``change(x, interval, model's number)`` may replace the counts that a model sees.
    """
    for _ in range(rounds):
        added = w.groupBy("interval_id").applyInPandas(_grid_expectation(models, change), "model long, at int, v double").groupBy("model", "at").agg(F.sum("v").alias("v")).collect()
        totals = {m: np.zeros(sum(r["model"] == m for r in added)) for m in {r["model"] for r in added}}
        for r in added:
            totals[r["model"]][r["at"]] = r["v"]
        models = {m: _maximised(model, totals[m]) if m in totals else model for m, model in models.items()}
    return models


def _grid_expectation(models: dict[int, Model], change):
    def expect(g: pd.DataFrame) -> pd.DataFrame:
        x, out = _counts(g), []
        for m in g["uses"].iloc[0]:
            own = x if change is None else change(x, int(g["interval_id"].iloc[0]), int(m))
            values = _expectations(models[int(m)], own)
            out.append(pd.DataFrame({"model": int(m), "at": np.arange(len(values)), "v": values}))
        return pd.concat(out) if out else pd.DataFrame({"model": [], "at": [], "v": []})

    return expect


def initial_grid(w: DataFrame, series: tuple[str, ...], states: int, models: list[int]) -> dict[int, Model]:
    """``initial`` of the bins that each model is trained on, from one aggregation by ``uses``."""
    sums = w.groupBy("uses").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(len(series))]).collect()
    out = {}
    for m in models:
        own = [r for r in sums if m in r["uses"]]
        n = max(sum(r["n"] for r in own), 1)
        out[m] = _spread(np.array([sum(r[f"s{i}"] for r in own) / n for i in range(len(series))]), series, states)
    return out


def _dealt(w: DataFrame, n: int, per: int) -> DataFrame:
    """w once for every ``per`` of n shuffles, with the column _part."""
    return w.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // per)))) if n else w.where("false").withColumn("_part", F.lit(0))


def null_scores(w: DataFrame, models: dict[int, Model], kind: str, n: int, seed: int = 0, per: int = 50) -> DataFrame:
    """(interval_id, shuffle, n_bins, loglik): each interval of w (interval_id, bin_idx, x, fold) under the model of its fold,
    for n shuffles of its bins, or of the model's transitions.

    ``kind``: one of ``shuffled``, ``transitions`` (in each row), ``columns`` (in each column), or ``pooled``, which deals bins over all intervals of a fold.  One plan,
    whose size depends on neither; a task takes an interval and up to ``per`` of its shuffles, and what
    is drawn follows from seed, interval and shuffle alone.
    """
    schema = "interval_id long, shuffle long, n_bins long, loglik double"
    if kind == "pooled":
        def score_one(g: pd.DataFrame) -> pd.DataFrame:
            value = recursions(models[int(g["fold"].iloc[0])], _counts(g))[0]
            return pd.DataFrame({"interval_id": g["interval_id"].iloc[:1], "shuffle": g["shuffle"].iloc[:1], "n_bins": [len(g)], "loglik": [value]})

        return _pooled(w, n, seed).groupBy("interval_id", "shuffle").applyInPandas(score_one, schema)

    def score(g: pd.DataFrame) -> pd.DataFrame:
        x, i, fold, part = _counts(g), int(g["interval_id"].iloc[0]), int(g["fold"].iloc[0]), int(g["_part"].iloc[0])
        rows = []
        for j in range(part * per, min((part + 1) * per, n)):
            if kind in ("transitions", "columns"):
                change = with_shuffled_transitions if kind == "transitions" else with_shuffled_columns
                value = recursions(change(models[fold], [seed % 2**32, fold, j]), x)[0]
            else:
                value = recursions(models[fold], shuffled(x, kind, _rng(seed, i, j)))[0]
            rows.append((i, j, len(x), value))
        return pd.DataFrame(rows, columns=["interval_id", "shuffle", "n_bins", "loglik"])

    return _dealt(w, n, per).groupBy("interval_id", "_part").applyInPandas(score, schema)


def _pooled(w: DataFrame, n: int, seed: int) -> DataFrame:
    """(interval_id, bin_idx, fold, shuffle, x): in each shuffle the bins of a fold in another order over its intervals.

    Places are numbered in pieces (see ``scans``); the counts are joined to their new places last.
    """
    from . import scans
    from .shuffles import drawn

    keys = ["fold", "shuffle"]
    bins = w.select("interval_id", "bin_idx", "fold").withColumn("shuffle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) if n else w.select("interval_id", "bin_idx", "fold", F.lit(0).cast("long").alias("shuffle")).where("false")
    old = bins.withColumn("_o", F.struct("interval_id", "bin_idx"))
    new = old.withColumn("_o", F.struct(drawn(F.col("shuffle") + seed, "interval_id", "bin_idx").alias("d"), "interval_id", "bin_idx"))
    a = scans.numbered(scans.pieces(old, keys, "_o"), keys, "_o", "_k").select(*keys, "_k", "interval_id", "bin_idx")
    b = scans.numbered(scans.pieces(new, keys, "_o"), keys, "_o", "_k").select(*keys, "_k", F.col("interval_id").alias("_i"), F.col("bin_idx").alias("_b"))
    x = w.select(F.col("interval_id").alias("_i"), F.col("bin_idx").alias("_b"), "x")
    return a.join(b, [*keys, "_k"]).join(x, ["_i", "_b"]).select("interval_id", "bin_idx", "fold", "shuffle", "x")


def _folded(w: DataFrame, folds: int) -> DataFrame:
    """w with its fold and the models that it trains: those of all other folds."""
    fold = F.pmod(F.col("interval_id"), F.lit(folds)).cast("int")
    return w.withColumn("fold", fold).withColumn("uses", F.array_except(F.array(*map(F.lit, range(folds))), F.array(fold)))


def held_out(w: DataFrame, series: tuple[str, ...], states: int, folds: int, rounds: int) -> tuple[DataFrame, dict[int, Model], DataFrame]:
    """(w with folds, the model of each fold trained on all others, scores of the held-out intervals)."""
    f = _folded(w, folds)
    models = fit_grid(f, initial_grid(f, series, states, list(range(folds))), rounds)

    def score(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"interval_id": g["interval_id"].iloc[:1], "n_bins": [len(g)], "loglik": [recursions(models[int(g["fold"].iloc[0])], _counts(g))[0]]})

    return f, models, f.groupBy("interval_id").applyInPandas(score, "interval_id long, n_bins long, loglik double")


def with_shuffled_columns(model: Model, seed: int | list[int]) -> Model:
    """The chances of coming to each state off the diagonal in random order; rows then add up to 1 again."""
    turned = with_shuffled_transitions(Model(model.start, model.trans.T, model.rates, model.series), seed).trans.T
    return Model(model.start, turned / turned.sum(axis=1, keepdims=True), model.rates, model.series)


def event_scores(w: DataFrame, series: tuple[str, ...], states: int, shuffles: int, kind: str = "transitions", folds: int = 5, rounds: int = 5, seed: int = 0,
                 training: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((interval_id, score, percentile), (interval_id, shuffle, score)): held-out log likelihoods and those of their shuffles.

    ``kind``: see ``null_scores``.  With ``training``, a condition on interval_id, there is one model of the
    intervals that meet it, and the others are scored.  The percentile counts half of equal shuffles.
    """
    if training is None:
        f, models, own = held_out(w, series, states, folds, rounds)
    else:
        f = w.withColumn("fold", F.lit(0)).withColumn("_train", training).withColumn("uses", F.when(F.col("_train"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
        models = fit_grid(f, initial_grid(f, series, states, [0]), rounds)
        f = f.where("not _train").drop("_train")
        own = scores(f, models[0])
    null = null_scores(f, models, kind, shuffles, seed).select("interval_id", "shuffle", F.col("loglik").alias("score"))
    n = null.select("interval_id", F.col("score").alias("_s"))
    g = own.select("interval_id", F.col("loglik").alias("score")).join(n, "interval_id", "left").groupBy("interval_id", "score")
    below, same = F.count_if(F.col("_s") < F.col("score")), F.count_if(F.col("_s") == F.col("score"))
    return g.agg((100 * (below + same / 2) / F.count("_s")).alias("percentile")), null


def cross_scores(w: DataFrame, series: tuple[str, ...], states: int, folds: int, rounds: int, shuffles: int, seed: int = 0, kind: str = "transitions") -> DataFrame:
    """(interval_id, score, p, z): each interval's log likelihood under the model of the other folds against the
    same with shuffled transitions (``transitions``), or with its bins shuffled (``time``, ``pooled`` and others)."""
    from .shuffles import against_null

    f, models, own = held_out(w, series, states, folds, rounds)
    null = null_scores(f, models, kind, shuffles, seed).select("interval_id", F.col("loglik").alias("score"))
    return against_null(own.select("interval_id", F.col("loglik").alias("score")), null, ["interval_id"])


def quality(w: DataFrame, series: tuple[str, ...], states: int, folds: int, rounds: int, shuffles: int, seed: int = 0, kind: str = "pooled") -> DataFrame:
    """One row: the mean held-out score and its distance from the shuffles' mean scores, in their deviations
    (null where the shuffles don't differ)."""
    f, models, own = held_out(w, series, states, folds, rounds)
    mean = null_scores(f, models, kind, shuffles, seed).groupBy("shuffle").agg(F.avg("loglik").alias("m"))
    g = own.agg(F.avg("loglik").alias("score")).crossJoin(mean.agg(F.avg("m").alias("_a"), F.stddev_pop("m").alias("_d")))  # one row each
    return g.select("score", ((F.col("score") - F.col("_a")) / F.when(F.col("_d") > 0, F.col("_d"))).alias("quality"))


def shuffled_scores(b: DataFrame, model: Model, kind: str, n: int, seed: int = 0, normalize: bool = False) -> DataFrame:
    """(interval_id, score, p, z): each interval's log likelihood (a bin, if ``normalize``) against n shuffles of
    the bins (series_id, interval_id, bin_idx, n): ``time`` and ``pooled`` move whole bins, ``cycle`` turns each
    series by itself, ``series`` exchanges names, ``poisson`` draws counts anew, ``transitions`` shuffles the model."""
    from .shuffles import against_null

    w = wide(b, model.series).withColumn("fold", F.lit(0))
    value = (F.col("loglik") / F.col("n_bins") if normalize else F.col("loglik")).alias("score")
    null = null_scores(w, {0: model}, kind, n, seed).select("interval_id", value)
    return against_null(scores(w.drop("fold"), model).select("interval_id", value), null, ["interval_id"])


#: The surrogates of a model: what is done to the intervals that it is trained on.
SURROGATES = {"actual": "actual", "coherent": "time", "incoherent": "cycle", "poisson": "poisson", "unit_id": "series", "spike_id": "event"}


def surrogates(w: DataFrame, series: tuple[str, ...], states: int, rounds: int, kinds: tuple[str, ...] = tuple(SURROGATES), repeats: int = 1,
               test_share: float = 0.2, seed: int = 0) -> tuple[DataFrame, dict[tuple[str, int], Model]]:
    """((kind, repeat, part, interval_id, loglik), models): models trained on shuffled training intervals, all in one grid,
    and the log likelihood of each training interval (as it was shuffled) and each test interval (as it is).

    An interval is held for testing with the chance ``test_share``, by the md5 of seed and id.  The Poisson
    surrogate's means are those of all training intervals; states are put in order by their transitions.
    """
    from .shuffles import uniform

    names = [(k, r) for k in kinds for r in range(repeats)]
    test = uniform(seed, "interval_id") < test_share
    f = w.withColumn("test", test).withColumn("uses", F.when(test, F.array().cast("array<int>")).otherwise(F.array(*map(F.lit, range(len(names))))))
    start = initial_grid(f, series, states, list(range(len(names))))
    means = start[0].rates.mean(axis=0)

    def change(x: np.ndarray, interval: int, m: int) -> np.ndarray:
        kind, repeat = names[m]
        return shuffled(x, SURROGATES[kind], _rng(seed, interval, m, repeat), means)

    models = {m: reordered(model, state_order(model)) for m, model in fit_grid(f, start, rounds, change).items()}

    def score(g: pd.DataFrame) -> pd.DataFrame:
        x, i, held = _counts(g), int(g["interval_id"].iloc[0]), bool(g["test"].iloc[0])
        rows = [(*names[m], "test" if held else "train", i, recursions(model, x if held else change(x, i, m))[0]) for m, model in models.items()]
        return pd.DataFrame(rows, columns=["kind", "repeat", "part", "interval_id", "loglik"])

    out = f.groupBy("interval_id").applyInPandas(score, "kind string, repeat int, part string, interval_id long, loglik double")
    return out, {names[m]: model for m, model in models.items()}


def _gini(v: np.ndarray) -> float:
    v = np.sort(v.ravel()) + 1e-7
    return float(((2 * np.arange(1, len(v) + 1) - len(v) - 1) * v).sum() / (len(v) * v.sum()))


def sparsity(model: Model, subsets: int = 2000, seed: int = 0) -> dict[str, list[float]]:
    """How uneven a model is: Gini coefficients of departures and arrivals of each state, of all transitions, of all rates, of
    each series over the states and each state over the series; and the bottleneck over random sets of states
    (all sets, if there are no more than that)."""
    from .shuffles import bottleneck

    k = len(model.start)
    if 2**k - 2 <= subsets:
        sets = (np.arange(1, 2**k - 1)[:, None] >> np.arange(k)) & 1 == 1
    else:
        rng = np.random.default_rng(seed)
        sets = rng.random((subsets, k)) < rng.random((subsets, 1))
    return {"departures": [_gini(r) for r in model.trans], "arrivals": [_gini(c) for c in model.trans.T], "transitions": [_gini(model.trans)], "rates": [_gini(model.rates)],
            "series": [_gini(c) for c in model.rates.T], "states": [_gini(r) for r in model.rates], "bottleneck": [bottleneck(model.trans, sets)]}
