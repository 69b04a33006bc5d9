"""State sequences: transition matrices, order scores, passage times, and inequality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transitions(seq: DataFrame, keys: list[str], state: str, order: list[str]) -> DataFrame:
    """(i, j, n, p) of consecutive states."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = seq.select(F.col(state).alias("i"), F.lead(state).over(w).alias("j")).where("j is not null").groupBy("i", "j").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("i")))


def order_score(seq: DataFrame, trans: DataFrame, keys: list[str], state: str, order: list[str], collapse_repeats: bool = False) -> DataFrame:
    """(keys, score, length): summed log transition chances less the log of the length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = seq.select(*keys, *order, F.col(state).alias("i"))
    if collapse_repeats:
        rows = rows.withColumn("_b", F.lag("i").over(w)).where("_b is null or _b <> i").drop("_b")
    steps = rows.withColumn("j", F.lead("i").over(w))
    scored = steps.join(trans.select("i", "j", F.log("p").alias("lp")), ["i", "j"], "left")
    return scored.groupBy(*keys).agg((F.coalesce(F.sum("lp"), F.lit(0.0)) - F.log(F.count("*"))).alias("score"), F.count("*").alias("length"))


def diversity(seq: DataFrame, keys: list[str], state: str) -> DataFrame:
    return seq.groupBy(*keys).agg(F.countDistinct(state).alias("n_states"), (F.countDistinct(state) / F.count("*")).alias("diversity"))


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Gini coefficient of non-negative values, by their rank from below."""
    w = Window.partitionBy(*keys)
    r = df.select(*keys, F.col(value).cast("double").alias("x")).withColumn("_i", F.row_number().over(w.orderBy("x"))).withColumn("_n", F.count("*").over(w))
    return r.groupBy(*keys).agg((F.sum((2 * F.col("_i") - F.col("_n") - 1) * F.col("x")) / (F.max("_n") * F.sum("x"))).alias("gini"))


def steady_state(p: np.ndarray) -> np.ndarray:
    """Stationary distribution of a small transition matrix (number of states squared numbers)."""
    n = len(p)
    a = np.vstack((p.T - np.eye(n), np.ones(n)))
    return np.linalg.lstsq(a, np.append(np.zeros(n), 1.0), rcond=None)[0]


def _passages(p: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Column by column the solution of m = right + P m, with nothing carried on from the target itself."""
    out = np.empty_like(p, float)
    for j in range(len(p)):
        onward = p.copy()
        onward[:, j] = 0
        out[:, j] = np.linalg.solve(np.eye(len(p)) - onward, right[:, j])
    return out


def first_passage(p: np.ndarray) -> np.ndarray:
    """Mean steps from i to j: one step, and the mean from wherever it leads unless that is j."""
    return _passages(p, np.ones_like(p, float))


def first_passage_variance(p: np.ndarray) -> np.ndarray:
    """From the second moments, by the same first step (Kemeny and Snell, Finite Markov Chains):
    E T^2 = 1 + sum over k other than j of p(i, k) (2 E T(k, j) + E T(k, j)^2)."""
    m = first_passage(p)
    onward = p @ m - p * np.diag(m)
    return _passages(p, 1 + 2 * onward) - m * m


def edges(trans: DataFrame, least: float, loops: bool = False) -> DataFrame:
    """(i, j, p) of the transitions with at least that chance, as the edges of a graph."""
    return trans.where((F.col("p") >= least) & (F.lit(loops) | (F.col("i") != F.col("j")))).select("i", "j", "p")


def departures(trans: DataFrame) -> DataFrame:
    """(i, j, p) given that the state is left."""
    off = trans.where("i <> j")
    return off.join(off.groupBy("i").agg(F.sum("p").alias("_s")), "i").select("i", "j", (F.col("p") / F.col("_s")).alias("p"))


def matrix_of(trans: DataFrame, most: int = 2000) -> tuple[list, np.ndarray]:
    """(states, chances) of a transition table, on the driver; a chain of more than ``most`` states is refused."""
    states = [r[0] for r in trans.select("i").union(trans.select("j")).distinct().limit(most + 1).collect()]
    if len(states) > most:
        raise ValueError(f"the equations of a chain are solved in one place; there are more than {most} states")
    at = {s: k for k, s in enumerate(sorted(states))}
    p = np.zeros((len(at), len(at)))
    for r in trans.select("i", "j", "p").collect():
        p[at[r["i"]], at[r["j"]]] = r["p"]
    return list(at), p


def stationary(trans: DataFrame) -> DataFrame:
    """(state, p): the share of time that the chain spends in each state in the long run."""
    states, p = matrix_of(trans)
    kind = trans.schema["i"].dataType.simpleString()
    return trans.sparkSession.createDataFrame([(s, float(v)) for s, v in zip(states, steady_state(p), strict=True)], f"state {kind}, p double")


def passages(trans: DataFrame) -> DataFrame:
    """(i, j, steps, variance): mean and variance of the steps from i until j is reached (again)."""
    states, p = matrix_of(trans)
    kind, m, v = trans.schema["i"].dataType.simpleString(), first_passage(p), first_passage_variance(p)
    rows = [(a, b, float(m[x, y]), float(v[x, y])) for x, a in enumerate(states) for y, b in enumerate(states)]
    return trans.sparkSession.createDataFrame(rows, f"i {kind}, j {kind}, steps double, variance double")
