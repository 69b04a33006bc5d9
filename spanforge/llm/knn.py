"""Exact top-k by inner product through a Voronoi kNN join (operator 5).

Vectors are grouped by their nearest pivot.  A cell's summary holds the least distances of its
members to the pivot, their greatest one, the range of their coordinates along ``AXES`` common
directions (the main ones of the pivots), and the greatest length of what these leave.  For a
query q and a member x at distance d of pivot p, ``q.p - |q| d <= q.x <= q.p + |q| d``; along the
directions q.x is at most the sum of the better ends of the ranges, and no more than the product
of the remaining lengths besides.  The summaries alone give each query a score that its k-th
best reaches for certain; a piece of a cell is sent to a block of queries only if the lesser of
both upper bounds reaches that score for one of them, and is solved there by one matrix product.
``visited_share`` tells how many of the candidates that leaves.

Equal vectors are one member with its smallest ids, as many as a query can need; so a vector
that a third of all rows repeat costs no more than any other, and no row that could be in a
result is lost.  Pivots are a sample by hash, half the square root of the rows and at least 32; from
``most_pivots`` on their number is fixed, which bounds the summaries (about 40 numbers each).

Defined results: rows with a null id, a null vector, or a null or non-finite component take no
part; vectors are compared with vectors of the same length; a query's own row is left out once,
other rows with its id stay; repeated query rows give repeated results; an empty table gives
an empty result; further columns are ignored.  A score beyond the range of a long is the end of
that range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frame import narrow, table
from ._scratch import cut


def quantised(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): integer vectors floor(scale * x) of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = narrow(vectors, id_col, vec_col).where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    return rows.where(ok).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c)).alias("v"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


#: Directions along which cells keep the range of their members.
AXES = 16
LONG = 2**63


class Pivots:
    """Pivots by the vectors' length."""

    def __init__(self, sample: list[list[int]]) -> None:
        self.by: dict[int, np.ndarray] = {}
        for v in sample:
            self.by.setdefault(len(v), []).append(v)
        self.by = {k: np.array(v, np.float64).reshape(len(v), k) for k, v in self.by.items()}
        self.most = max(1, len(sample))
        self.axes: dict[int, np.ndarray] = {}
        for dim, p in self.by.items():  # main directions, as orthonormal columns
            self.axes[dim] = np.linalg.svd(p, full_matrices=False)[2][:AXES].T

    def of(self, dim: int) -> np.ndarray:
        return self.by.get(dim, np.zeros((1, dim)))

    def place(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers (length and pivot in one) and distances to the pivot, rounded up a little."""
        p = self.of(dim)
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1), 0))
        i = d.argmin(1)
        exact = np.sqrt(((x - p[i]) ** 2).sum(1))
        return dim * self.most + i, exact * (1 + 1e-12) + 1e-9

    def along(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates along the directions, missing ones 0, and the lengths of the rest."""
        a = self.axes.get(dim, np.zeros((dim, 0)))
        c = x @ a
        rest = np.sqrt(np.maximum((x * x).sum(1) - (c * c).sum(1), 0))
        return np.pad(c, ((0, 0), (0, AXES - c.shape[1]))), rest

    def centre(self, cell: int) -> np.ndarray:
        return self.of(cell // self.most)[cell % self.most]


def _by_length(v: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the lists of each length."""
    n = np.array(v.value_lengths().to_pylist(), np.int64)
    for dim in np.unique(n).tolist():
        rows = np.flatnonzero(n == dim)
        yield dim, rows, _matrix(v.take(pa.array(rows)), dim)


def _place_udf(pivots: Pivots):
    kind = T.StructType([T.StructField("cell", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("along", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())])

    @F.arrow_udf(kind)
    def place(v: pa.Array) -> pa.Array:
        cell, d, along, rest = np.zeros(len(v), np.int64), np.zeros(len(v)), np.zeros((len(v), AXES)), np.zeros(len(v))
        for dim, rows, x in _by_length(v):
            cell[rows], d[rows] = pivots.place(dim, x)
            along[rows], rest[rows] = pivots.along(dim, x)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * AXES), pa.array(along.ravel()))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(d), lists, pa.array(rest)], kind.names)

    return place


class Summary:
    """Of a cell: distances to the pivot (the least ones and the greatest), ranges along the axes, length of the rest."""

    def __init__(self, near: list[float], reach: float, low: list[float], high: list[float], rest: float) -> None:
        self.near, self.reach, self.low, self.high, self.rest = np.array(near), reach, np.array(low), np.array(high), rest


def _needs_udf(pivots: Pivots, least: dict[int, Summary], k: int):
    """Integer vectors -> the cells that may hold one of the k best, and the score that these reach."""
    kind = T.StructType([T.StructField("sure", T.DoubleType()), T.StructField("cells", T.ArrayType(T.LongType()))])
    by: dict[int, list[int]] = {}
    for c in least:
        by.setdefault(c // pivots.most, []).append(c)

    @F.arrow_udf(kind)
    def needs(v: pa.Array) -> pa.Array:
        sure, cells = np.full(len(v), -np.inf), [[]] * len(v)
        for dim, rows, x in _by_length(v):
            own = sorted(by.get(dim, []))
            if not own:
                continue
            norm = np.sqrt((x * x).sum(1))
            dots = x @ np.array([pivots.centre(c) for c in own]).T
            slack = 1e-9 * (1 + np.abs(dots).max(initial=0))
            low = np.concatenate([dots[:, [j]] - norm[:, None] * least[c].near for j, c in enumerate(own)], axis=1) - slack
            if low.shape[1] > k:  # one may be the query itself
                sure[rows] = -np.partition(-low, k, axis=1)[:, k]
            ball = dots + norm[:, None] * np.array([least[c].reach for c in own])
            a, rest = pivots.along(dim, x)
            box = np.maximum(a, 0) @ np.array([least[c].high for c in own]).T + np.minimum(a, 0) @ np.array([least[c].low for c in own]).T
            box += rest[:, None] * np.array([least[c].rest for c in own])
            high = np.minimum(ball, box + 1e-9 * np.abs(box)) + slack
            for r, h, s in zip(rows.tolist(), high, sure[rows], strict=True):
                cells[r] = [own[j] for j in np.flatnonzero(h >= s)]
        return pa.StructArray.from_arrays([pa.array(sure), pa.array(cells, pa.list_(pa.int64()))], kind.names)

    return needs


PIECE = "cell long, piece long, dim int, n int, reach double, kind string, data binary, ids array<array<long>>"


def _pack(group: pa.Table) -> pa.Table:
    """One row for a piece of a cell: its vectors as one block of the narrowest integers."""
    dim = len(group["v"][0])
    x = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    kind = next(k for k in ("<i2", "<i4", "<i8") if not len(x) or abs(x).max() <= np.iinfo(k).max)
    return pa.table({"cell": group["cell"][:1], "piece": group["piece"][:1], "dim": pa.array([dim], pa.int32()), "n": pa.array([len(group)], pa.int32()),
                     "reach": pa.array([max(group["d"].to_pylist())]), "kind": [kind], "data": pa.array([x.astype(kind).tobytes()], pa.binary()),
                     "ids": pa.array([group["ids"].to_pylist()], pa.list_(pa.list_(pa.int64())))})


def _solve_udf(pivots: Pivots, k: int):
    kind = T.ArrayType(T.StructType([T.StructField("query_id", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("q", T.ArrayType(T.LongType())), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())]))

    @F.arrow_udf(kind)
    def solve(block: pa.Array, piece: pa.Array) -> pa.Array:
        out = []
        for qs, p in zip(block.to_pylist(), piece.to_pylist(), strict=True):
            found, dim = [], p["dim"]
            raw = np.frombuffer(p["data"], p["kind"]).reshape(p["n"], dim)
            q = np.array([x["v"] for x in qs], np.int64).reshape(len(qs), dim)
            top = float(np.abs(raw).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, dim)
            centre, norm = pivots.centre(p["cell"]), np.sqrt((q.astype(np.float64) ** 2).sum(1))
            high = q @ centre + norm * p["reach"]
            high += 1e-9 * (1 + np.abs(high))
            if top < 2**53:
                dots = (q.astype(np.float64) @ raw.astype(np.float64).T).astype(np.int64)
            else:
                dots = (q.astype(object) @ raw.astype(object).T)
            for i, x in enumerate(qs):
                if high[i] < x["sure"]:
                    continue
                row = dots[i]
                if len(row) > k + 1:
                    best = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                    at = np.flatnonzero(row >= best)
                else:
                    at = np.arange(len(row))
                near = []
                for j in at.tolist():
                    ids = p["ids"][j]
                    if x["id"] in ids and np.array_equal(raw[j], q[i]):
                        ids = list(ids)
                        ids.remove(x["id"])  # the query's own row, once
                    near += [(-int(row[j]), v) for v in ids]
                near = [(max(-LONG + 1, min(LONG, s)), v) for s, v in near] if top >= LONG else near
                found += [{"query_id": x["id"], "copies": x["copies"], "q": x["v"], "vec_id": v, "score": min(LONG - 1, -s)} for s, v in sorted(near)[:k]]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("query_id", pa.int64()), ("copies", pa.int64()), ("q", pa.list_(pa.int64())), ("vec_id", pa.int64()), ("score", pa.int64())])))

    return solve


class Cells:
    """The vectors in their cells, and what each query needs of them."""

    def __init__(self, vectors: DataFrame, k: int, query_every: int, scale: int, pivots: int | None, most_pivots: int, id_col: str, vec_col: str) -> None:
        self.rows = rows = cut(quantised(vectors, scale, id_col, vec_col))
        n = pivots or min(most_pivots, max(32, math.isqrt(rows.count()) // 2))
        few = Window.partitionBy("v").orderBy("id")  # Spark limits each task's rows of a vector before the shuffle
        members = (rows.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= k + 1)
                   .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
        sample = [list(r.v) for r in rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(n).collect()]
        self.pivots = Pivots(sample)
        placed = cut(members.withColumn("at", _place_udf(self.pivots)("v")).select("v", "ids", "at.*"))
        near = Window.partitionBy("cell").orderBy("d", "v")
        least = (placed.select("cell", "d", F.row_number().over(near).alias("_r")).where(F.col("_r") <= k + 1)
                 .groupBy("cell").agg(F.array_sort(F.collect_list("d")).alias("near")))
        ends = [F.array(*[f(F.col("along")[i]) for i in range(AXES)]).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
        self.size = placed.groupBy("cell").agg(F.max("d").alias("reach"), F.max("rest").alias("rest"), F.count("*").alias("n"), *ends)
        # at most one row for each pivot and length
        summary = {r.cell: Summary(r.near, r.reach, r.low, r.high, r.rest) for r in least.join(self.size, "cell").collect()}
        self.placed = placed.select("v", "ids", "cell", "d")
        self.asked = (rows.where(F.col("id") % query_every == 0).groupBy("id", "v").agg(F.count("*").alias("copies"))
                      .withColumn("at", _place_udf(self.pivots)("v")["cell"]).withColumn("need", _needs_udf(self.pivots, summary, k)("v")))


def visited_share(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, pivots: int | None = None, most_pivots: int = 4096,
                  id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row: n_queries, n_pairs (distinct candidates in the cells that each query must visit) and their share of all pairs."""
    c = Cells(vectors, k, query_every, scale, pivots, most_pivots, id_col, vec_col)
    pairs = c.asked.select("id", F.explode("need.cells").alias("cell")).join(c.size.select("cell", "n"), "cell").agg(F.sum("n").alias("n_pairs"))
    every = c.size.agg(F.sum("n").alias("_n")).crossJoin(c.asked.agg(F.count("*").alias("n_queries")))
    return pairs.crossJoin(every).select("n_queries", "n_pairs", (F.col("n_pairs") / (F.col("n_queries") * F.col("_n"))).alias("share"))


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, pivots: int | None = None, most_pivots: int = 4096, piece: int = 1024,
          block: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to smaller ids.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all rows but
    the query's own.
    """
    c = Cells(vectors, k, query_every, scale, pivots, most_pivots, id_col, vec_col)
    split = c.placed.join(F.broadcast(c.size.select("cell", "n")), "cell")  # a row for each pivot and length
    pieces = (split.withColumn("piece", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / piece))).drop("n")
              .groupBy("cell", "piece").applyInArrow(_pack, PIECE))
    # queries of one cell need nearly the same cells, so blocks are made of such
    load = c.asked.groupBy("at").agg(F.count("*").alias("n"))
    blocks = (c.asked.select(F.col("at").alias("own"), "id", "v", "copies", "need.sure", "need.cells")
              .join(load.withColumnRenamed("at", "own"), "own")
              .withColumn("part", F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / block)))
              .groupBy("own", "part").agg(F.collect_list(F.struct("id", "v", "copies", "sure")).alias("queries"),
                                          F.array_distinct(F.flatten(F.collect_list("cells"))).alias("cells")))
    met = blocks.select("queries", F.explode("cells").alias("cell")).join(pieces, "cell")
    found = met.select(F.explode(_solve_udf(c.pivots, k)("queries", F.struct("cell", "dim", "n", "reach", "kind", "data", "ids"))).alias("m")).select("m.*")
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_c")).drop("_c")


def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
