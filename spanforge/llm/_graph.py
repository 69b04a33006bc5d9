"""Connected components by joins, with the smallest node as the label.

Every round hooks each node's parent to the least grandparent among its neighbours and
halves the paths, so the number of rounds grows with the logarithm of the diameter.
Labels are cut to the checkpoint folder once a round; nothing is collected but a count.
A graph of up to ``few`` edges is a few megabytes; it goes through the same rounds in one task,
on arrays, instead of through some twenty exchanges a round, which the driver has to plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import cut


#: Rows that a task of a round may have; a round's tables shrink to as few tasks as that allows.
_ROWS = 200_000

#: Edges that are solved in one task, as two arrays of 64-bit numbers; more go through joins.
_FEW = 1_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels) of the edges (u, v): each node once, with the least node that it reaches."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    return nodes, nodes[parent]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (u, v) -> (node, label)."""
    held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if held:
        found = least_reachable(*(np.concatenate(c) for c in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "label"])


def connected_components(edges: DataFrame, few: int = _FEW) -> DataFrame:
    """(node, label) for every node of the edges (u, v), whole numbers; label: the least node reachable.

    Self-loops and repeated edges are allowed; edges with a null end are left out.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if e.count() <= few:
        return cut(e.coalesce(1).mapInArrow(_solved, "node long, label long"))
    both = cut(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    tasks = both.count() // _ROWS + 1
    both = both.coalesce(tasks)
    state = cut(both.groupBy("u").agg(F.min("v").alias("m"))
                .select(F.col("u").alias("node"), F.least("u", "m").alias("parent")).coalesce(tasks))
    while True:
        up = state.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        known = state.join(up, "parent").select("node", "parent", "grand").coalesce(tasks)
        near = (both.join(known.select(F.col("node").alias("v"), "grand"), "v").coalesce(tasks)
                .groupBy("u").agg(F.min("grand").alias("least")).coalesce(tasks))
        seen = known.join(near, known.node == near.u).select("node", "parent", F.least("grand", "least").alias("least")).coalesce(tasks)
        better = (seen.select("node", "least")
                  .union(seen.select(F.col("parent").alias("node"), "least"))
                  .groupBy("node").agg(F.min("least").alias("least")).coalesce(tasks))
        after = cut(state.join(better, "node", "left")
                    .select("node", F.least("parent", F.coalesce("least", "parent")).alias("next"),
                            (F.coalesce("least", "parent") < F.col("parent")).alias("moved")).coalesce(tasks))
        moved = not after.where("moved").isEmpty()
        state = after.select("node", F.col("next").alias("parent"))
        if not moved:
            return state.select("node", F.col("parent").alias("label"))
