"""Connected components of a graph given as an edge table, by contraction in rounds.

Every round maps each node to the smallest node next to it (nodes get random order by a hash, so that paths
shrink by a constant factor) and keeps the edges between the images. The aggregates combine before the shuffle
and joins have one row per node on one side, so that adaptive execution may split the partition of a hub's edges. When few
edges are left (``tail_edges``, a constant), one task finishes them with union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize


def forest(n: int, left: np.ndarray, right: np.ndarray, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Union the pairs (left[i], right[i]) of items 0..n-1. Returns the root of every item (its smallest member)
    and the indices of pairs that form a spanning forest."""
    root = np.arange(n) if root is None else root
    live, used = np.arange(len(left)), []
    while len(live):
        a, b = root[left[live]], root[right[live]]
        live, a, b = live[a != b], a[a != b], b[a != b]
        if not len(live):
            break
        low, high = np.minimum(a, b), np.maximum(a, b)
        _, first = np.unique(high, return_index=True)  # every root hooks to one smaller root at most: no cycles
        root[high[first]] = low[first]
        used.append(live[first])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up
    return root, np.concatenate(used) if used else np.zeros(0, np.int64)


def _finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got = [p for p in parts if len(p)]
    if not got:
        return
    edges = pd.concat(got)
    nodes, index = np.unique(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), return_inverse=True)
    root, _ = forest(len(nodes), index[: len(edges)], index[len(edges) :])
    yield pd.DataFrame({"node": nodes, "label": nodes[root]})


def connected_components(edges: DataFrame, tail_edges: int = 20_000) -> DataFrame:
    """``edges`` has long columns a and b. Returns (node, label) for every node of an edge; label is an opaque
    long, equal exactly within a component. Self-loops, repeated and reversed edges are fine; no edges, no rows."""
    source = materialize(edges.where("a is not null and b is not null").select("a", "b").distinct())
    now = source.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    maps: list[DataFrame] = []
    while now.count() > tail_edges:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p")))
        maps.append(up)
        left = up.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        right = up.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        moved = now.join(left, "a").join(right, "b").where("pa <> pb")
        now = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    labels = now.coalesce(1).mapInPandas(_finish, "node long, label long")
    for up in reversed(maps):
        below = labels.select(F.col("node").alias("p"), "label")
        labels = up.join(below, "p", "left").select("node", F.coalesce("label", "p").alias("label"))
    nodes = source.select(F.col("a").alias("id")).unionByName(source.select(F.col("b").alias("id"))).distinct()
    return nodes.join(labels, F.xxhash64("id") == F.col("node")).select(F.col("id").alias("node"), "label")
