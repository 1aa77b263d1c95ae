"""Near-duplicate embeddings by an inverted multi-index.

Two codebooks, learned on a bounded sample, quantise the halves of unit vectors; their product is a grid of cells. A
vector lies in one cell (of its label) and visits cells by the multi-sequence order, nearest first by the distance it
would have to move to enter, until the distance is reached beyond which the target share of true neighbours has been
met. Cells are joined by key, vectors are compared in double precision, and only links of cosine ``threshold`` or more
count. Equal vectors are one class, compared once. Cells with many members or visitors are cut into blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize
from kinfold.llm.components import connected_components, forest


def kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Plain k-means on a bounded sample; returns at most k distinct centres."""
    rng = np.random.default_rng(seed)
    centres = np.unique(points, axis=0)
    centres = centres[rng.permutation(len(centres))[:k]]
    for _ in range(rounds):
        near = np.argmin(((centres**2).sum(1) - 2 * points @ centres.T), axis=1)
        for c in range(len(centres)):
            if (mine := near == c).any():
                centres[c] = points[mine].mean(0)
    return centres


class MultiIndex:
    """Codebooks of the halves and the stop distance of the traversal."""

    def __init__(self, first: np.ndarray, second: np.ndarray, stop: float):
        self.books, self.stop = (first, second), stop

    def entry_distances(self, half: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """For every half vector and centre: squared distance to the border with the cell of its nearest centre, 0 for
        that one; and the nearest centre."""
        book = self.books[which]
        gap = (book**2).sum(1) - 2 * half @ book.T
        near = np.argmin(gap, axis=1)
        apart = np.sqrt(np.maximum(((book[near][:, None] - book[None]) ** 2).sum(2), 1e-30))
        d = (gap - gap[np.arange(len(half)), near][:, None]) / (2 * apart)
        return np.maximum(d, 0) ** 2, near

    def visits(self, d1: np.ndarray, d2: np.ndarray) -> list[tuple[int, int]]:
        """Multi-sequence traversal of one vector: cells by rising d1[i] + d2[j], as long as that is within the stop."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        limit = self.stop**2 + 1e-12
        heap, out, seen = [(float(d1[o1[0]] + d2[o2[0]]), 0, 0)], [], {(0, 0)}
        while heap:
            d, i, j = heapq.heappop(heap)
            if d > limit:
                break
            out.append((int(o1[i]), int(o2[j])))
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(o1) and b < len(o2) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (float(d1[o1[a]] + d2[o2[b]]), a, b))
        return out

    def enters(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether each vector visits each given cell (number c1 * size of the second book + c2)."""
        n, h = len(self.books[1]), vectors.shape[1] // 2
        d1, d2 = self.entry_distances(vectors[:, :h], 0)[0], self.entry_distances(vectors[:, h:], 1)[0]
        return d1[:, cells // n] + d2[:, cells % n] <= self.stop**2 + 1e-12


def fit(sample: np.ndarray, k: int, threshold: float, target_recall: float, seed: int = 42) -> MultiIndex:
    """Codebooks of ``k`` centres a half, and the stop distance: the ``target_recall`` quantile of how far vectors of the
    sample must move to enter the cell of a neighbour at exactly the threshold, in a random direction (the worst
    case for neighbours beyond it); never more than the distance that makes the search exact."""
    dim = sample.shape[1]
    h = dim // 2
    exact = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    index = MultiIndex(kmeans(sample[:, :h], k, seed), kmeans(sample[:, h:], k, seed + 1), exact)
    rng = np.random.default_rng(seed)
    base = sample[rng.integers(0, len(sample), 20_000)]
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-30)
    moved = threshold * base + np.sqrt(1 - threshold**2) * noise
    need = np.zeros(len(base))
    for which, part in ((0, slice(0, h)), (1, slice(h, dim))):
        for a in range(0, len(base), 1000):
            d, _ = index.entry_distances(base[a : a + 1000, part], which)
            _, goal = index.entry_distances(moved[a : a + 1000, part], which)
            need[a : a + 1000] += d[np.arange(len(goal)), goal]
    index.stop = min(exact, float(np.sqrt(np.quantile(need, target_recall))))
    return index


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    largest = np.abs(flat).max(axis=1, keepdims=True)  # else squares of tiny or huge components leave the range
    flat = flat / largest
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _place(first: np.ndarray, second: np.ndarray, stop: float, dim: int):
    """Rows (class, label, vec) to rows (class, label, cell, home) for each visited cell."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, h, n = MultiIndex(first, second, stop), dim // 2, len(second)
        for whole in parts:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                v = _unit(part.column(1), dim)
                (d1, n1), (d2, n2) = index.entry_distances(v[:, :h], 0), index.entry_distances(v[:, h:], 1)
                row, cell, home = [], [], []
                for i in range(len(v)):
                    own = int(n1[i]) * n + int(n2[i])
                    for c1, c2 in index.visits(d1[i], d2[i]):
                        row.append(i)
                        cell.append(c1 * n + c2)
                        home.append(cell[-1] == own)
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(2).take(row), pa.array(cell, pa.int64()), pa.array(home, pa.bool_())], ["cls", "label", "cell", "home"])

    return run


def _compare(first: np.ndarray, second: np.ndarray, stop: float, dim: int, threshold: float):
    """Rows (task, cell, member, query, cls, times, vec) sorted by task: every query against the members of its task.
    Gives (a, b, n): b null for n links of class a's vectors; else an edge of the task's spanning forest."""

    def solve(cell, member, query, cls, times, v):
        index, n2, h = MultiIndex(first, second, stop), len(second), dim // 2
        mine, asking = np.flatnonzero(member), np.flatnonzero(query)
        if not len(mine) or not len(asking):
            return None
        links = np.zeros(len(cls), np.int64)
        root, edges = np.arange(len(cls)), []
        _, c1 = index.entry_distances(v[asking][:, :h], 0)
        _, c2 = index.entry_distances(v[asking][:, h:], 1)
        homes = c1.astype(np.int64) * n2 + c2
        for a in range(0, len(asking), 512):
            q = asking[a : a + 512]
            for b in range(0, len(mine), 4096):
                m = mine[b : b + 4096]
                hit = (v[q] @ v[m].T >= threshold) & (cls[q][:, None] != cls[m][None])
                if not hit.any():
                    continue
                i, j = np.nonzero(hit)
                links[q] += hit @ times[m]
                root, used = forest(len(cls), q[i], m[j], root)
                edges.append((cls[q[i][used]], cls[m[j][used]]))
                # a member that doesn't visit the query's own cell would miss the link from its side
                touched, place = np.unique(j, return_inverse=True)
                goal, at = np.unique(homes[a : a + 512][i], return_inverse=True)
                misses = ~index.enters(v[m[touched]], goal)[place, at]
                np.add.at(links, m[j[misses]], times[q[i[misses]]])
        some = np.flatnonzero(links)
        left = [cls[some]] + [e[0] for e in edges]
        right = [e[1] for e in edges]
        a = np.concatenate(left)
        b = pa.array([None] * len(some), pa.int64()) if not edges else pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(np.concatenate(right))])
        n = np.concatenate([links[some], np.zeros(len(a) - len(some), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], ["a", "b", "n"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for part in parts:
            if not part.num_rows:
                continue
            task = part.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1), len(task)]
            arrays = [part.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6)] + [_unit(part.column(6), dim)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and task[lo] != last:
                    if out := solve(*(np.concatenate(x) for x in zip(*held))):
                        yield out
                    held = []
                held.append([x[lo:hi] for x in arrays])
                last = task[lo]
        if held and (out := solve(*(np.concatenate(x) for x in zip(*held)))):
            yield out

    return run


def embedding_groups(vectors: DataFrame, threshold: float = 0.98, target_recall: float = 0.995, max_sample: int = 20_000, cell_rows: int = 32, block: int = 2048) -> DataFrame:
    """Near-duplicate groups of ``vectors`` (vec_id, embedding, label): one row per input row with vec_id, n_links,
    component_id and kept (vec_id = component_id).

    Only vectors with equal, non-null labels and of equal length are compared; each length has an index of its own, so
    they should be few. A vector that is null, zero or of fewer than two components, or that holds null or non-finite
    ones, links with nothing; so does a null label. Equal vectors link with each other; repeated rows are vectors of their own; a row
    without vec_id keeps null. Codebooks are learned from at most ``max_sample`` vectors (smallest hash). An empty table
    gives no rows; extra columns are ignored."""
    base = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 1) & finite, F.lit(False))
    rows = materialize(base.withColumn("good", good))
    usable = rows.where("good").withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    lengths = [r["dim"] for r in usable.select(F.size("vec").alias("dim")).distinct().orderBy("dim").collect()]
    alone = rows.where(~F.col("good"))
    out = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    for dim in lengths:
        out = out.unionByName(_linked(usable.where(F.size("vec") == dim), dim, threshold, target_recall, max_sample, cell_rows, block))
    return out


def _linked(usable: DataFrame, dim: int, threshold: float, target_recall: float, max_sample: int, cell_rows: int, block: int) -> DataFrame:
    """Groups of usable vectors (vec_id, vec, label) of one length."""
    of_class = F.xxhash64("label", "vec")
    fit_rows = usable.withColumn("cls", of_class)
    classes = materialize(fit_rows.groupBy("cls", "label", "vec").agg(F.count("*").alias("times"), F.min("vec_id").alias("first")))
    stats = classes.agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).first()
    sample = classes.select("vec").orderBy(F.xxhash64("cls", F.lit(5))).limit(max_sample).toArrow()["vec"].combine_chunks()
    k = int(np.clip(np.ceil(np.sqrt(stats["n"] / stats["labels"] / cell_rows)), 1, 1024))
    index = fit(_unit(sample, dim), k, threshold, target_recall)
    book = (*index.books, index.stop, dim)
    placed = materialize(classes.select("cls", "vec", "label").mapInArrow(_place(*book), "cls long, label string, cell long, home boolean"))
    key = F.xxhash64("label", "cell")
    counts = placed.groupBy(key.alias("spot")).agg(F.count("*").alias("q"), F.sum(F.col("home").cast("int")).alias("m"))
    counts = counts.where("m > 0 and q > 1").select("spot", F.ceil(F.col("q") / block).cast("int").alias("qs"), F.ceil(F.col("m") / block).cast("int").alias("ms"))
    spots = placed.withColumn("spot", key).join(counts, "spot")
    draw = lambda n, s: F.pmod(F.xxhash64("cls", F.lit(s)), F.col(n)).cast("int")
    spots = spots.withColumns({"qc": draw("qs", 1), "mc": draw("ms", 2)})
    # a query meets every block of members, a member every block of queries; where both are one, so is the row
    asks = spots.select("cls", "cell", "spot", "qc", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("mc"), F.lit(0).alias("member"), F.lit(1).alias("query"))
    holds = spots.where("home").select("cls", "cell", "spot", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qc"), "mc", F.lit(1).alias("member"), F.lit(0).alias("query"))
    both = asks.unionByName(holds).groupBy("cls", "cell", "spot", "qc", "mc").agg(F.max("member").alias("member"), F.max("query").alias("query"))
    tasks = both.join(classes.select("cls", "times", "vec"), "cls")
    tasks = tasks.select(F.xxhash64("spot", "qc", "mc").alias("task"), "cell", (F.col("member") == 1).alias("member"), (F.col("query") == 1).alias("query"), "cls", "times", "vec")
    found = materialize(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_compare(*book, threshold), "a long, b long, n long"))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b is not null").select("a", "b"))
    member = materialize(classes.select("cls", "first").join(parts.select(F.col("node").alias("cls"), F.col("label").alias("part")), "cls"))
    least = member.groupBy("part").agg(F.min("first").alias("least"))
    group = classes.select("cls", "times", "first").join(links.withColumnRenamed("a", "cls"), "cls", "left").join(member.join(least, "part").select("cls", "least"), "cls", "left")
    group = group.select("cls", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    return fit_rows.select("vec_id", "cls").join(group, "cls").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
