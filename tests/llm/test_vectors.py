import numpy as np
import pytest

from kinfold.llm.multiindex import MultiIndex, embedding_groups, fit

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, n long"


def brute(rows, threshold=0.98):
    """(n_links, component_id) by comparing all pairs."""
    good = {}
    for k, (_, v, label, *_) in enumerate(rows):
        if label is not None and v and None not in v and len(v) > 1 and np.isfinite(v).all() and np.any(v):
            x = np.array(v, np.float32).astype(float)
            good[k] = x / np.linalg.norm(x)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    n = [0] * len(rows)
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                n[a] += 1
                up[find(a)] = find(b)
    ids = {}
    for k, r in enumerate(rows):
        ids.setdefault(find(k), []).append(r[0])
    return sorted((r[0] if r[0] is not None else -1, n[k], min((x for x in ids[find(k)] if x is not None), default=-1)) for k, r in enumerate(rows))


def made(seed, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.standard_normal(16)
        if k % 3 == 1:  # near the one before
            v = np.array(rows[-1][1], float) + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2])
        if k % 11 == 5:
            v = np.array(rows[-1][1], float) * rng.choice([1, 1, 3])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 3 == 0 and k % 2) if k % 3 == 0 else rows[-1][2], "x", 7))
    return rows


ODD = [
    (1000, None, 1, "x", 7), (1001, [], 1, "x", 7), (1002, [0.0] * 16, 1, "x", 7), (1003, [float("nan")] + [1.0] * 15, 1, "x", 7),
    (1004, [float("inf")] + [1.0] * 15, 1, "x", 7), (1005, [None] + [1.0] * 15, 1, "x", 7), (1006, [1.0] * 15, 1, "x", 7), (1007, [1.0] * 16, None, "x", 7),
    (1008, [1.0] * 16, 1, "x", 7), (1008, [1.0] * 16, 1, "x", 7), (None, [1.0] * 16, 1, "x", 7), (1009, [2.0] * 16, 1, "x", 7), (1010, [1e-30] * 16, 1, "x", 7), (1011, [1.0] * 16, 0, "x", 7),
    (1012, [2.0] * 15, 1, "x", 7), (1013, [1.0], 1, "x", 7), (1014, [1.0], 1, "x", 7), (1015, [1.0, 2.0], 1, "x", 7), (1016, [2.0, 4.0], 1, "x", 7), (1017, [2.0, 1.0], 1, "x", 7),
]


@pytest.mark.parametrize("block", [2048, 7])
def test_groups_equal_brute_force(spark, block):
    rows = made(1) + ODD
    got = embedding_groups(spark.createDataFrame(rows, SCHEMA), target_recall=1.0, block=block).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_dense_cluster_counts_every_link(spark):
    rng = np.random.default_rng(3)
    c = rng.standard_normal(16)
    rows = [(k, [float(np.float32(x)) for x in c + rng.standard_normal(16) * 0.08], 1, "x", 7) for k in range(400)]
    rows += [(400 + k, rows[0][1], 1, "x", 7) for k in range(50)]
    want = brute(rows)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_groups(spark.createDataFrame(rows, SCHEMA), cell_rows=16, block=64).collect())
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))


def test_recall_of_the_default_search(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rng = np.random.default_rng(5)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    for k, (_, v, label) in enumerate(list(rows)):
        x = np.array(v) / np.linalg.norm(v)
        noise = rng.standard_normal(64)
        noise -= (noise @ x) * x
        rows.append((10_000 + k, [float(y) for y in 0.982 * x + np.sqrt(1 - 0.982**2) * noise / np.linalg.norm(noise)], label))
    got = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    pairs = sum(r.component_id == r.vec_id - 10_000 for r in got if r.vec_id >= 10_000)
    assert pairs >= 0.98 * len(rows) / 2


def test_traversal_visits_cells_in_order_and_all_within_the_stop():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((500, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = fit(v, 6, 0.98, 1.0)
    d1, _ = index.entry_distances(v[:, :4], 0)
    d2, _ = index.entry_distances(v[:, 4:], 1)
    for i in range(20):
        cells = index.visits(d1[i], d2[i])
        costs = [d1[i][a] + d2[i][b] for a, b in cells]
        assert costs == sorted(costs) and set(cells) == {(a, b) for a in range(6) for b in range(6) if d1[i][a] + d2[i][b] <= index.stop**2 + 1e-12}
    assert isinstance(index, MultiIndex) and 0 < index.stop <= 0.2


def test_empty_and_blank_tables(spark):
    assert embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    got = embedding_groups(spark.createDataFrame(ODD[:6], SCHEMA)).collect()
    assert [(r.n_links, r.kept) for r in got] == [(0, True)] * 6
