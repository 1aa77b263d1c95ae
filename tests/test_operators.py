"""Retrieval, features, decisions and metrics on small inputs, against plain Python."""

import math
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.operators import decide as dc
from kinfold.operators import features as ft
from kinfold.operators import lookups as lk
from kinfold.operators import metrics as mt
from kinfold.operators import model as md
from kinfold.operators import retrieve as rt
from kinfold.operators import sampling as sp


def tfidf(pool, queries, max_df=1.0, min_df=1):
    n = len(pool)
    df = Counter(t for x in pool.values() for t in set(x.split()))
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if d >= min_df and d <= max_df * n}

    def vector(x):
        w = {t: (1 + math.log(c)) * idf[t] for t, c in Counter(x.split()).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / norm for t, v in w.items()} if norm else {}

    p = {k: vector(x) for k, x in pool.items()}
    return {q: {k: s for k, v in p.items() if (s := sum(w * v.get(t, 0) for t, w in vector(x).items())) > 0} for q, x in queries.items()}


POOL = {"p1": "oak street paris", "p2": "oak oak road", "p3": "elm street london", "p4": "nothing here", "p5": ""}
QUERIES = {"q1": "oak street", "q2": "elm elm london town", "q3": "unknown"}


def frame(spark, rows, state=""):
    return spark.createDataFrame([(k, x, "us", state) for k, x in rows.items()], "entity_id string, text string, country_norm string, addr_state string")


@pytest.mark.parametrize("max_df", [1.0, 0.2])
def test_search_equals_brute_force(spark, max_df):
    path = rt.SearchPath("t", (rt.Field("text", max_df=max_df),), 2)
    got = defaultdict(list)
    for r in rt.search(frame(spark, QUERIES), frame(spark, POOL), path, ("country_norm",)).orderBy("t_rank").collect():
        got[r.s1_id].append((r.cand_id, round(r.t_score, 6)))
    for q, scores in tfidf(POOL, QUERIES, max_df).items():
        assert got[q] == [(k, round(s, 6)) for k, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:2]]


def test_blocks(spark):
    pool = spark.createDataFrame([("a", "x y", "us", "tx"), ("b", "x y", "us", ""), ("c", "x y", "us", "ny"), ("d", "x y", "us", "ca")], "entity_id string, text string, country_norm string, addr_state string")
    q = spark.createDataFrame([("q", "x", "us", "tx"), ("r", "x", "us", "")], pool.schema)
    near = spark.createDataFrame([("tx", "ny"), ("ny", "tx")], "`from` string, `to` string")
    out = rt.search(q, pool, rt.SearchPath("t", (rt.Field("text"),), 9), ("country_norm",), near, blocked=True)
    found = defaultdict(set)
    for r in out.collect():
        found[r.s1_id].add(r.cand_id)
    assert found == {"q": {"a", "b", "c"}, "r": {"a", "b", "c", "d"}}


def test_chunks_of_a_cell_give_the_same(spark, monkeypatch):
    words = ["oak", "elm", "street", "road", "paris", "london", "town", "hill"]
    text = lambda k: " ".join(words[(k * 7 + j * (k % 5 + 1)) % 8] for j in range(2 + k % 4))
    pool, asks = ({f"{x}{k}": text(k + n) for k in range(60)} for x, n in (("p", 0), ("q", 3)))
    path = rt.SearchPath("t", (rt.Field("text"),), 5)
    found = lambda: sorted(map(tuple, rt.search(frame(spark, asks, "tx"), frame(spark, pool, "tx"), path, ("country_norm",), blocked=True).collect()))
    want = found()
    assert len(want) == 300
    for name, n in (("POOL_ROWS", 7), ("QUERY_ROWS", 9), ("PRODUCTS", 40)):
        monkeypatch.setattr(rt, name, n)
    assert found() == want


def vectors(n, seed, shared=60, rare=3000):
    """Unit vectors that all share ``shared`` terms and have three rare ones, some records twice, as a task gets them."""
    r = np.random.default_rng(seed)
    terms = np.hstack([np.tile(np.arange(shared), (n, 1)), shared + 3 * r.integers(0, rare // 3, (n, 3)) + np.arange(3)])
    w = np.hstack([r.integers(1, 3, (n, shared)), r.integers(2, 9, (n, 3))]).astype(float)
    copies = n // 10
    terms[:copies], w[:copies] = terms[copies : 2 * copies], w[copies : 2 * copies]
    w /= np.sqrt((w * w).sum(axis=1, keepdims=True))
    lists = lambda x, kind: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel(), kind))
    ids = pa.array([f"r{k * 7919 % n}" for k in range(n)])
    table = pa.table({"cell": pa.repeat("c", n), "s1_id": ids, "cand_id": ids, "terms": lists(terms, pa.int64()), "ws": lists(w, pa.float64())})
    full = np.zeros((n, shared + rare))
    np.put_along_axis(full, terms, w, 1)
    return table, full, ids.to_pylist()


def test_terms_that_all_records_share_cost_no_product_for_each_pair():
    """2,048 queries and two chunks of 8,192 records: two billion products of weights, a minute's work one by one."""
    k = 20
    queries, q, asked = vectors(2048, 0)
    pools = [vectors(8192, seed) for seed in (1, 2)]
    began = time.process_time()
    task = rt._Asked(queries, k, 9)
    for n, (pool, _, ids) in enumerate(pools):
        task.meet(pool.set_column(2, "cand_id", pa.array([f"{x}-{n}" for x in ids])))
    took = time.process_time() - began
    got = defaultdict(list)
    for r in pa.Table.from_batches(task.result(pa.string())).to_pylist():
        got[r["s1_id"]].append((r["cand_id"], r["score"]))
    names = [f"{x}-{n}" for n, (_, _, ids) in enumerate(pools) for x in ids]
    for i in range(0, 2048, 97):
        score = np.concatenate([p @ q[i] for _, p, _ in pools]).round(9)
        assert got[asked[i]] == sorted(zip(names, score.tolist()), key=lambda x: (-x[1], x[0]))[:k]
    assert len(got) == 2048 and took < 10


def test_terms_that_come_together_share_a_column(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = []
    merged = rt._merged
    monkeypatch.setattr(rt, "_merged", lambda c: (out := merged(c), sizes.append((len(c), len(set(out[0])))))[0])

    def vectors(n, k):  # 8 words of 12 grams each, half of them in a record, and one term of its own in 500
        has = rng.random((n, 8)) < 0.5
        has[:, 0] = True
        dense = np.hstack([np.repeat(has, 12, axis=1) * np.tile(np.linspace(1, 2, 12), 8), np.eye(500)[rng.integers(0, 500, n)] * 3])
        dense /= np.sqrt((dense * dense).sum(axis=1, keepdims=True))
        where = [np.flatnonzero(x) for x in dense]
        ids = [f"{k}{i:05}" for i in range(n)]
        return pa.table({"cell": ["c"] * n, "s1_id": ids, "cand_id": ids, "terms": where, "ws": [x[w] for x, w in zip(dense, where)]}), dense, ids

    queries, q, asked = vectors(300, "q")
    pools = [vectors(2000, k) for k in "ab"]
    task = rt._Asked(queries, 5, 9)
    for pool, _, _ in pools:
        task.meet(pool)
    got = defaultdict(list)
    for r in pa.Table.from_batches(task.result(pa.string())).to_pylist():
        got[r["s1_id"]].append((r["cand_id"], r["score"]))
    names = [x for _, _, ids in pools for x in ids]
    for i in range(300):
        score = np.concatenate([p @ q[i] for _, p, _ in pools])
        want = sorted(zip(names, score.round(9).tolist()), key=lambda x: (-x[1], x[0]))[:5]
        assert [c for c, _ in got[asked[i]]] == [c for c, _ in want]
        assert [s for _, s in got[asked[i]]] == pytest.approx([s for _, s in want], abs=2e-9)
    assert all(terms >= 96 and columns <= terms - 88 for terms, columns in sizes) and len(sizes) == 2


def test_trim_leaves_an_unlimited_path(spark):
    p = spark.createDataFrame([("s", "a", 9, 0), ("s", "b", 0, 9), ("s", "c", 0, 12)], "s1_id string, cand_id string, addr_rank int, both_rank int")
    assert {r.cand_id for r in rt.trim_candidates(p, 0, 10).collect()} == {"a", "b"}
    assert rt.trim_candidates(p, 0, 0).count() == 3


SCORED = [("s1", "S2-a", "S2", 0.9, 1), ("s1", "S3-b", "S3", 0.6, 0), ("s2", "S2-a", "S2", 0.9, 0), ("s2", "S2-c", "S2", 0.4, 1), ("s3", "S3-b", "S3", 0.7, 1)]


def scored(spark):
    return spark.createDataFrame(SCORED, "s1_id string, cand_id string, cand_source string, p double, label int")


def test_owners_ties_and_thresholds(spark):
    assert {tuple(r) for r in dc.decide(scored(spark), "p", 0.5).collect()} == {("s1", "S2-a"), ("s2", "S2-a"), ("s3", "S3-b")}
    assert dc.decide(scored(spark), "p", 0.5, owner=False).count() == 4


def test_required_scores(spark):
    df = scored(spark).withColumn("ce0", F.when(F.col("cand_id") != "S2-c", F.col("p")))
    assert {r.s1_id for r in dc.require_scores(df, ["ce0"]).collect()} == {"s1", "s3"}
    ids = spark.createDataFrame([("s1",), ("s2",)], "s1_id string")
    assert dc.require_scores(df, ["ce0"], ids.where("s1_id = 's1'")).count() == 3
    with pytest.raises(ValueError):
        dc.require_scores(df, ["ce0"], ids)


def test_stress_copies(spark):
    extra = [r.cand_id for r in dc.stress_copy(scored(spark), ["p"], 3).collect() if "_dup" in r.cand_id]
    assert sorted(extra) == ["S2-a_dup0", "S2-a_dup1", "S3-b_dup0", "S3-b_dup1"]


def test_f05_worked_example(spark):
    ids = spark.createDataFrame([(x,) for x in ("e", "empty", "pred", "true")], "s1_id string")
    pred = spark.createDataFrame([("e", "a"), ("e", "b"), ("e", "c"), ("pred", "a")], "s1_id string, cand_id string")
    truth = spark.createDataFrame([("e", "a"), ("e", "c"), ("true", "a")], "s1_id string, cand_id string")
    got = {r.s1_id: r.f05 for r in mt.entity_f05(ids, pred, truth).collect()}
    assert got == {"e": pytest.approx(0.714, abs=1e-3), "empty": 1.0, "pred": 0.0, "true": 0.0}
    assert mt.macro_f05(ids, pred, truth).first().f05 == pytest.approx((0.7142857 + 1) / 4, abs=1e-5)


def test_sweep_equals_single_decisions(spark):
    ids = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "s1_id string")
    truth = scored(spark).where("label = 1").select("s1_id", "cand_id")
    res = dc.sweep(scored(spark), {"m": "p"}, (0.5, 0.65, 0.99), ids, truth)
    for r in res.collect():
        assert r.f05 == pytest.approx(mt.macro_f05(ids, dc.decide(scored(spark), "p", r.threshold), truth).first().f05)
    assert dc.tune(scored(spark), "p", ids, truth).count() == 1


def test_expected_f05(spark):
    got = {tuple(r) for r in dc.expected_f05_select(scored(spark)).collect()}
    for s in ("s1", "s2", "s3"):
        ps = sorted(((p, c) for q, c, _, p, _ in SCORED if q == s), key=lambda x: (-x[0], x[1]))
        total, none = sum(p for p, _ in ps) / 0.98, math.prod(1 - p for p, _ in ps)
        value, k = max((1.25 * sum(p for p, _ in ps[:k]) / (0.25 * total + k), -k) for k in range(1, len(ps) + 1))
        want = {c for _, c in ps[:-k]} if value > none else set()
        assert {c for q, c in got if q == s} == want


def test_group_standing_and_anchors(spark):
    g = {(r.s1_id, r.cand_id): r for r in ft.group_features(scored(spark), "p").collect()}
    assert g["s2", "S2-c"].g_rank_in_s1 == 2 and g["s2", "S2-c"].g_gap_to_best_s1 == pytest.approx(0.5)
    assert g["s1", "S3-b"].g_gap_to_best_same_src == 0 and g["s1", "S3-b"].g_n_above_05_s1 == 2
    a = {(r.s1_id, r.cand_id): r for r in ft.anchors(scored(spark), "p", ["label"]).collect()}
    assert a["s1", "S2-a"].anchor.q == 0.6 and a["s1", "S3-b"].anchor.q == 0.9 and a["s3", "S3-b"].anchor is None


def test_lookups(spark):
    r = spark.createDataFrame([(str(i), "us", "paris", "tx") for i in range(9)] + [("9", "us", "paris", "ny"), ("10", "us", "rome", "ny")], "entity_id string, country_norm string, addr_city string, addr_state string")
    assert [tuple(x) for x in lk.learn_city_state(r).collect()] == [("us", "paris", "tx")]
    blank = spark.createDataFrame([("a", "us", "", "9 oak paris"), ("b", "us", "", "oak"), ("c", "us", "ny", "paris")], "entity_id string, country_norm string, addr_state string, addr_norm string")
    out = {x.entity_id: (x.addr_state, x.addr_state_inferred) for x in lk.fill_state(blank, lk.learn_city_state(r)).collect()}
    assert out == {"a": ("tx", True), "b": ("", False), "c": ("ny", False)}


def test_samples_contain_smaller_ones(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("entity_id"))
    small = {r.entity_id for r in sp.hash_sample(df, 10, seed=5).collect()}
    large = {r.entity_id for r in sp.hash_sample(df, 30, seed=5).collect()}
    rest = {r.entity_id for r in sp.hash_sample(df, 20, seed=5, offset=10).collect()}
    assert small < large and small | rest == large and not small & rest


def test_two_stage_model_learns_and_is_deterministic(spark, tmp_path):
    rows = [(f"s{i // 4}", f"S2-{i}", "S2", float(i % 10), float((i * 7) % 13), int(i % 10 > 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, cand_source string, x double, y double, label int")
    m = md.train_matcher(df, ["x", "y"], folds=2, p=md.Boosting(rounds=4, depth=2, min_rows=5))
    got = m.predict(df).select("cand_id", "p", "label").collect()
    assert min(r.p for r in got if r.label) > max(r.p for r in got if not r.label)
    assert sum(v for _, v in m.importance()) == pytest.approx(1)
    m.save(f"file://{tmp_path}/m", spark, 0.7)
    again, threshold = md.Matcher.load(f"file://{tmp_path}/m", spark)
    assert threshold == 0.7 and again.columns == ["x", "y"]
    assert sorted(again.predict(df).select("cand_id", "p", "label").collect()) == sorted(got)


def test_plans_have_no_cartesian_product(spark):
    path = rt.SearchPath("t", (rt.Field("text"),), 2)
    plan = rt.search(frame(spark, QUERIES), frame(spark, POOL), path, ("country_norm",))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan
