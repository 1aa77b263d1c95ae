from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.llm.mixing import mix_documents, mix_sources, pivotal_counts, source_targets

from .helpers import documents, odd_docs


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        share = {s: rest * w[s] / sum(w[x] for x in names if x not in full) for s in names if s not in full}
        more = {s for s in share if share[s] > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else share[s] for s in names}
        full |= more


def test_targets(spark):
    sizes = {"b": 1000, "a": 10, "é": 500, None: 1, "z": 0, "Z": 3000}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == {s: pytest.approx(t) for s, t in targets(sizes).items()}


def test_mix_comes_near_targets_and_reruns_agree(spark):
    docs = documents(spark, "sf0.1")
    got = mix_sources(docs).collect()
    again = {(r.doc_id, r.taken) for r in mix_sources(docs.repartition(13)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    words = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    sums = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        s = sums[r.source_size, r.target]
        s[0] += r.taken
        s[1] = r.target
        s[2] = max(s[2], r.size)
        assert r.size == words[r.doc_id] and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert all(abs(taken - target) <= largest for taken, target, largest in sums.values())
    assert sum(abs(taken - target) for taken, target, _ in sums.values()) < 0.03 * sum(r.size for r in got)


def test_expectations_hold(spark):
    df = spark.range(40).select(F.lit(1).cast("long").alias("grp"), F.col("id").alias("key"), (F.col("id") % 7 + 1).alias("size"), F.lit(1.3).alias("rate"))
    total = defaultdict(int)
    for seed in range(12):
        for r in pivotal_counts(df, seed).collect():
            total[r.key] += r.n
    assert {n for n in total.values()} <= set(range(12, 25))
    assert sum(total.values()) / (12 * 40) == pytest.approx(1.3, abs=0.08)


def test_a_large_source_goes_through_the_tree(spark):
    df = spark.range(140_000).select(F.lit(1).cast("long").alias("grp"), F.col("id").alias("key"), (F.col("id") % 9 + 1).alias("size"), F.lit(0.37).alias("rate"))
    got = pivotal_counts(df).agg(F.count("*").alias("n"), F.sum(F.col("n") * F.col("size")).alias("taken"), F.max("n").alias("most")).first()
    assert got.n == 140_000 and got.most == 1
    assert abs(got.taken - 0.37 * sum(i % 9 + 1 for i in range(140_000))) <= 9


def test_odd_rows_and_rows_of_the_mix(spark):
    docs = odd_docs(spark)
    got = mix_sources(docs).collect()
    assert len(got) == 13 and all(r.taken == 0 for r in got if r.size == 0)
    assert mix_sources(docs.limit(0)).count() == 0
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    taken = sum(r.taken for r in got)
    kept = sum(len((r.text or "").split()) for r in mixed.collect())
    assert abs(kept - taken) <= 24_000 and mix_documents(docs.limit(0)).count() == 0
    assert sum(not (r.text or "").strip() for r in mixed.collect()) == 5
