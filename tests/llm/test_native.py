"""Quality rules and sharding: DataFrame functions only, against plain Python."""

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from kinfold.llm import oracles
from kinfold.llm.linefreq import quality_rules
from kinfold.llm.sharding import minimax_cuts, shard_documents

from .helpers import documents, odd_docs

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def outcome(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words


def test_counts_equal_plain_python(spark):
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules(docs).collect():
        n, *_, rep = want = base(texts[r.doc_id])
        assert outcome(r) == want
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.kept and r.base_failed)


def test_many_repeats_take_the_sorted_way(spark):
    text = " ".join(f"w{i % 70} v{i % 70}" for i in range(400)) + " x y z x y z x y"
    (r,) = quality_rules(spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")).collect()
    assert outcome(r) == base(text)


def test_common_lines_go_per_host(spark):
    own = lambda i: " ".join(f"own{i}w{k}" for k in range(60))
    menu = " ".join(f"menu{k}" for k in range(80))
    rows = [(i, f"{own(i)}\n  MENU0 " + menu[6:] if i % 2 else own(i), "a") for i in range(30)]
    rows += [(100 + i, f"{own(i)}x\n{menu}", "b") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.kept, r.n_removed_words) for r in quality_rules(df, min_docs=10).collect()}
    assert all(got[i] == ((False, 80) if i % 2 else (True, 0)) for i in range(30)) and all(got[100 + i] == (True, 0) for i in range(3))
    twice = {(r.doc_id, r.n_removed_words) for r in quality_rules(df.unionByName(df), min_docs=10).collect()}
    assert twice == {(i, g[1]) for i, g in got.items()}


def test_rejections_equal_sql(spark):
    """At limits where many documents lose most of their words."""
    import duckdb

    duckdb.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = duckdb.sql(oracles.quality(1, 0.0, 0.95)).df()
    rows = quality_rules(documents(spark, "sf0.01"), 1, 0.0, 0.95).toPandas()[list(want.columns)]
    order = lambda d: sorted(map(tuple, d.itertuples(index=False)))
    assert order(rows) == order(want)
    assert 50 < (~rows.kept & ~rows.base_failed).sum() < 500 and (rows.n_removed_words > 0).sum() > 100


def test_odd_rows(spark):
    got = quality_rules(odd_docs(spark), min_docs=1, growth=0.5).collect()
    assert len(got) == 13 and all(r.base_failed and not r.kept for r in got if r.n_words == 0)
    assert quality_rules(odd_docs(spark).limit(0)).count() == 0
    assert {outcome(r) for r in got} == {base(r.text) for r in odd_docs(spark).collect()}


def python_free(df):
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_main_paths_are_native(spark):
    assert python_free(quality_rules(documents(spark))) and python_free(shard_documents(documents(spark)))


def greedy(sizes, capacity):
    n, load, cuts = 1, 0, []
    for i, s in enumerate(sizes):
        if load + s > capacity:
            n, load = n + 1, 0
            cuts.append(i)
        load += s
    return n, cuts


def test_capacity_is_the_smallest_feasible(spark):
    sizes = [7, 2, 9, 4, 4, 1, 8, 30, 2, 2, 5, 6]
    for shards in (1, 2, 3, 5, 40):
        capacity = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c)[0] <= shards)
        df = spark.createDataFrame(list(enumerate(sizes)), "atom int, size long")
        assert minimax_cuts(df, shards) == greedy(sizes, capacity)[1]


def test_shards_hold_their_law(spark):
    docs = documents(spark, "sf0.01")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = shard_documents(docs).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    total, place, slots = Counter(), {}, {}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        total[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert place.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(total) == set(range(40))
    assert max(total.values()) <= sum(total.values()) / 40 + 2 * max(len(t.encode()) + 16 for t in texts.values())
    again = shard_documents(docs.repartition(7)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_a_hot_group_is_numbered_in_parts(spark):
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = shard_documents(df, shards=5, unit_rows=100).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len({r.shard for r in got if r.doc_id < 700}) == 1


def test_odd_shard_rows(spark):
    got = shard_documents(odd_docs(spark)).collect()
    assert len(got) == 13 and sum(r.size == 16 and r.text_crc32 == 0 for r in got) == 4
    assert shard_documents(odd_docs(spark).limit(0)).count() == 0
