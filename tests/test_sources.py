"""Readers, writers, resumption and the streaming sink."""

import json

from pyspark.sql import functions as F

from kinfold.operators.retrieve import Field
from kinfold.sources import tables as io
from kinfold.streaming.linkage import query_index, stream_matches


def test_tsv_keeps_text_as_it_is(spark, tmp_path):
    rows = [("1", 'a "quoted" \\ name', "", "US"), ("2", "é", "x", "")]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    io.write_source(df, f"{tmp_path}/t")
    back = io.read_source(spark, f"{tmp_path}/t", 3).orderBy("entity_id").collect()
    assert [tuple(r) for r in back] == [(*r, "S3") for r in rows]
    assert io.read_source(spark, f"{tmp_path}/t", 3, limit=1).count() == 1


def test_ground_truth_and_submission(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",)], "s1_id string")
    pairs = spark.createDataFrame([("a", "S2-2"), ("a", "S2-1"), ("a", "S2-1")], "s1_id string, cand_id string")
    io.write_submission(ids, pairs, f"{tmp_path}/s")
    lists = {r[0]: r[1] for r in io.id_lists(ids, pairs).collect()}
    assert lists == {"a": "S2-1,S2-2", "b": ""}
    assert {tuple(r) for r in io.read_submission(spark, f"{tmp_path}/s").collect()} == {("a", "S2-1"), ("a", "S2-2")}


def test_tables_json_and_pending(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert io.write_table(df, f"file://{tmp_path}/p") and not io.write_table(df, f"file://{tmp_path}/p")
    assert io.read_table(spark, f"{tmp_path}/p", ["x"], F.col("id") > 7).count() == 2
    io.write_json(spark, {"b": [1], "a": 2}, f"file://{tmp_path}/c.json")
    assert json.loads((tmp_path / "c.json").read_text()) == {"a": 2, "b": [1]}
    work = spark.range(20)
    parts = [io.pending(work, spark.range(5), ["id"], k, 3) for k in range(3)]
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(5, 20))
    assert io.source_path("d", "train", 2) == "d/train/train_source2.tsv"


def test_streaming_matches_equal_batch(spark, tmp_path):
    pool = spark.createDataFrame([("p1", "oak street paris"), ("p2", "elm road rome")], "entity_id string, text string")
    queries = spark.createDataFrame([("q1", "oak paris")], "entity_id string, text string")
    pool.write.parquet(f"{tmp_path}/in")
    field = Field("text")
    idf, index = query_index(queries, pool, field)
    stream_matches(spark, f"{tmp_path}/in", pool.schema, idf, index, field, 0.1, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.s1_id, r.cand_id) for r in got] == [("q1", "p1")]
