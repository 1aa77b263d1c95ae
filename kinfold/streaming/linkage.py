"""Incremental linkage: new pool records, as they arrive, against a fixed set of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators.retrieve import Field, fit_idf, postings, term_weights


def query_index(queries: DataFrame, reference_pool: DataFrame, field: Field) -> tuple[DataFrame, DataFrame]:
    """(idf, postings of the queries), with statistics of a reference pool that stand for the stream's."""
    tf = term_weights(reference_pool, field, ())
    idf = fit_idf(reference_pool, tf, field, ())
    return idf, postings(term_weights(queries, field, ()), idf, field, ())


def match_batch(batch: DataFrame, idf: DataFrame, index: DataFrame, field: Field, min_score: float) -> DataFrame:
    """(s1_id, cand_id, score) of a batch of records that score ``min_score`` or more."""
    p = postings(term_weights(batch, field, ()), idf, field, ()).select("term", F.col("entity_id").alias("cand_id"), F.col("w").alias("pw"))
    q = index.select("term", F.col("entity_id").alias("s1_id"), F.col("w").alias("qw"))
    s = q.join(p, "term").groupBy("s1_id", "cand_id").agg(F.round(F.sum(F.col("qw") * F.col("pw")), 6).alias("score"))
    return s.where(F.col("score") >= min_score)


def stream_matches(spark: SparkSession, source: str, schema, idf: DataFrame, index: DataFrame, field: Field, min_score: float, out: str, checkpoint: str) -> StreamingQuery:
    """Read record files from ``source`` as they come and append their matches to ``out``; each batch is written under
    its own number, so one that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        match_batch(batch, idf, index, field, min_score).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
