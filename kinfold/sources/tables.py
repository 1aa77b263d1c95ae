"""Readers and writers: tab-separated sources, ground truth, submissions, Parquet with projection and resumption."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
PLAIN = {"sep": "\t", "quote": "", "escape": "", "header": "true", "encoding": "UTF-8", "emptyValue": "", "nullValue": "\x00none"}


def source_path(folder: str, split: str, n: int) -> str:
    return f"{folder}/{split}/{split}_source{n}.tsv"


def strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_source(spark: SparkSession, path: str, n: int, columns: Sequence[str] = SOURCE_COLUMNS, limit: int | None = None) -> DataFrame:
    """Unquoted UTF-8 table of strings plus source (S1, S2, ...); what is missing is empty, never null."""
    df = spark.read.options(**PLAIN).schema(strings(columns)).csv(path).fillna("")
    df = df.withColumn("source", F.lit(f"S{n}"))
    return df.limit(limit) if limit else df


def write_source(df: DataFrame, path: str, columns: Sequence[str] = SOURCE_COLUMNS) -> None:
    df.select(*columns).write.options(**{k: v for k, v in PLAIN.items() if k != "nullValue"}).csv(path)


def explode_lists(df: DataFrame, key: str, lists: str, out_key: str = "s1_id", out: str = "cand_id") -> DataFrame:
    """Comma lists to one row per id; blank ids go."""
    each = df.select(F.col(key).alias(out_key), F.explode(F.split(lists, ",")).alias(out))
    return each.withColumn(out, F.trim(out)).where(F.col(out) != "")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.options(**PLAIN).schema(strings(["source1_entity_id", "matched_entity_ids"])).csv(path)
    return explode_lists(df, "source1_entity_id", "matched_entity_ids")


read_submission = read_ground_truth


def id_lists(ids: DataFrame, pairs: DataFrame, distinct: bool = True) -> DataFrame:
    """(source1_entity_id, matched_entity_ids): one row per id of ``ids`` (s1_id), its matches sorted and comma-joined,
    empty where there are none."""
    gather = F.collect_set("cand_id") if distinct else F.collect_list("cand_id")
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(gather), ",").alias("matched_entity_ids"))
    out = ids.select("s1_id").join(lists, "s1_id", "left")
    return out.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))


def write_submission(ids: DataFrame, pairs: DataFrame, path: str) -> None:
    id_lists(ids, pairs).write.options(**{k: v for k, v in PLAIN.items() if k != "nullValue"}).csv(path)


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> bool:
    """Parquet (zstd), committed as a whole; an existing table stays unless ``overwrite``. Tells if it wrote."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not overwrite and target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return False
    replace_table(df, path)
    return True


def replace_table(df: DataFrame, path: str) -> None:
    """Write next to ``path`` first and rename when all is committed: readers see the old table or the new one, and a
    job that fails leaves the old one."""
    spark = df.sparkSession
    name = spark._jvm.org.apache.hadoop.fs.Path
    fresh, old, target = name(f"{path}.{uuid.uuid4().hex}.new"), name(f"{path}.{uuid.uuid4().hex}.old"), name(path)
    df.write.option("compression", "zstd").parquet(fresh.toString())
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(fresh, target):
        raise OSError(f"can't rename {fresh.toString()}")
    fs.delete(old, True)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where=None) -> DataFrame:
    """Parquet with the projection and filter pushed to the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def spread(df: DataFrame, per_core: int = 4 << 20) -> DataFrame:
    """``df`` in as many partitions as the session has cores if, by its files' sizes, it has less than ``per_core`` bytes
    for each: a table in one small file would else be one task's work. Larger tables stay as their files split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < per_core * cores else df


def record_texts(records: DataFrame, name: str, address: str, ids: DataFrame | None = None) -> DataFrame:
    """(entity_id, text): name and address joined by a bar; of the given ids only."""
    df = records.join(ids, "entity_id", "left_semi") if ids is not None else records
    return df.select("entity_id", F.concat_ws(" | ", F.coalesce(name, F.lit("")), F.coalesce(address, F.lit(""))).alias("text"))


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str], part: int = 0, n_parts: int = 1) -> DataFrame:
    """Work that no finished table holds, of this part of ``n_parts``: how a long scoring job resumes and is shared out."""
    mine = work.where(F.pmod(F.xxhash64(*keys), F.lit(n_parts)) == part) if n_parts > 1 else work
    return mine.join(done.select(*keys), list(keys), "left_anti")


def write_pairs_and_queries(pairs: DataFrame, queries: DataFrame, path: str) -> None:
    """Candidate pairs, and next to them every query, those without a candidate too."""
    replace_table(pairs, f"{path}/pairs")
    replace_table(queries, f"{path}/queries")


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small JSON document, written through the cluster's file system."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path, True)
    stream.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
    stream.close()


def read_json(spark: SparkSession, path: str) -> object:
    """What :func:`write_json` wrote."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
