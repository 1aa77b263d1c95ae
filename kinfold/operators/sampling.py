"""Reproducible splits and samples by hashes of ids, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_fold(entity: Column, folds: int = 10) -> Column:
    """First 32 bits of the id's MD5, modulo ``folds``."""
    return F.pmod(F.conv(F.substring(F.md5(entity.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def entity_split(records: DataFrame, folds: int = 10, valid_fold: int = 0) -> DataFrame:
    fold = hash_fold(F.col("entity_id"), folds)
    return records.select("entity_id", "country", fold.alias("fold"), (fold == valid_fold).alias("is_valid"))


def group_fold(entity: Column, folds: int) -> Column:
    """Fold of a group for out-of-fold training."""
    return hash_fold(entity, folds)


def hash_sample(records: DataFrame, n: int, key: str = "entity_id", seed: int = 0, offset: int = 0) -> DataFrame:
    """``n`` rows in order of a seeded hash of their key, after ``offset`` of them: larger samples contain smaller ones."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    ordered = records.withColumn("kf_h", order).orderBy("kf_h", key)
    return (ordered.offset(offset) if offset else ordered).limit(n).drop("kf_h")
