"""Lookup tables learned from the records: city to state, confusable states, frequencies, token rarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.normalize import location_key, token_grams


def share_of(counts: DataFrame, group: list[str], n: str = "n") -> DataFrame:
    """``counts`` plus share, each count's part of its group's total."""
    return counts.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(*group)))


def learn_city_state(s1: DataFrame, min_count: int = 3, min_purity: float = 0.9) -> DataFrame:
    """(country_norm, addr_city, addr_state) that hold for nearly all records of a city."""
    known = s1.where("addr_city <> '' and addr_state <> ''").groupBy("country_norm", "addr_city", "addr_state").agg(F.count("*").alias("n"))
    sure = share_of(known, ["country_norm", "addr_city"]).where((F.col("n") >= min_count) & (F.col("share") >= min_purity))
    return sure.select("country_norm", "addr_city", "addr_state")


def fill_state(records: DataFrame, city_state: DataFrame) -> DataFrame:
    """Blank states filled where exactly one state is named by the towns in the address; addr_state_inferred tells."""
    blank = records.where("addr_state = ''").select("entity_id", "country_norm", F.explode(F.array_distinct(token_grams(F.col("addr_norm")))).alias("addr_city"))
    votes = blank.join(city_state.withColumnRenamed("addr_state", "vote"), ["country_norm", "addr_city"])
    one = votes.groupBy("entity_id").agg(F.count_distinct("vote").alias("n"), F.min("vote").alias("vote")).where("n = 1").drop("n")
    out = records.join(one, "entity_id", "left")
    found = (F.col("addr_state") == "") & F.col("vote").isNotNull()
    return out.withColumn("addr_state_inferred", found).withColumn("addr_state", F.when(found, F.col("vote")).otherwise(F.col("addr_state"))).drop("vote")


def learn_neighbors(pairs: DataFrame, records: DataFrame, min_share: float = 0.005, min_pairs: int = 20) -> DataFrame:
    """(from, to) of states that matched records confuse, in both directions."""
    a = records.select(F.col("entity_id").alias("s1_id"), "country_norm", F.col("addr_state").alias("s1"))
    b = records.select(F.col("entity_id").alias("cand_id"), F.col("addr_state").alias("s2"))
    counts = pairs.join(a, "s1_id").join(b, "cand_id").where("s1 <> '' and s2 <> ''").groupBy("country_norm", "s1", "s2").agg(F.count("*").alias("n"))
    odd = share_of(counts, ["country_norm", "s1"]).where((F.col("s1") != F.col("s2")) & (F.col("share") >= min_share) & (F.col("n") >= min_pairs))
    return odd.select(F.col("s1").alias("from"), F.col("s2").alias("to")).union(odd.select("s2", "s1")).distinct()


def neighbor_lists(neighbors: DataFrame) -> DataFrame:
    """(state, others): the map form of :func:`learn_neighbors`."""
    return neighbors.groupBy(F.col("from").alias("state")).agg(F.array_sort(F.collect_set("to")).alias("others"))


def add_frequencies(records: DataFrame, pool: DataFrame) -> DataFrame:
    """name_core_freq and addr_key_freq: how many pool records share a name, blank ones included, or a location."""
    names = pool.groupBy("country_norm", "name_core").agg(F.count("*").cast("int").alias("name_core_freq"))
    key = location_key(F.col("addr_numbers"), F.col("addr_city"))
    places = pool.withColumn("addr_key", key).where("addr_key <> ''").groupBy("country_norm", "addr_key").agg(F.count("*").cast("int").alias("addr_key_freq"))
    out = records.withColumn("addr_key", key).join(names, ["country_norm", "name_core"], "left").join(places, ["country_norm", "addr_key"], "left")
    return out.drop("addr_key").fillna(0, ["name_core_freq", "addr_key_freq"])


def token_idf(pool: DataFrame, column: str = "name_core") -> DataFrame:
    """(country_norm, token, idf): ln((n + 1) / (df + 1)), df counting records."""
    n = pool.groupBy("country_norm").agg(F.count("*").alias("n"))
    seen = pool.select("country_norm", F.explode(F.array_distinct(F.filter(F.split(column, " "), lambda t: t != ""))).alias("token"))
    df = seen.groupBy("country_norm", "token").agg(F.count("*").alias("df"))
    return df.join(n, "country_norm").select("country_norm", "token", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)).alias("idf"))
