"""Linkage tables derived from the star-schema tables, as DataFrames and as the same SQL.

Customers are the S1 entities, suppliers the S2 and S3 records; every pair that traded is a candidate, with scores and
labels computed from the keys, so that both engines derive equal values from whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.lexicon import US_STATES
from kinfold.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PAIRS_SQL = """pairs AS (
  SELECT 'S1-' || c AS s1_id, (CASE WHEN s % 2 = 0 THEN 'S2-' ELSE 'S3-' END) || s AS cand_id,
         CASE WHEN s % 2 = 0 THEN 'S2' ELSE 'S3' END AS cand_source,
         CAST((c * 7919 + s * 104729) % 1000 AS DOUBLE) / 1000 AS p,
         CAST((c * 31 + s * 17) % 997 AS DOUBLE) / 997 AS p_ce,
         CASE WHEN (c * 7919 + s * 104729) % 1000 > 600 AND (c + s) % 3 <> 0 THEN 1 ELSE 0 END AS label,
         (c * 13 + s * 7) % 31 AS addr_rank, (c * 5 + s * 3) % 41 AS both_rank
  FROM (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""
IDS_SQL = "ids AS (SELECT 'S1-' || c_custkey AS s1_id FROM customer)"
TRUTH_SQL = """truth AS (
  SELECT s1_id, cand_id FROM pairs WHERE label = 1
  UNION SELECT 'S1-' || c_custkey, 'S2-X' || c_custkey FROM customer WHERE c_custkey % 50 = 0)"""
RECORDS_SQL = """records AS (
  SELECT 'S1-' || c_custkey AS entity_id, lower(r_name) AS country_norm,
         CASE WHEN c_custkey % 11 = 0 THEN '' ELSE lower(n_name) END AS addr_state,
         CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'town ' || (c_custkey % 37) END AS addr_city,
         (c_custkey % 9) || ' road town ' || (c_custkey % 37) AS addr_norm,
         CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey % 50 AS VARCHAR) END AS addr_numbers,
         lower(c_mktsegment) || ' unit ' || (c_custkey % 20) AS name_core
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s"))
    met = lines.join(orders, "o_orderkey").select("c", "s").distinct()
    source = F.when(F.col("s") % 2 == 0, "S2").otherwise("S3")
    mixed = (F.col("c") * 7919 + F.col("s") * 104729) % 1000
    return met.select(
        F.concat(F.lit("S1-"), "c").alias("s1_id"),
        F.concat(source, F.lit("-"), "s").alias("cand_id"),
        source.alias("cand_source"),
        (mixed.cast("double") / 1000).alias("p"),
        (((F.col("c") * 31 + F.col("s") * 17) % 997).cast("double") / 997).alias("p_ce"),
        F.when((mixed > 600) & ((F.col("c") + F.col("s")) % 3 != 0), 1).otherwise(0).alias("label"),
        ((F.col("c") * 13 + F.col("s") * 7) % 31).alias("addr_rank"),
        ((F.col("c") * 5 + F.col("s") * 3) % 41).alias("both_rank"),
    )


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("S1-"), "c_custkey").alias("s1_id"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs(spark, sf_dir).where("label = 1").select("s1_id", "cand_id")
    lost = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("S1-"), "c_custkey").alias("s1_id"), F.concat(F.lit("S2-X"), "c_custkey").alias("cand_id"))
    return found.union(lost).distinct()


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    df = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return df.select(
        F.concat(F.lit("S1-"), k).alias("entity_id"),
        F.lower("r_name").alias("country_norm"),
        F.when(k % 11 == 0, "").otherwise(F.lower("n_name")).alias("addr_state"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("town "), k % 37)).alias("addr_city"),
        F.concat(k % 9, F.lit(" road town "), k % 37).alias("addr_norm"),
        F.when(k % 7 == 0, "").otherwise((k % 50).cast("string")).alias("addr_numbers"),
        F.concat(F.lower("c_mktsegment"), F.lit(" unit "), k % 20).alias("name_core"),
    )


STATE_CODES = sorted(US_STATES)


CITIES = "Dover Salem Auburn Clinton Bristol Milton Oxford Newport Hudson Kingston Marion Ashland".split()


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records for normalisation: every part as a business, dealt over sources, cities and states. Sources spell the
    legal form and the letters' case in their own way; some records have an alias, no state or no address."""
    p = spread(table(spark, sf_dir, "part"))
    k = F.col("p_partkey")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (k % n + 1).cast("int"))
    source = F.when(k % 3 == 0, "S1").when(k % 3 == 1, "S2").otherwise("S3")
    legal = F.when(k % 3 == 2, " & Sons Private Limited #00").otherwise(" & Sons Pvt. Ltd. #00")
    alias = F.when(k % 7 == 0, F.concat(F.lit(" formerly known as "), F.initcap("p_type"), F.lit(" Workshop"))).otherwise("")
    name = F.concat("p_name", F.lit(" "), F.lower("p_type"), legal, k, alias)
    state = F.when(k % 13 == 0, "").otherwise(F.concat(F.lit(", "), F.upper(pick(STATE_CODES, len(STATE_CODES)))))
    address = F.concat(F.lit("Plot No 00"), k % 500, F.lit(", "), k % 90, F.lit(" Main Street, "), F.initcap("p_brand"), F.lit(", "), pick(CITIES, len(CITIES)), state)
    return p.select(
        F.concat(source, F.lit("-"), k).alias("entity_id"),
        F.when(k % 3 == 1, F.upper(name)).otherwise(name).alias("business_name"),
        F.when(k % 11 != 0, address).alias("business_address"),
        F.lit("US").alias("country"),
        source.alias("source"),
    )


_NAMES = "[" + ", ".join(f"'{US_STATES[c]}'" for c in STATE_CODES) + "]"
_CITIES = "[" + ", ".join(f"'{c.lower()}'" for c in CITIES) + "]"
#: The same records, normalised, as SQL.
CLEAN_SQL = f"""raw_parts AS (SELECT p_partkey AS k, p_name, lower(p_type) AS kind, regexp_extract(p_brand, '[0-9]+') AS brand, p_partkey % 11 = 0 AS gone FROM part),
clean AS (SELECT (CASE k % 3 WHEN 0 THEN 'S1-' WHEN 1 THEN 'S2-' ELSE 'S3-' END) || k AS entity_id, (CASE k % 3 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2' ELSE 'S3' END) AS source,
  p_name || ' ' || kind || ' and sons pvt ltd 00' || k || CASE WHEN k % 7 = 0 THEN ' ' || kind || ' workshop' ELSE '' END AS name_norm, p_name || ' ' || kind || ' and sons' AS name_core,
  CASE WHEN k % 7 = 0 THEN kind || ' workshop' ELSE '' END AS name_alias, 'ltd pvt' AS name_legal, left(p_name, 1) || left(split_part(p_name, ' ', 2), 1) || left(kind, 1) || 's' AS name_initials, false AS name_translit,
  CASE WHEN gone THEN '' ELSE (k % 500) || ' ' || (k % 90) || ' main st brand ' || brand || ' ' || {_CITIES}[k % {len(CITIES)} + 1] END AS addr_norm,
  CASE WHEN gone OR k % 13 = 0 THEN '' ELSE {_NAMES}[k % {len(STATE_CODES)} + 1] END AS addr_state, CASE WHEN gone THEN '' ELSE {_CITIES}[k % {len(CITIES)} + 1] END AS addr_city,
  CASE WHEN gone THEN '' ELSE array_to_string(list_transform(list_sort(list_transform(list_distinct([CAST(k % 500 AS VARCHAR), CAST(k % 90 AS VARCHAR), brand]), lambda n: lpad(CAST(length(n) AS VARCHAR), 4, '0') || n)), lambda x: substr(x, 5)), ' ') END AS addr_numbers,
  gone AS addr_missing, false AS addr_translit, 'us' AS country_norm FROM raw_parts)"""
