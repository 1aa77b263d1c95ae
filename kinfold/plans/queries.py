"""One query per operator over whole tables, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions.similarity import similarities, tri_state
from kinfold.operators import decide as dc
from kinfold.operators import features as ft
from kinfold.operators import lookups as lk
from kinfold.operators import metrics as mt
from kinfold.operators import model as md
from kinfold.operators import normalize as nm
from kinfold.operators import retrieve as rt
from kinfold.operators import sampling as sp
from kinfold.plans import golden
from kinfold.plans.views import CLEAN_SQL, IDS_SQL, PAIRS_SQL, RECORDS_SQL, TRUTH_SQL, businesses, ids, pairs, records, table, truth
from kinfold.sources import tables as io
from kinfold.sources.storage import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a function under its name, with its SQL after the named views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH " + ", ".join(views) + " " if views else "") + sql
        return f

    return add


PAIRS = (PAIRS_SQL,)
JUDGED = (PAIRS_SQL, TRUTH_SQL, IDS_SQL)
F05 = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_pred = 0 OR n_true = 0 THEN 0.0 ELSE 1.25 * tp / (n_pred + 0.25 * n_true) END"


# ---- sources and sinks -------------------------------------------------------------------------------------------


@query("SELECT 'S1-' || c_custkey AS source1_entity_id, coalesce(m, '') AS matched_entity_ids FROM customer LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS m FROM pairs WHERE p >= 0.7 GROUP BY s1_id) ON s1_id = 'S1-' || c_custkey", PAIRS)
def io_submission_lists(spark: SparkSession, d: str) -> DataFrame:
    return io.id_lists(ids(spark, d), pairs(spark, d).where("p >= 0.7").select("s1_id", "cand_id"))


@query("SELECT s1_id, cand_id FROM pairs WHERE p >= 0.7", PAIRS)
def io_explode_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = io.id_lists(ids(spark, d), pairs(spark, d).where("p >= 0.7").select("s1_id", "cand_id"))
    return io.explode_lists(lists, "source1_entity_id", "matched_entity_ids")


@query("SELECT url AS entity_id, url || ' | ' || html AS text FROM pages")
def io_record_texts(spark: SparkSession, d: str) -> DataFrame:
    return io.record_texts(table(spark, d, "pages").withColumn("entity_id", F.col("url")), "url", "html")


@query("SELECT p.s1_id, p.cand_id FROM pairs p ANTI JOIN (SELECT s1_id, cand_id FROM pairs WHERE p > 0.4) d ON p.s1_id = d.s1_id AND p.cand_id = d.cand_id", PAIRS)
def io_pending_work(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return io.pending(p.select("s1_id", "cand_id"), p.where("p > 0.4"), ["s1_id", "cand_id"])


@query("SELECT c_custkey::VARCHAR AS entity_id, c_name AS business_name, c_mktsegment AS business_address, c_nationkey::VARCHAR AS country, 'S1' AS source FROM customer")
def io_tsv_source(spark: SparkSession, d: str) -> DataFrame:
    """Written as an unquoted tab-separated source and read again."""
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_name").alias("business_name"), F.col("c_mktsegment").alias("business_address"), F.col("c_nationkey").cast("string").alias("country"))
    path = scratch_path(spark)
    io.write_source(rows, path)
    return io.read_source(spark, path, 1)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def io_filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    return io.read_table(spark, f"{d}/customer.parquet", ["c_custkey", "c_name"], F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))


# ---- normalisation -----------------------------------------------------------------------------------------------


@query(golden.values_sql(golden.NAMES, ["raw", "name_norm", "name_core"]))
def norm_golden_names(spark: SparkSession, d: str) -> DataFrame:
    return nm.with_names(spark.createDataFrame([(n[0],) for n in golden.NAMES], "raw string"), "raw").select("raw", "name_norm", "name_core")


@query(golden.values_sql(golden.ADDRESSES, ["raw", "country", "addr_state", "addr_city", "addr_numbers"]))
def norm_golden_addresses(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([a[:2] for a in golden.ADDRESSES], "raw string, country string")
    return nm.with_addresses(df, "raw").select("raw", "country", "addr_state", "addr_city", "addr_numbers")


@query(golden.values_sql(golden.ADDRESS_TEXTS, ["raw", "country", "addr_norm"]))
def norm_golden_address_texts(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([a[:2] for a in golden.ADDRESS_TEXTS], "raw string, country string")
    return nm.with_addresses(df, "raw").select("raw", "country", "addr_norm")


CLEAN_COLUMNS = [
    "entity_id", "name_norm", "name_core", "name_alias", "name_legal", "name_initials", "name_translit", "addr_norm", "addr_state", "addr_city", "addr_numbers", "addr_missing", "addr_translit", "country_norm",
]


@query(f"SELECT {', '.join(CLEAN_COLUMNS)} FROM clean", (CLEAN_SQL,))
def norm_records(spark: SparkSession, d: str) -> DataFrame:
    return nm.normalize_records(businesses(spark, d)).select(*CLEAN_COLUMNS)


@query("SELECT page_id, coalesce(regexp_extract(url, '([a-z0-9-]+)\\.(com|net|org)', 1), '') AS name FROM pages")
def norm_domain_names(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "//([^/]*)", 1)
    return table(spark, d, "pages").select("page_id", F.element_at(F.split(F.trim(F.regexp_replace(host, r"\b(?:www\.)?([a-z0-9-]+)\.(?:com|net|org)\b", " $1 ")), " "), -1).alias("name"))


@query("SELECT page_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_transform(regexp_extract_all(url, '[0-9]+'), lambda n: regexp_replace(n, '^0+(.)', '\\1'))), lambda n: lpad(CAST(length(n) AS VARCHAR), 4, '0') || n)), lambda x: substr(x, 5)), ' ') AS numbers FROM pages")
def norm_number_sets(spark: SparkSession, d: str) -> DataFrame:
    found = F.transform(F.regexp_extract_all("url", F.lit("([0-9]+)"), 1), lambda n: F.regexp_replace(n, "^0+(?!$)", ""))
    ordered = F.array_sort(F.transform(F.array_distinct(found), lambda n: F.struct(F.length(n).alias("n"), n.alias("s"))))
    return table(spark, d, "pages").select("page_id", F.array_join(F.transform(ordered, lambda x: x["s"]), " ").alias("numbers"))


@query("SELECT p_partkey, array_to_string([x FOR x, i IN w IF i = 1 OR x <> w[i - 1]], ' ') AS deduped FROM (SELECT p_partkey, string_split(p_name || ' ' || split_part(p_name, ' ', 2) || ' ' || lower(p_type) || ' ' || lower(p_type), ' ') AS w FROM part)")
def norm_adjacent_dedup(spark: SparkSession, d: str) -> DataFrame:
    name, kind = F.col("p_name"), F.lower("p_type")
    found = F.split(F.concat_ws(" ", name, F.split(name, " ")[1], kind, kind), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(nm.drop_repeats(found), " ").alias("deduped"))


@query("SELECT entity_id, CASE WHEN addr_numbers <> '' THEN addr_numbers || '|' || addr_city ELSE '' END AS addr_key FROM records", (RECORDS_SQL,))
def norm_location_keys(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("entity_id", nm.location_key(F.col("addr_numbers"), F.col("addr_city")).alias("addr_key"))


@query(
    """SELECT entity_id, unnest(list_concat(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS gram
       FROM (SELECT entity_id, string_split(addr_norm, ' ') AS w FROM records)""",
    (RECORDS_SQL,),
)
def norm_token_grams(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("entity_id", F.explode(nm.token_grams(F.col("addr_norm"))).alias("gram"))


# ---- projections and filters -------------------------------------------------------------------------------------


@query("SELECT s1_id, cand_id, addr_rank, both_rank, CAST(addr_rank BETWEEN 1 AND 5 AS INTEGER) + CAST(both_rank BETWEEN 1 AND 10 AS INTEGER) AS n_paths FROM pairs WHERE addr_rank BETWEEN 1 AND 5 OR both_rank BETWEEN 1 AND 10", PAIRS)
def filter_trim_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rt.trim_candidates(pairs(spark, d), 5, 10).select("s1_id", "cand_id", "addr_rank", "both_rank", "n_paths")


@query("SELECT s1_id, cand_id, p_ce AS score, p_ce - p AS diff FROM pairs WHERE cand_source = 'S3' AND label = 0 AND p >= 0.5 AND cand_id LIKE 'S3-1%'", PAIRS)
def filter_predicates(spark: SparkSession, d: str) -> DataFrame:
    f = pairs(spark, d).where((F.col("cand_source") == "S3") & (F.col("label") == 0) & (F.col("p") >= 0.5) & F.col("cand_id").startswith("S3-1"))
    return f.select("s1_id", "cand_id", F.col("p_ce").alias("score"), (F.col("p_ce") - F.col("p")).alias("diff"))


@query("SELECT s1_id, label FROM pairs", PAIRS)
def filter_drop_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    df = pairs(spark, d)
    return df.select(*md.drop_features(df.columns, ["p", "addr", "both", "cand"]))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def filter_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT s1_id FROM ids WHERE s1_id NOT IN (SELECT s1_id FROM truth)", JUDGED)
def filter_singletons(spark: SparkSession, d: str) -> DataFrame:
    return ids(spark, d).join(truth(spark, d), "s1_id", "left_anti")


# ---- retrieval ---------------------------------------------------------------------------------------------------

TFIDF_SQL = """
tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS term FROM documents),
tf AS (SELECT id, term, 1 + ln(count(*)) AS tf FROM tok GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM tf, n GROUP BY term HAVING count(*) <= 0.2 * any_value(n)),
pw AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
p AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM pw),
qt AS (SELECT item_id AS id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS term FROM benchmark),
qw AS (SELECT id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM qt JOIN idf USING (term) GROUP BY id, term),
q AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM qw),
s AS (SELECT q.id AS s1_id, p.id AS cand_id, round(sum(q.w * p.w), 6) AS score FROM q JOIN p USING (term) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank FROM s)"""
WORD_PATH = rt.SearchPath("word", (rt.Field("text", max_df=0.2),), 10)


def _benchmark_hits(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), "text")
    p = io.spread(table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), "text"))
    return rt.search(q, p, WORD_PATH, digits=6)


@query("SELECT s1_id, cand_id, score AS word_score, rank AS word_rank FROM top WHERE rank <= 10", (TFIDF_SQL,))
def retrieve_top10(spark: SparkSession, d: str) -> DataFrame:
    return _benchmark_hits(spark, d)


@query(
    "SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (SELECT item_id AS s1_id, doc_id AS cand_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) t "
    "LEFT JOIN (SELECT * FROM top WHERE rank <= 10) r USING (s1_id, cand_id) CROSS JOIN (VALUES (1), (5), (10)) AS g(k) GROUP BY k",
    (TFIDF_SQL,),
)
def retrieve_recall(spark: SparkSession, d: str) -> DataFrame:
    """Truth: the documents that hold a benchmark passage; the benchmark is a stated query set."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("s1_id"), F.col("text").alias("passage"))
    from kinfold.plans.linkage_queries import passage_holders

    return rt.recall_at(passage_holders(spark, d), _benchmark_hits(spark, d), "word_rank", [1, 5, 10])


@query(
    "SELECT cand_id, s1_id, score FROM (SELECT *, max(score) OVER (PARTITION BY cand_id) AS m FROM top WHERE rank <= 10) WHERE score >= m AND score >= 0.3",
    (TFIDF_SQL,),
)
def retrieve_owned(spark: SparkSession, d: str) -> DataFrame:
    hits = _benchmark_hits(spark, d).withColumnRenamed("word_score", "score")
    return dc.one_owner(hits, "score").where("score >= 0.3").select("s1_id", "cand_id", "score")


@query(
    """SELECT p_partkey, substr(' ' || w || ' ', CAST(i AS INTEGER), 3) AS gram FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), LATERAL (SELECT unnest(range(1, greatest(length(w), 1) + 1)) AS i)"""
)
def retrieve_char_grams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.explode(rt.terms(F.col("p_name"), "char_wb")).alias("gram"))


@query(
    "SELECT entity_id, unnest(CASE WHEN addr_state = '' THEN ['*'] ELSE [addr_state, ''] END) AS block FROM records",
    (RECORDS_SQL,),
)
def retrieve_block_keys(spark: SparkSession, d: str) -> DataFrame:
    return rt.block_keys(records(spark, d), None, True)


@query(
    """SELECT coalesce(a.s1_id, b.s1_id) AS s1_id, coalesce(a.cand_id, b.cand_id) AS cand_id, coalesce(a.p, 0) AS addr_score, coalesce(a.addr_rank, 0) AS addr_rank, coalesce(b.p_ce, 0) AS both_score, coalesce(b.both_rank, 0) AS both_rank,
       CAST(coalesce(a.addr_rank, 0) > 0 AS INTEGER) + CAST(coalesce(b.both_rank, 0) > 0 AS INTEGER) AS n_paths
       FROM (SELECT * FROM pairs WHERE addr_rank BETWEEN 1 AND 10) a FULL JOIN (SELECT * FROM pairs WHERE both_rank BETWEEN 1 AND 20) b ON a.s1_id = b.s1_id AND a.cand_id = b.cand_id""",
    PAIRS,
)
def join_full_outer_paths(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    a = p.where("addr_rank between 1 and 10").select("s1_id", "cand_id", F.col("p").alias("addr_score"), "addr_rank")
    b = p.where("both_rank between 1 and 20").select("s1_id", "cand_id", F.col("p_ce").alias("both_score"), "both_rank")
    return rt.merge_paths([("addr", a), ("both", b)])


# ---- joins -------------------------------------------------------------------------------------------------------


@query("SELECT p.s1_id, p.cand_id, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS is_match FROM pairs p LEFT JOIN truth t ON p.s1_id = t.s1_id AND p.cand_id = t.cand_id", JUDGED)
def join_labels(spark: SparkSession, d: str) -> DataFrame:
    t = truth(spark, d).withColumn("t", F.lit(1))
    return pairs(spark, d).join(t, ["s1_id", "cand_id"], "left").select("s1_id", "cand_id", F.coalesce("t", F.lit(0)).alias("is_match"))


@query("SELECT p.s1_id, p.cand_id, e.p_ce AS ce0 FROM pairs p LEFT JOIN (SELECT s1_id, cand_id, p_ce FROM pairs WHERE addr_rank > 3) e ON p.s1_id = e.s1_id AND p.cand_id = e.cand_id", PAIRS)
def join_extra_scores(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return dc.add_extra_scores(p.select("s1_id", "cand_id"), [p.where("addr_rank > 3").select("s1_id", "cand_id", "p_ce")])


@query("SELECT s1_id, cand_id FROM pairs WHERE s1_id NOT IN (SELECT s1_id FROM pairs WHERE addr_rank = 0)", PAIRS)
def join_require_scores(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    scored = dc.add_extra_scores(p.select("s1_id", "cand_id"), [p.where("addr_rank > 0").select("s1_id", "cand_id", "p_ce")])
    return dc.require_scores(scored, ["ce0"]).select("s1_id", "cand_id")


@query(
    """SELECT r.entity_id, coalesce(n.f, 0) AS name_core_freq, coalesce(k.f, 0) AS addr_key_freq FROM (SELECT *, addr_numbers || '|' || addr_city AS addr_key FROM records) r
       LEFT JOIN (SELECT country_norm, name_core, count(*) AS f FROM records GROUP BY ALL) n ON r.country_norm = n.country_norm AND r.name_core = n.name_core
       LEFT JOIN (SELECT country_norm, addr_numbers || '|' || addr_city AS addr_key, count(*) AS f FROM records WHERE addr_numbers <> '' GROUP BY ALL) k ON r.country_norm = k.country_norm AND r.addr_key = k.addr_key""",
    (RECORDS_SQL,),
)
def join_frequencies(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return lk.add_frequencies(r, r).select("entity_id", "name_core_freq", "addr_key_freq")


@query("SELECT s1_id, cand_id, outcome FROM (SELECT coalesce(p.s1_id, t.s1_id) AS s1_id, coalesce(p.cand_id, t.cand_id) AS cand_id, CASE WHEN p.s1_id IS NOT NULL AND t.s1_id IS NOT NULL THEN 'TP' WHEN p.s1_id IS NOT NULL THEN 'FP' WHEN c.s1_id IS NOT NULL THEN 'FN_scored' ELSE 'FN_missed' END AS outcome FROM (SELECT s1_id, cand_id FROM pairs WHERE p >= 0.7) p FULL JOIN truth t ON p.s1_id = t.s1_id AND p.cand_id = t.cand_id LEFT JOIN pairs c ON c.s1_id = coalesce(p.s1_id, t.s1_id) AND c.cand_id = coalesce(p.cand_id, t.cand_id))", JUDGED)
def join_error_breakdown(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return mt.error_breakdown(p.where("p >= 0.7"), truth(spark, d), p)


@query("SELECT coalesce(o.s1_id, n.s1_id) AS s1_id, coalesce(o.cand_id, n.cand_id) AS cand_id, CASE WHEN o.s1_id IS NULL THEN 'added' WHEN n.s1_id IS NULL THEN 'dropped' ELSE 'kept' END AS change FROM (SELECT * FROM pairs WHERE p >= 0.7) o FULL JOIN (SELECT * FROM pairs WHERE p_ce >= 0.6) n ON o.s1_id = n.s1_id AND o.cand_id = n.cand_id", PAIRS)
def join_output_diff(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return mt.output_diff(p.where("p >= 0.7"), p.where("p_ce >= 0.6"))


@query("SELECT s1_id, cand_id, p_ce AS s FROM pairs WHERE p >= 0.5 UNION ALL SELECT s1_id, cand_id, p FROM pairs WHERE NOT p >= 0.5", PAIRS)
def join_merge_scores(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return dc.merge_scores(p.where("p >= 0.5").select("s1_id", "cand_id", F.col("p_ce").alias("s")), p.select("s1_id", "cand_id", F.col("p").alias("s")))


# ---- learned lookups and aggregates ------------------------------------------------------------------------------


@query(
    """SELECT country_norm, addr_city, addr_state FROM (SELECT *, n / sum(n) OVER (PARTITION BY country_norm, addr_city) AS share FROM (SELECT country_norm, addr_city, addr_state, count(*) AS n FROM records WHERE addr_city <> '' AND addr_state <> '' GROUP BY ALL)) WHERE n >= 2 AND share >= 0.3""",
    (RECORDS_SQL,),
)
def agg_city_state(spark: SparkSession, d: str) -> DataFrame:
    return lk.learn_city_state(records(spark, d), 2, 0.3)


FILL_SQL = """cs AS (SELECT country_norm, addr_city, addr_state FROM (SELECT *, n / sum(n) OVER (PARTITION BY country_norm, addr_city) AS share FROM (SELECT country_norm, addr_city, addr_state, count(*) AS n FROM records WHERE addr_city <> '' AND addr_state <> '' GROUP BY ALL)) WHERE n >= 2 AND share >= 0.3),
grams AS (SELECT entity_id, country_norm, unnest(list_concat(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS addr_city FROM (SELECT entity_id, country_norm, string_split(addr_norm, ' ') AS w FROM records WHERE addr_state = '')),
votes AS (SELECT entity_id, min(addr_state) AS vote FROM grams JOIN cs USING (country_norm, addr_city) GROUP BY entity_id HAVING count(DISTINCT addr_state) = 1)"""


@query("SELECT r.entity_id, CASE WHEN r.addr_state = '' AND vote IS NOT NULL THEN vote ELSE r.addr_state END AS addr_state, r.addr_state = '' AND vote IS NOT NULL AS addr_state_inferred FROM records r LEFT JOIN votes v ON r.entity_id = v.entity_id", (RECORDS_SQL, FILL_SQL))
def agg_fill_state(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return lk.fill_state(r, lk.learn_city_state(r, 2, 0.3)).select("entity_id", "addr_state", "addr_state_inferred")


NEIGHBOR_VIEWS = (
    "rec AS (SELECT 'S1-' || c_custkey AS entity_id, lower(n_name) AS st, lower(r_name) AS co FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT (CASE WHEN s_suppkey % 2 = 0 THEN 'S2-' ELSE 'S3-' END) || s_suppkey, lower(n_name), lower(r_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "cnt AS (SELECT a.co, a.st AS s1, b.st AS s2, count(*) AS n FROM truth t JOIN rec a ON t.s1_id = a.entity_id JOIN rec b ON t.cand_id = b.entity_id GROUP BY ALL)",
    "odd AS (SELECT * FROM (SELECT *, n / sum(n) OVER (PARTITION BY co, s1) AS share FROM cnt) WHERE s1 <> s2 AND share >= 0.05 AND n >= 2)",
)


@query("SELECT s1 AS \"from\", s2 AS \"to\" FROM odd UNION SELECT s2, s1 FROM odd", (PAIRS_SQL, TRUTH_SQL, *NEIGHBOR_VIEWS))
def agg_neighbors(spark: SparkSession, d: str) -> DataFrame:
    place = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.lower("n_name").alias("addr_state"), F.lower("r_name").alias("country_norm"))
    c = table(spark, d, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S1-"), "c_custkey").alias("entity_id"), "country_norm", "addr_state")
    s = table(spark, d, "supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "S2-").otherwise("S3-"), "s_suppkey").alias("entity_id"), "country_norm", "addr_state")
    return lk.learn_neighbors(truth(spark, d), c.unionByName(s), 0.05, 2)


@query("SELECT country_norm, token, round(ln((n + 1.0) / (df + 1.0)), 6) AS idf FROM (SELECT country_norm, token, count(*) AS df FROM (SELECT DISTINCT entity_id, country_norm, unnest(string_split(name_core, ' ')) AS token FROM records) GROUP BY ALL) JOIN (SELECT country_norm, count(*) AS n FROM records GROUP BY ALL) USING (country_norm)", (RECORDS_SQL,))
def agg_token_idf(spark: SparkSession, d: str) -> DataFrame:
    return lk.token_idf(records(spark, d)).withColumn("idf", F.round("idf", 6))


@query("SELECT cand_source, count(*) AS n, count(DISTINCT s1_id) AS n_s1, round(avg(p), 6) AS mean_p, round(median(p), 6) AS median_p, round(avg(CAST(label = 1 AS DOUBLE)), 6) AS share, bool_or(p > 0.99) AS any_high FROM pairs GROUP BY cand_source", PAIRS)
def agg_group_report(spark: SparkSession, d: str) -> DataFrame:
    share = F.round(F.avg((F.col("label") == 1).cast("double")), 6)
    return pairs(spark, d).groupBy("cand_source").agg(F.count("*").alias("n"), F.count_distinct("s1_id").alias("n_s1"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.median("p"), 6).alias("median_p"), share.alias("share"), F.bool_or(F.col("p") > 0.99).alias("any_high"))


@query("SELECT label, count(*) FILTER (cand_source = 'S2') AS \"S2\", count(*) FILTER (cand_source = 'S3') AS \"S3\" FROM pairs GROUP BY label", PAIRS)
def agg_pivot(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).groupBy("label").pivot("cand_source", ["S2", "S3"]).count().fillna(0)


@query("SELECT s1_id, arg_max(cand_id, (p, cand_id)) AS best FROM pairs GROUP BY s1_id", PAIRS)
def agg_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).groupBy("s1_id").agg(F.max_by("cand_id", F.struct("p", "cand_id")).alias("best"))


@query("SELECT name_core, count(*) AS n FROM records GROUP BY name_core", (RECORDS_SQL,))
def agg_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("name_core").agg(F.count("*").alias("n"))


# ---- windows -----------------------------------------------------------------------------------------------------


@query(
    """SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) AS g_rank_in_s1, round(max(p) OVER (PARTITION BY s1_id) - p, 9) AS g_gap_to_best_s1, count(*) OVER (PARTITION BY s1_id) AS g_n_cands_s1,
       CAST(sum(CAST(p > 0.5 AS INTEGER)) OVER (PARTITION BY s1_id) AS BIGINT) AS g_n_above_05_s1, round(max(p) OVER (PARTITION BY s1_id, cand_source) - p, 9) AS g_gap_to_best_same_src FROM pairs""",
    PAIRS,
)
def window_group_features(spark: SparkSession, d: str) -> DataFrame:
    g = ft.group_features(pairs(spark, d), "p")
    gaps = {c: F.round(c, 9) for c in ("g_gap_to_best_s1", "g_gap_to_best_same_src")}
    return g.withColumns(gaps).select("s1_id", "cand_id", *md.GROUP_COLUMNS)


@query(
    """SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY p_ce DESC, cand_id) AS p_ce_rank, round(max(p_ce) OVER (PARTITION BY s1_id) - p_ce, 9) AS p_ce_gap, round(max(p_ce) OVER (PARTITION BY s1_id, cand_source) - p_ce, 9) AS p_ce_gap_src,
       CAST(sum(CAST(p_ce > 0.5 AS INTEGER)) OVER (PARTITION BY s1_id) AS BIGINT) AS p_ce_n05 FROM pairs""",
    PAIRS,
)
def window_score_features(spark: SparkSession, d: str) -> DataFrame:
    g = ft.score_features(pairs(spark, d), "p_ce").withColumns({c: F.round(c, 9) for c in ("p_ce_gap", "p_ce_gap_src")})
    return g.select("s1_id", "cand_id", "p_ce_rank", "p_ce_gap", "p_ce_gap_src", "p_ce_n05")


@query(
    """SELECT s1_id, cand_id, CAST(r = 1 AS INTEGER) AS sup_is_top, CASE WHEN r = 1 THEN max(CASE WHEN r = 2 THEN p END) OVER w ELSE max(CASE WHEN r = 1 THEN p END) OVER w END AS anchor_q, CASE WHEN r = 1 THEN max(CASE WHEN r = 2 THEN cand_id END) OVER w ELSE max(CASE WHEN r = 1 THEN cand_id END) OVER w END AS anchor_id
       FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) AS r FROM pairs) WINDOW w AS (PARTITION BY s1_id)""",
    PAIRS,
)
def window_anchors(spark: SparkSession, d: str) -> DataFrame:
    a = ft.anchors(pairs(spark, d).withColumn("own", F.col("cand_id")), "p", ["own"])
    return a.select("s1_id", "cand_id", "sup_is_top", F.col("anchor.q").alias("anchor_q"), F.col("anchor.own").alias("anchor_id"))


@query("SELECT s1_id, cand_id, p FROM (SELECT *, max(p) OVER (PARTITION BY cand_id) AS m FROM pairs) WHERE p >= m", PAIRS)
def window_one_owner(spark: SparkSession, d: str) -> DataFrame:
    return dc.one_owner(pairs(spark, d), "p").select("s1_id", "cand_id", "p")


def _standing_sql(column: str, name: str) -> str:
    return f"""row_number() OVER (PARTITION BY s1_id ORDER BY {column} DESC, cand_id) AS rank_{name}, round(max({column}) OVER (PARTITION BY s1_id) - {column}, 9) AS gap_{name},
       CAST(sum(CAST({column} > 0.5 AS INTEGER)) OVER (PARTITION BY s1_id) AS BIGINT) AS n_above_{name}, round(max({column}) OVER (PARTITION BY s1_id, cand_source) - {column}, 9) AS gap_src_{name}"""


@query(
    f"""SELECT s1_id, cand_id, p AS p_lgbm, p_ce, round(p * p_ce, 9) AS prod, round(p - p_ce, 9) AS diff, round(abs(p - p_ce), 9) AS absdiff, CAST(cand_source = 'S3' AS INTEGER) AS cand_is_s3,
       {_standing_sql("p", "p_lgbm")}, {_standing_sql("p_ce", "p_ce")}, count(*) OVER (PARTITION BY s1_id) AS n_cands FROM pairs""",
    PAIRS,
)
def window_stack_features(spark: SparkSession, d: str) -> DataFrame:
    s = ft.stack_features(pairs(spark, d).withColumnRenamed("p", "p_lgbm"))
    rounded = ["prod", "diff", "absdiff", *[f"{k}_{c}" for c in ("p_lgbm", "p_ce") for k in ("gap", "gap_src")]]
    return s.withColumns({c: F.round(c, 9) for c in rounded}).select("s1_id", "cand_id", *md.STACK_COLUMNS)


EXPECTED_SQL = """e AS (SELECT s1_id, cand_id, p, row_number() OVER o AS k, sum(p) OVER (o ROWS UNBOUNDED PRECEDING) AS tp, sum(p) OVER (PARTITION BY s1_id) / 0.98 AS total, exp(sum(ln(1 - least(p, 1 - 1e-9))) OVER (PARTITION BY s1_id)) AS none FROM pairs WHERE p >= 0.05 WINDOW o AS (PARTITION BY s1_id ORDER BY p DESC, cand_id)),
b AS (SELECT s1_id, arg_max(k, (1.25 * tp / (0.25 * total + k), -k)) AS best, max(1.25 * tp / (0.25 * total + k)) AS most, any_value(none) AS none FROM e GROUP BY s1_id)"""


@query("SELECT e.s1_id, e.cand_id FROM e JOIN b ON e.s1_id = b.s1_id WHERE b.most > b.none AND e.k <= b.best", (PAIRS_SQL, EXPECTED_SQL))
def window_expected_f05(spark: SparkSession, d: str) -> DataFrame:
    return dc.expected_f05_select(pairs(spark, d))


# ---- sort, sample, set operations --------------------------------------------------------------------------------


@query("SELECT s1_id, cand_id, p FROM pairs ORDER BY p, s1_id, cand_id LIMIT 20", PAIRS)
def sort_smallest(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).orderBy("p", "s1_id", "cand_id").limit(20).select("s1_id", "cand_id", "p")


@query("SELECT c_custkey, md5('3|' || c_custkey) AS h FROM customer ORDER BY h, c_custkey LIMIT 50 OFFSET 25")
def sample_offset(spark: SparkSession, d: str) -> DataFrame:
    picked = sp.hash_sample(table(spark, d, "customer"), 50, "c_custkey", 3, 25)
    return picked.select("c_custkey", F.md5(F.concat_ws("|", F.lit("3"), F.col("c_custkey").cast("string")).cast("binary")).alias("h"))


@query("SELECT entity_id, country_norm AS country, CAST(('0x' || substr(md5(entity_id), 1, 8))::BIGINT % 10 AS INTEGER) AS fold, ('0x' || substr(md5(entity_id), 1, 8))::BIGINT % 10 = 0 AS is_valid FROM records", (RECORDS_SQL,))
def sample_hash_split(spark: SparkSession, d: str) -> DataFrame:
    return sp.entity_split(records(spark, d).withColumnRenamed("country_norm", "country"))


@query("SELECT s1_id, cand_id, p FROM pairs UNION ALL SELECT s1_id, cand_id || '_dup0', p FROM pairs WHERE label = 0 AND p > 0.3", PAIRS)
def set_stress_copy(spark: SparkSession, d: str) -> DataFrame:
    return dc.stress_copy(pairs(spark, d), ["p"]).select("s1_id", "cand_id", "p")


@query("SELECT s1_id AS id FROM pairs UNION SELECT cand_id FROM pairs", PAIRS)
def set_union_ids(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return p.select(F.col("s1_id").alias("id")).union(p.select("cand_id")).distinct()


@query("SELECT s1_id, cand_id FROM pairs WHERE p >= 0.7 INTERSECT SELECT s1_id, cand_id FROM truth", JUDGED)
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).where("p >= 0.7").select("s1_id", "cand_id").intersect(truth(spark, d))


@query("SELECT s1_id FROM ids EXCEPT SELECT s1_id FROM truth", JUDGED)
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return ids(spark, d).subtract(truth(spark, d).select("s1_id"))


# ---- similarity and features -------------------------------------------------------------------------------------


@query(
    """SELECT a.entity_id AS s1_id, CASE WHEN a.addr_numbers = '' OR a.addr_city = '' THEN -1 WHEN a.addr_numbers = a.addr_city THEN 1 ELSE 0 END AS num_city, CASE WHEN addr_state = '' THEN -1 ELSE 1 END AS state_self, round(ln(1 + length(name_core)), 6) AS log_len FROM records a""",
    (RECORDS_SQL,),
)
def sim_tri_state(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return r.select(F.col("entity_id").alias("s1_id"), tri_state(F.col("addr_numbers"), F.col("addr_city")).cast("int").alias("num_city"), tri_state(F.col("addr_state"), F.col("addr_state")).cast("int").alias("state_self"), F.round(F.log1p(F.length("name_core").cast("double")), 6).alias("log_len"))


@query("SELECT p_partkey, round(jaro_winkler_similarity(p_name, lower(p_type)), 6) AS jw FROM part")
def sim_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("kind", F.lower("p_type"))
    return p.withColumn("s", similarities({"jw": ("jaro_winkler", F.col("p_name"), F.col("kind"))})).select("p_partkey", F.round("s.jw", 6).alias("jw"))


# ---- decisions and metrics ---------------------------------------------------------------------------------------

COUNTS_SQL = "SELECT i.s1_id, coalesce(t.n, 0) AS n_true, coalesce(c.n, 0) AS n_pred, coalesce(c.tp, 0) AS tp FROM ids i LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY s1_id) t ON i.s1_id = t.s1_id LEFT JOIN (SELECT m.s1_id, count(*) AS n, count(t.s1_id) AS tp FROM {m} m LEFT JOIN truth t ON m.s1_id = t.s1_id AND m.cand_id = t.cand_id GROUP BY m.s1_id) c ON i.s1_id = c.s1_id"
OWNED_SQL = "owned AS (SELECT *, max(p) OVER (PARTITION BY cand_id) AS m FROM pairs), matched AS (SELECT s1_id, cand_id FROM owned WHERE p >= m AND p >= 0.7)"


@query("SELECT s1_id, cand_id FROM matched", (PAIRS_SQL, OWNED_SQL))
def decide_matches(spark: SparkSession, d: str) -> DataFrame:
    return dc.decide(pairs(spark, d), "p", 0.7)


@query(f"SELECT s1_id, round({F05}, 6) AS f05 FROM (" + COUNTS_SQL.format(m="(SELECT * FROM pairs WHERE p >= 0.7)") + ")", JUDGED)
def metric_entity_f05(spark: SparkSession, d: str) -> DataFrame:
    e = mt.entity_f05(ids(spark, d), pairs(spark, d).where("p >= 0.7"), truth(spark, d))
    return e.select("s1_id", F.round("f05", 6).alias("f05"))


@query(f"SELECT round(avg({F05}), 6) AS f05 FROM (" + COUNTS_SQL.format(m="matched") + ")", (*JUDGED, OWNED_SQL))
def metric_macro_f05(spark: SparkSession, d: str) -> DataFrame:
    return mt.macro_f05(ids(spark, d), dc.decide(pairs(spark, d), "p", 0.7), truth(spark, d))


LONG_SQL = "long AS (SELECT s1_id, cand_id, 'lgbm' AS method, p AS s FROM pairs UNION ALL SELECT s1_id, cand_id, 'ce', p_ce FROM pairs UNION ALL SELECT s1_id, cand_id, 'blend0.7', 0.7 * p_ce + (1 - 0.7) * p FROM pairs)"
SWEEP_SQL = f"""grid AS (SELECT method, threshold FROM (VALUES ('lgbm'), ('ce'), ('blend0.7')) AS a(method), (VALUES (0.5::DOUBLE), (0.7), (0.9)) AS b(threshold)),
kept AS (SELECT method, threshold, s1_id, cand_id FROM (SELECT *, max(s) OVER (PARTITION BY method, cand_id) AS m FROM long) JOIN grid USING (method) WHERE s >= m AND s >= threshold),
cnt AS (SELECT k.method, k.threshold, k.s1_id, count(*) AS n, count(t.s1_id) AS tp FROM kept k LEFT JOIN truth t ON k.s1_id = t.s1_id AND k.cand_id = t.cand_id GROUP BY ALL),
res AS (SELECT method, threshold, round(avg({F05}), 6) AS f05 FROM (SELECT g.method, g.threshold, coalesce(t.n, 0) AS n_true, coalesce(c.n, 0) AS n_pred, coalesce(c.tp, 0) AS tp FROM ids i CROSS JOIN grid g LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY s1_id) t ON i.s1_id = t.s1_id LEFT JOIN cnt c ON c.s1_id = i.s1_id AND c.method = g.method AND c.threshold = g.threshold) GROUP BY method, threshold)"""


def methods(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).withColumn("b7", dc.blend("p_ce", "p", 0.7))


METHODS = {"lgbm": "p", "ce": "p_ce", "blend0.7": "b7"}


@query("SELECT method, threshold, f05 FROM res", (*JUDGED, LONG_SQL, SWEEP_SQL))
def metric_sweep(spark: SparkSession, d: str) -> DataFrame:
    return dc.sweep(methods(spark, d), METHODS, (0.5, 0.7, 0.9), ids(spark, d), truth(spark, d))


@query("SELECT c_mktsegment AS segment, round(avg(n), 6) AS mean_matches, round(avg(CAST(n = 0 AS DOUBLE)), 6) AS share_0, round(avg(CAST(n >= 6 AS DOUBLE)), 6) AS share_6_up FROM (SELECT c_mktsegment, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT s1_id, count(*) AS n FROM matched GROUP BY s1_id) ON s1_id = 'S1-' || c_custkey) GROUP BY c_mktsegment", (PAIRS_SQL, OWNED_SQL))
def report_match_profile(spark: SparkSession, d: str) -> DataFrame:
    who = table(spark, d, "customer").select(F.concat(F.lit("S1-"), "c_custkey").alias("s1_id"), F.col("c_mktsegment").alias("segment"))
    return mt.match_profile(who, dc.decide(pairs(spark, d), "p", 0.7), "segment")


# ---- learning ----------------------------------------------------------------------------------------------------

SMALL = md.Boosting(rounds=5, depth=3, min_rows=20)


@query()
def model_two_stage(spark: SparkSession, d: str) -> DataFrame:
    """Trained on nine folds of the queries, scores of the tenth."""
    p = materialize(pairs(spark, d).withColumn("mixed", (F.col("p") + F.col("p_ce")) / 2).withColumn("fold", sp.hash_fold(F.col("s1_id"), 10)))
    m = md.train_matcher(p.where("fold > 0"), ["p", "p_ce", "mixed", "addr_rank", "both_rank"], folds=3, p=SMALL)
    return m.predict(p.where("fold = 0"), "score").select("s1_id", "cand_id", "score")


@query()
def model_stacker(spark: SparkSession, d: str) -> DataFrame:
    oof, _ = md.stack_out_of_fold(pairs(spark, d).withColumnRenamed("p", "p_lgbm"), folds=3, p=SMALL)
    return oof.select("s1_id", "cand_id", "p_stack")


from kinfold.plans import linkage_queries  # noqa: E402  registers its queries with the same decorator

__all__ = ["QUERIES", "SQL", "linkage_queries"]
