"""Queries over the normalised records: retrieval in blocks, pair features, rare words, the audit of normalisation, and
the sinks, each with SQL that computes the same from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import decide as dc
from kinfold.operators import features as ft
from kinfold.operators import lookups as lk
from kinfold.operators import metrics as mt
from kinfold.operators import model as md
from kinfold.operators import normalize as nm
from kinfold.operators import retrieve as rt
from kinfold.operators import sampling as sp
from kinfold.plans import kernels_sql as ks
from kinfold.plans.queries import F05, JUDGED, METHODS, PAIRS, TFIDF_SQL, WORD_PATH, methods, query
from kinfold.plans.views import CLEAN_SQL, PAIRS_SQL, STATE_CODES, US_STATES, businesses, ids, pairs, table, truth
from kinfold.sources import tables as io
from kinfold.sources.storage import materialize, scratch_path


def clean(spark: SparkSession, d: str) -> DataFrame:
    """Normalised records as a table: many branches read them."""
    return materialize(nm.normalize_records(businesses(spark, d)))


def sixth(df: DataFrame) -> DataFrame:
    """``df`` with its doubles rounded to six places."""
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])


# ---- kernels -----------------------------------------------------------------------------------------------------

SOURCE = "src AS (SELECT p_partkey, p_name AS a, lower(p_type) || ' ' || p_name AS b FROM part)"


@query(f"SELECT p_partkey, {', '.join(f'round({k}, 6) AS {k}' for k in ks.KERNELS)} FROM src JOIN ({ks.measured('src', {k: k for k in ks.KERNELS})}) USING (a, b)", (SOURCE,))
def sim_name_kernels(spark: SparkSession, d: str) -> DataFrame:
    from kinfold.functions.similarity import similarities

    p = table(spark, d, "part").withColumn("other", F.concat_ws(" ", F.lower("p_type"), "p_name"))
    p = p.withColumn("s", similarities({k: (k, F.col("p_name"), F.col("other")) for k in ks.KERNELS}))
    return p.select("p_partkey", *[F.round(f"s.{k}", 6).alias(k) for k in ks.KERNELS])


TRADE_TEXTS = "texts AS (SELECT s1_id, cand_id, lower(c_name) AS a, lower(s_name) AS b FROM pairs JOIN customer ON s1_id = 'S1-' || c_custkey JOIN supplier ON substr(cand_id, 4) = CAST(s_suppkey AS VARCHAR))"


@query(f"SELECT s1_id, cand_id, round(s / 100, 6) AS p_ce FROM texts JOIN ({ks.measured('texts', {'s': 'token_set'})}) USING (a, b)", (PAIRS_SQL, TRADE_TEXTS))
def model_pair_scorer(spark: SparkSession, d: str) -> DataFrame:
    """The plug-in slot, with a string similarity as the model."""
    from kinfold.functions.similarity import token_set_ratio

    texts = table(spark, d, "customer").select(F.concat(F.lit("S1-"), "c_custkey").alias("entity_id"), F.lower("c_name").alias("text"))
    s = table(spark, d, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "S2-").otherwise("S3-"), "s_suppkey").alias("entity_id"), F.lower("s_name").alias("text"))
    scorer = lambda a, b: [token_set_ratio(x, y) / 100 for x, y in zip(a, b)]
    return sixth(md.score_pairs_with(pairs(spark, d).select("s1_id", "cand_id"), texts.unionByName(s), scorer))


# ---- pairs of businesses -----------------------------------------------------------------------------------------

OFFSETS = (1, 2, 4, 5)
CLOSE_SQL = f"""near AS (SELECT 'S1-' || a.p_partkey AS s1_id, CASE o % 3 WHEN 1 THEN 'S2-' ELSE 'S3-' END || b.p_partkey AS cand_id, CASE o % 3 WHEN 1 THEN 'S2' ELSE 'S3' END AS cand_source
  FROM part a CROSS JOIN (VALUES {", ".join(f"({o})" for o in OFFSETS)}) AS t(o) JOIN part b ON b.p_partkey = a.p_partkey + o WHERE a.p_partkey % 3 = 0)"""


def close_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every S1 business with the S2 and S3 ones of the next keys: every business is in a pair."""
    k = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    a = k.where("k % 3 = 0").select(F.concat(F.lit("S1-"), "k").alias("s1_id"), F.explode(F.array(*[F.struct(F.lit(o).alias("o"), (F.col("k") + o).alias("k")) for o in OFFSETS])).alias("x"))
    source = F.when(F.col("o") % 3 == 1, "S2").otherwise("S3")
    return a.select("s1_id", "x.o", "x.k").join(k, "k").select("s1_id", F.concat(source, F.lit("-"), "k").alias("cand_id"), source.alias("cand_source"))


TRI = "CAST(CASE WHEN {0} = '' OR {1} = '' THEN -1 WHEN {0} = {1} THEN 1 ELSE 0 END AS TINYINT)"
RECORD = ["name_norm", "name_core", "name_alias", "name_legal", "name_initials", "addr_norm", "addr_state", "addr_city", "addr_numbers", "addr_missing"]
FREQ_SQL = """freq AS (SELECT c.*, coalesce(n.f, 0) AS nf, coalesce(l.f, 0) AS lf FROM clean c LEFT JOIN (SELECT name_core, count(*) AS f FROM clean WHERE source <> 'S1' GROUP BY name_core) n ON c.name_core = n.name_core
  LEFT JOIN (SELECT addr_numbers, addr_city, count(*) AS f FROM clean WHERE source <> 'S1' AND addr_numbers <> '' GROUP BY ALL) l ON c.addr_numbers = l.addr_numbers AND c.addr_city = l.addr_city AND c.addr_numbers <> '')"""
SIDES_SQL = (
    "sides AS (SELECT s1_id, cand_id, cand_source, "
    + ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in RECORD)
    + ", a.nf AS a_nf, b.nf AS b_nf, a.lf AS a_lf, b.lf AS b_lf, replace(a.name_core, ' ', '') AS a_glued, replace(b.name_core, ' ', '') AS b_glued, "
    + "coalesce(string_split(a.addr_numbers, ' ')[-1], '') AS a_last, coalesce(string_split(b.addr_numbers, ' ')[-1], '') AS b_last FROM near JOIN freq a ON s1_id = a.entity_id JOIN freq b ON cand_id = b.entity_id)"
)
#: Name of a table of kernels: columns compared, kernels by feature.
MEASURES = {
    "m_core": ("a_name_core", "b_name_core", {"core_ratio": "ratio", "core_tsort": "token_sort", "core_tset": "token_set", "core_partial": "partial", "core_jw": "jaro_winkler"}),
    "m_norm": ("a_name_norm", "b_name_norm", {"norm_ratio": "ratio", "norm_tset": "token_set"}),
    "m_glued": ("a_glued", "b_glued", {"nospace_ratio": "ratio"}),
    "m_ab": ("a_name_core", "b_name_alias", {"kf_ab": "token_set"}),
    "m_ba": ("a_name_alias", "b_name_core", {"kf_ba": "token_set"}),
    "m_addr": ("a_addr_norm", "b_addr_norm", {"addr_tset": "token_set", "addr_tsort": "token_sort", "addr_partial": "partial_token_set"}),
    "m_num": ("a_addr_numbers", "b_addr_numbers", {"num_tset": "token_set", "num_ptset": "partial_token_set"}),
    "m_last": ("a_last", "b_last", {"kf_nr": "ratio"}),
    "m_city": ("a_addr_city", "b_addr_city", {"city_ratio": "ratio"}),
}
MEASURED_SQL = ", ".join(f"{n} AS ({ks.measured(f'(SELECT {a} AS a, {b} AS b FROM sides)', k)})" for n, (a, b, k) in MEASURES.items())
WIDE_SQL = "wide AS (SELECT sides.*, " + ", ".join(c for _, _, k in MEASURES.values() for c in k) + " FROM sides " + " ".join(f"JOIN {n} ON {n}.a = {a} AND {n}.b = {b}" for n, (a, b, _) in MEASURES.items()) + ")"
BEST_SQL = """best AS (SELECT *, greatest(CASE WHEN b_name_alias <> '' THEN kf_ab ELSE 0.0 END, CASE WHEN a_name_alias <> '' THEN kf_ba ELSE 0.0 END) AS alias_best FROM wide),
named AS (SELECT *, greatest(core_tsort, alias_best, nospace_ratio) AS name_best FROM best),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY name_best + addr_tset DESC, cand_id) AS r FROM named),
anch AS (SELECT x.*, y.name_best + y.addr_tset AS q, y.b_name_core AS y_core, y.b_addr_norm AS y_addr, y.b_addr_numbers AS y_num FROM ranked x LEFT JOIN ranked y ON x.s1_id = y.s1_id AND y.r = CASE WHEN x.r = 1 THEN 2 ELSE 1 END)"""
SUPPORT_SQL = ", ".join(f"{n} AS ({ks.measured(f'(SELECT {a} AS a, {b} AS b FROM anch WHERE q IS NOT NULL)', {c: 'token_set'})})" for n, a, b, c in (("s_n", "b_name_core", "y_core", "sn"), ("s_a", "b_addr_norm", "y_addr", "sa_"), ("s_u", "b_addr_numbers", "y_num", "su")))
FEATURES = {
    **{c: f"round({c}, 6)" for _, _, k in MEASURES.values() for c in k if not c.startswith("kf_")},
    **{c: f"round({c}, 6)" for c in ("alias_best", "name_best")},
    "cand_is_s3": "CAST(cand_source = 'S3' AS INTEGER)",
    "core_exact": "CAST(a_name_core = b_name_core AS INTEGER)",
    "initials_hit": "CAST((a_name_initials = b_glued AND a_name_initials <> '') OR (b_name_initials = a_glued AND b_name_initials <> '') AS INTEGER)",
    "legal_eq": TRI.format("a_name_legal", "b_name_legal"),
    "core_len_a": "length(a_name_core)",
    "core_len_b": "length(b_name_core)",
    "any_translit": "0",
    "core_freq_a": "round(ln(1 + a_nf), 6)",
    "core_freq_b": "round(ln(1 + b_nf), 6)",
    "addr_missing_b": "CAST(b_addr_missing AS INTEGER)",
    "addr_missing_any": "CAST(a_addr_missing OR b_addr_missing AS INTEGER)",
    "num_exact": TRI.format("a_addr_numbers", "b_addr_numbers"),
    "num_max_eq": TRI.format("a_last", "b_last"),
    "num_max_ratio": "CASE WHEN a_last <> '' AND b_last <> '' THEN round(kf_nr, 6) ELSE -1.0 END",
    "city_eq": TRI.format("a_addr_city", "b_addr_city"),
    "state_eq": TRI.format("a_addr_state", "b_addr_state"),
    "addr_freq_a": "round(ln(1 + a_lf), 6)",
    "addr_freq_b": "round(ln(1 + b_lf), 6)",
    "sup_is_top": "CAST(r = 1 AS INTEGER)",
    "sup_anchor_q": "coalesce(round(q, 6), -1.0)",
    "sup_name": "coalesce(round(sn, 6), -1.0)",
    "sup_addr": "coalesce(round(sa_, 6), -1.0)",
    "sup_num": "coalesce(round(su, 6), -1.0)",
}


@query(
    f"SELECT s1_id, cand_id, cand_source, {', '.join(f'{e} AS {c}' for c, e in FEATURES.items())} FROM anch LEFT JOIN s_n ON s_n.a = b_name_core AND s_n.b = y_core LEFT JOIN s_a ON s_a.a = b_addr_norm AND s_a.b = y_addr LEFT JOIN s_u ON s_u.a = b_addr_numbers AND s_u.b = y_num",
    (CLEAN_SQL, CLOSE_SQL, FREQ_SQL, SIDES_SQL, MEASURED_SQL, WIDE_SQL, BEST_SQL, SUPPORT_SQL),
)
def sim_pair_features(spark: SparkSession, d: str) -> DataFrame:
    done = clean(spark, d)
    done = lk.add_frequencies(done, done.where("source <> 'S1'"))
    return sixth(ft.pair_features(close_pairs(spark, d), done))


@query("SELECT s1_id, cand_id, cand_source, a.name_core AS a_core, a.addr_norm AS a_addr, b.name_core AS b_core, b.addr_numbers AS b_numbers FROM near JOIN clean a ON s1_id = a.entity_id JOIN clean b ON cand_id = b.entity_id", (CLEAN_SQL, CLOSE_SQL))
def join_pair_records(spark: SparkSession, d: str) -> DataFrame:
    both = ft.pair_records(close_pairs(spark, d), nm.normalize_records(businesses(spark, d)))
    return both.select("s1_id", "cand_id", "cand_source", F.col("a.name_core").alias("a_core"), F.col("a.addr_norm").alias("a_addr"), F.col("b.name_core").alias("b_core"), F.col("b.addr_numbers").alias("b_numbers"))


WORDS_SQL = f"""idf AS (SELECT token, ln((any_value(n) + 1.0) / (count(*) + 1.0)) AS idf FROM (SELECT DISTINCT entity_id, unnest(string_split(name_core, ' ')) AS token FROM clean), (SELECT count(*) AS n FROM clean) GROUP BY token),
cores AS (SELECT s1_id, cand_id, a.name_core AS ca, b.name_core AS cb FROM near JOIN clean a ON s1_id = a.entity_id JOIN clean b ON cand_id = b.entity_id),
own AS (SELECT s1_id, cand_id, 'a' AS side, unnest(string_split(ca, ' ')) AS t, cb AS other FROM cores UNION ALL SELECT s1_id, cand_id, 'b', unnest(string_split(cb, ' ')), ca FROM cores),
met AS (SELECT DISTINCT t AS a, u AS b FROM (SELECT t, unnest(string_split(other, ' ')) AS u FROM own)),
close AS (SELECT a, b FROM ({ks.measured('met', {'s': 'ratio'})}) WHERE a = b OR (length(a) > 3 AND s >= 80)),
lone AS (SELECT o.* FROM own o WHERE NOT EXISTS (SELECT 1 FROM close WHERE a = o.t AND list_contains(string_split(o.other, ' '), b)))"""


@query(
    """SELECT n.s1_id, n.cand_id, count(*) FILTER (side = 'a') AS wd_n_a, count(*) FILTER (side = 'b') AS wd_n_b, round(coalesce(max(idf) FILTER (side = 'a'), 0), 6) AS wd_maxidf_a, round(coalesce(max(idf) FILTER (side = 'b'), 0), 6) AS wd_maxidf_b,
       round(coalesce(sum(idf), 0), 6) AS wd_sumidf FROM near n LEFT JOIN (SELECT l.*, i.idf FROM lone l JOIN idf i ON l.t = i.token) x ON n.s1_id = x.s1_id AND n.cand_id = x.cand_id GROUP BY n.s1_id, n.cand_id""",
    (CLEAN_SQL, CLOSE_SQL, WORDS_SQL),
)
def sim_word_features(spark: SparkSession, d: str) -> DataFrame:
    done = clean(spark, d)
    return sixth(ft.word_features(close_pairs(spark, d), done, lk.token_idf(done)))


RAW_SQL = """spelled AS (SELECT (CASE k % 3 WHEN 0 THEN 'S1-' WHEN 1 THEN 'S2-' ELSE 'S3-' END) || k AS entity_id, lower(p_name || ' ' || kind || CASE WHEN k % 3 = 2 THEN ' & sons private limited #00' ELSE ' & sons pvt. ltd. #00' END || k || CASE WHEN k % 7 = 0 THEN ' formerly known as ' || kind || ' workshop' ELSE '' END) AS raw FROM raw_parts),
judged AS (SELECT s1_id, cand_id, x.raw AS ra, y.raw AS rb, a.name_norm AS na, b.name_norm AS nb, a.addr_norm AS aa, b.addr_norm AS ab, a.addr_state AS sa1, b.addr_state AS sb1, string_split(a.addr_numbers, ' ') AS ua, string_split(b.addr_numbers, ' ') AS ub, a.addr_numbers <> '' AND b.addr_numbers <> '' AS counted
  FROM near JOIN clean a ON s1_id = a.entity_id JOIN clean b ON cand_id = b.entity_id JOIN spelled x ON x.entity_id = s1_id JOIN spelled y ON y.entity_id = cand_id)"""
AUDIT_SQL = RAW_SQL + f""", k_raw AS ({ks.measured('(SELECT ra AS a, rb AS b FROM judged)', {'v': 'ratio'})}), k_norm AS ({ks.measured('(SELECT na AS a, nb AS b FROM judged)', {'v': 'ratio'})}), k_addr AS ({ks.measured('(SELECT aa AS a, ab AS b FROM judged)', {'v': 'token_set'})})"""


@query(
    """SELECT count(*) AS n, round(avg(k_raw.v), 3) AS raw, round(avg(k_norm.v), 3) AS norm, round(avg(k_addr.v), 3) AS addr, round(avg(CASE WHEN sa1 <> '' AND sb1 <> '' THEN CAST(sa1 = sb1 AS DOUBLE) END), 3) AS state_eq,
       round(avg(CASE WHEN counted THEN CAST(len(list_intersect(ua, ub)) > 0 AS DOUBLE) END), 3) AS number_overlap
       FROM judged JOIN k_raw ON k_raw.a = ra AND k_raw.b = rb JOIN k_norm ON k_norm.a = na AND k_norm.b = nb JOIN k_addr ON k_addr.a = aa AND k_addr.b = ab""",
    (CLEAN_SQL, CLOSE_SQL, AUDIT_SQL),
)
def report_normalisation_audit(spark: SparkSession, d: str) -> DataFrame:
    return mt.normalisation_audit(close_pairs(spark, d), clean(spark, d))


# ---- retrieval ---------------------------------------------------------------------------------------------------

NEXT_STATES = [(US_STATES[a], US_STATES[b]) for x, y in zip(STATE_CODES, STATE_CODES[1:]) for a, b in ((x, y), (y, x))]
NEXT_SQL = "adjacent AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in NEXT_STATES) + ") AS t(st, nb))"
GRAMS = "(SELECT entity_id, substr(' ' || w || ' ', CAST(i AS INTEGER), 3) AS term FROM (SELECT entity_id, unnest(string_split(name_norm, ' ')) AS w FROM {t}), LATERAL (SELECT unnest(range(1, greatest(length(w), 1) + 1)) AS i))"
WORDS = "(SELECT entity_id, unnest(list_filter(string_split(addr_norm, ' '), lambda w: w <> '')) AS term FROM {t})"


def _postings_sql(name: str, terms: str, pool: str, weight: float, low: int, high: float) -> str:
    """CTEs <name>_q and <name>_p (entity_id, term, w): postings of the queries and of the pool by the pool's statistics."""
    tf = lambda t: f"SELECT entity_id, term, 1 + ln(count(*)) AS tf FROM {terms.format(t=t)} GROUP BY ALL"
    unit = lambda t: f"(SELECT entity_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) * sqrt({weight}) AS w FROM (SELECT entity_id, term, tf * idf AS w FROM ({tf(t)}) JOIN {name}_i USING (term)))"
    size = f"(SELECT count(*) AS n FROM {pool})"
    return f"{name}_i AS (SELECT term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM ({tf(pool)}), {size} GROUP BY term HAVING count(*) >= {low} AND count(*) <= {high} * any_value(n)), {name}_p AS {unit(pool)}, {name}_q AS {unit('asking')}"


def _blocked_sql(neighbors: bool, addr_k: int, both_k: int) -> str:
    more = " UNION SELECT entity_id, nb FROM asking JOIN adjacent ON addr_state = st" if neighbors else ""
    out = ["asking AS (SELECT * FROM clean WHERE source = 'S1')", f"seeks AS (SELECT entity_id, unnest(CASE WHEN addr_state = '' THEN ['*'] ELSE [addr_state, ''] END) AS block FROM asking{more})"]
    for s in ("S2", "S3"):
        pool = f"pool{s}"
        out += [f"{pool} AS (SELECT * FROM clean WHERE source = '{s}')", f"stands{s} AS (SELECT entity_id, unnest([addr_state, '*']) AS block FROM {pool})"]
        out += [_postings_sql(f"aw{s}", WORDS, pool, 1.0, 1, 0.2), _postings_sql(f"bn{s}", GRAMS, pool, 0.6, 2, 1.0), _postings_sql(f"ba{s}", WORDS, pool, 0.4, 1, 0.2)]
        out.append(f"open{s} AS (SELECT q.entity_id AS s1_id, p.entity_id AS cand_id FROM seeks q JOIN stands{s} p USING (block))")
        dot = lambda n: f"SELECT q.entity_id AS s1_id, p.entity_id AS cand_id, q.w * p.w AS s FROM {n}_q q JOIN {n}_p p USING (term)"
        for path, fields, k in (("addr", [f"aw{s}"], addr_k), ("both", [f"bn{s}", f"ba{s}"], both_k)):
            total = f"SELECT s1_id, cand_id, round(sum(s), 9) AS score FROM ({' UNION ALL '.join(map(dot, fields))}) SEMI JOIN open{s} USING (s1_id, cand_id) GROUP BY ALL"
            out.append(f"{path}{s} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank FROM ({total})) WHERE rank <= {k})")
        out.append(
            f"found{s} AS (SELECT coalesce(a.s1_id, b.s1_id) AS s1_id, coalesce(a.cand_id, b.cand_id) AS cand_id, coalesce(a.score, 0) AS addr_score, coalesce(a.rank, 0) AS addr_rank, coalesce(b.score, 0) AS both_score, coalesce(b.rank, 0) AS both_rank, "
            f"CAST(a.rank IS NOT NULL AS INTEGER) + CAST(b.rank IS NOT NULL AS INTEGER) AS n_paths, '{s}' AS cand_source FROM addr{s} a FULL JOIN both{s} b ON a.s1_id = b.s1_id AND a.cand_id = b.cand_id)"
        )
    return ", ".join(out)


FOUND = "SELECT s1_id, cand_id, round(addr_score, 6) AS addr_score, addr_rank, round(both_score, 6) AS both_score, both_rank, n_paths, cand_source FROM (SELECT * FROM foundS2 UNION ALL SELECT * FROM foundS3)"


@query(FOUND, (CLEAN_SQL, _blocked_sql(False, 10, 20)))
def retrieve_blocked_candidates(spark: SparkSession, d: str) -> DataFrame:
    done = clean(spark, d)
    pools = {s: done.where(F.col("source") == s) for s in ("S2", "S3")}
    return sixth(rt.generate_candidates(done.where("source = 'S1'"), pools))


@query(FOUND, (CLEAN_SQL, NEXT_SQL, _blocked_sql(True, 3, 5)))
def retrieve_neighbor_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Queries search the states next to their own as well."""
    done = clean(spark, d)
    near = spark.createDataFrame(NEXT_STATES, "`from` string, `to` string")
    paths = tuple(rt.SearchPath(p.name, p.fields, k) for p, k in zip(rt.DEFAULT_PATHS, (3, 5)))
    pools = {s: done.where(F.col("source") == s) for s in ("S2", "S3")}
    return sixth(rt.generate_candidates(done.where("source = 'S1'"), pools, paths, near))


@query("SELECT entity_id, unnest(CASE WHEN addr_state = '' THEN ['*'] ELSE [addr_state, ''] END) AS block FROM clean UNION SELECT entity_id, nb FROM clean JOIN adjacent ON addr_state = st", (CLEAN_SQL, NEXT_SQL))
def retrieve_neighbor_keys(spark: SparkSession, d: str) -> DataFrame:
    near = spark.createDataFrame(NEXT_STATES, "`from` string, `to` string")
    return rt.block_keys(nm.normalize_records(businesses(spark, d)), near, True)


HELD_SQL = "held AS (SELECT item_id AS s1_id, doc_id AS cand_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
VARIANTS = [(0.2, 0), (0.05, 0), (0.05, 8)]


def _variant_sql(n: int, high: float, top: int) -> str:
    cut = f"(SELECT id, term, w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, term) AS r FROM v{n}_qw) WHERE {top} = 0 OR r <= {top})"
    return f"""v{n}_i AS (SELECT term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM tf, n GROUP BY term HAVING count(*) <= {high} * any_value(n)),
v{n}_p AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, term, tf * idf AS w FROM tf JOIN v{n}_i USING (term))),
v{n}_qw AS (SELECT id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM qt JOIN v{n}_i USING (term) GROUP BY id, term),
v{n}_q AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {cut}),
v{n}_r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS r FROM (SELECT q.id AS s1_id, p.id AS cand_id, round(sum(q.w * p.w), 6) AS score FROM v{n}_q q JOIN v{n}_p p USING (term) GROUP BY ALL)) WHERE r <= 10),
v{n} AS (SELECT 'max_df={high},query_top={top}' AS variant, k, round(avg(CASE WHEN r <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (held LEFT JOIN v{n}_r USING (s1_id, cand_id)) CROSS JOIN (VALUES (1), (10)) AS g(k) GROUP BY k),
v{n}_s AS (SELECT k, round(count(*) / count(DISTINCT s1_id), 6) AS per_query FROM v{n}_r JOIN (VALUES (1), (10)) AS g(k) ON r <= k GROUP BY k)"""


def _sweep_views() -> tuple[str, ...]:
    base = TFIDF_SQL[: TFIDF_SQL.index("idf AS")].rstrip().rstrip(",")
    asked = "qt AS (SELECT item_id AS id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS term FROM benchmark)"
    return (HELD_SQL, base, asked, *[_variant_sql(n, *v) for n, v in enumerate(VARIANTS)])


def passage_holders(spark: SparkSession, d: str) -> DataFrame:
    """(s1_id, cand_id): the documents that hold a benchmark passage. A passage's second to fourth words, whole ones
    wherever it begins, are looked up among the three-word windows of the texts; only hits are compared in full."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("s1_id"), F.col("text").alias("passage"))
    key = lambda w, i: F.array_join(F.slice(w, i, 3), " ")
    asked = b.withColumn("w", F.split("passage", r"\s+")).where(F.size("w") > 4).select("s1_id", "passage", key(F.col("w"), 2).alias("key"))
    docs = io.spread(table(spark, d, "documents").where("text is not null")).select(F.col("doc_id").alias("cand_id"), "text", F.split("text", r"\s+").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1)))
    windows = docs.select("cand_id", F.explode(F.array_distinct(F.transform(starts, lambda i: key(F.col("w"), i)))).alias("key"))
    hits = windows.join(asked, "key").select("cand_id", "s1_id", "passage")
    return docs.join(hits, "cand_id").where(F.contains("text", "passage")).select("s1_id", "cand_id").distinct()


@query(" UNION ALL ".join(f"SELECT v{n}.variant, k, recall, per_query FROM v{n} JOIN v{n}_s USING (k)" for n in range(len(VARIANTS))), _sweep_views())
def retrieve_path_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Recall and candidates of the benchmark search under tighter settings."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), "text")
    docs = io.spread(table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), "text"))
    variants = {f"max_df={m},query_top={t}": rt.SearchPath("word", (rt.Field("text", max_df=m, query_top=t),), 10) for m, t in VARIANTS}
    return rt.sweep_paths(q, docs, materialize(passage_holders(spark, d)), variants, [1, 10])


@query(
    """SELECT id AS doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, term) AS r FROM (SELECT id, term, w FROM pw)) WHERE r <= 5""",
    (TFIDF_SQL,),
)
def window_query_top(spark: SparkSession, d: str) -> DataFrame:
    pool = io.spread(table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), "text"))
    tf = materialize(rt.term_weights(pool, WORD_PATH.fields[0], ()))
    top = rt.postings(tf, rt.fit_idf(pool, tf, WORD_PATH.fields[0], ()), WORD_PATH.fields[0], (), top=5)
    return top.select(F.col("entity_id").alias("doc_id"), "term", F.round("w", 6).alias("w"))


# ---- decisions and reports ---------------------------------------------------------------------------------------

STRESSED_SQL = """scored AS (SELECT 'normal' AS kind, s1_id, cand_id, p, p_ce FROM pairs UNION ALL SELECT 'stress', s1_id, cand_id, p, p_ce FROM pairs
  UNION ALL SELECT 'stress', s1_id, cand_id || '_dup0', p, p_ce FROM pairs WHERE label = 0 AND {hard} > 0.3)"""


def _sweep_sql(methods: dict[str, str], thresholds: tuple[float, ...]) -> str:
    """CTE swept (kind, method, threshold, f05) from scored."""
    long = " UNION ALL ".join(f"SELECT kind, s1_id, cand_id, '{n}' AS method, {e} AS s FROM scored" for n, e in methods.items())
    grid = "SELECT method, threshold FROM (VALUES " + ", ".join(f"('{n}')" for n in methods) + ") AS a(method), (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in thresholds) + ") AS b(threshold)"
    return f"""lng AS ({long}), grid AS ({grid}),
kept AS (SELECT kind, method, threshold, s1_id, cand_id FROM (SELECT *, max(s) OVER (PARTITION BY kind, method, cand_id) AS m FROM lng) JOIN grid USING (method) WHERE s >= m AND s >= threshold),
cnt AS (SELECT k.kind, k.method, k.threshold, k.s1_id, count(*) AS n, count(t.s1_id) AS tp FROM kept k LEFT JOIN truth t ON k.s1_id = t.s1_id AND k.cand_id = t.cand_id GROUP BY ALL),
swept AS (SELECT kind, method, threshold, round(avg({F05}), 6) AS f05 FROM (SELECT w.kind, g.method, g.threshold, coalesce(t.n, 0) AS n_true, coalesce(c.n, 0) AS n_pred, coalesce(c.tp, 0) AS tp FROM ids i CROSS JOIN grid g CROSS JOIN (VALUES ('normal'), ('stress')) AS w(kind)
  LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY s1_id) t ON i.s1_id = t.s1_id LEFT JOIN cnt c ON c.kind = w.kind AND c.s1_id = i.s1_id AND c.method = g.method AND c.threshold = g.threshold) GROUP BY ALL),
two AS (SELECT a.method, a.threshold, a.f05 AS normal, b.f05 AS stress FROM swept a JOIN swept b ON a.method = b.method AND a.threshold = b.threshold WHERE a.kind = 'normal' AND b.kind = 'stress')"""


@query("SELECT threshold, normal, stress, (SELECT max(normal) FROM two) AS best_normal FROM two WHERE normal >= (SELECT max(normal) FROM two) - 0.0005 ORDER BY stress DESC, threshold LIMIT 1", (*JUDGED, STRESSED_SQL.format(hard="p"), _sweep_sql({"p": "p"}, dc.THRESHOLDS)))
def decide_tuned_threshold(spark: SparkSession, d: str) -> DataFrame:
    return dc.tune(pairs(spark, d), "p", ids(spark, d), truth(spark, d))


RULE_SQL = _sweep_sql({"lgbm": "p", "ce": "p_ce", "blend0.7": "0.7 * p_ce + (1 - 0.7) * p"}, (0.5, 0.7, 0.9))
RULES = (*JUDGED, STRESSED_SQL.format(hard="greatest(p, p_ce)"), RULE_SQL)


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return materialize(dc.rule_table(methods(spark, d), METHODS, (0.5, 0.7, 0.9), ["p", "p_ce"], ids(spark, d), truth(spark, d)))


@query("SELECT method, threshold, normal, stress FROM two WHERE normal >= (SELECT max(normal) FROM two WHERE method = 'lgbm') - 0.0005 ORDER BY stress DESC, method, threshold LIMIT 1", RULES)
def decide_rule(spark: SparkSession, d: str) -> DataFrame:
    return dc.choose_rule(_rules(spark, d)).select("method", "threshold", "normal", "stress")


@query("SELECT method, threshold, normal, stress FROM two WHERE method = 'ce' AND threshold = 0.9", RULES)
def decide_forced_rule(spark: SparkSession, d: str) -> DataFrame:
    return dc.choose_rule(_rules(spark, d), force=("ce", 0.9)).select("method", "threshold", "normal", "stress")


VARIANT_SQL = """owned AS (SELECT *, max(p) OVER (PARTITION BY cand_id) AS m FROM pairs), pred AS (SELECT s1_id, cand_id FROM owned WHERE p >= m AND p >= 0.7), hits AS (SELECT s1_id, cand_id FROM pred INTERSECT SELECT s1_id, cand_id FROM truth),
chosen AS (SELECT 'current' AS variant, * FROM pred UNION SELECT 'no_false_matches', * FROM hits UNION SELECT 'misses_recovered', * FROM hits UNION SELECT 'misses_recovered', s1_id, cand_id FROM pairs WHERE label = 1 AND p < 0.7
  UNION SELECT 'perfect_on_candidates', s1_id, cand_id FROM pairs WHERE label = 1 UNION SELECT 'perfect', * FROM truth UNION SELECT 'singletons_empty', * FROM pred WHERE s1_id IN (SELECT s1_id FROM truth)),
each AS (SELECT v.variant, i.s1_id, coalesce(t.n, 0) AS n_true, coalesce(c.n, 0) AS n_pred, coalesce(c.tp, 0) AS tp FROM ids i CROSS JOIN (SELECT DISTINCT variant FROM chosen) v LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY s1_id) t ON t.s1_id = i.s1_id
  LEFT JOIN (SELECT m.variant, m.s1_id, count(*) AS n, count(t.s1_id) AS tp FROM chosen m LEFT JOIN truth t ON m.s1_id = t.s1_id AND m.cand_id = t.cand_id GROUP BY ALL) c ON c.variant = v.variant AND c.s1_id = i.s1_id)"""


@query(f"SELECT variant, round(avg({F05}), 6) AS f05 FROM each GROUP BY variant", (*JUDGED, VARIANT_SQL))
def report_oracle_variants(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return mt.oracle_variants(p, ids(spark, d), dc.decide(p, "p", 0.7), truth(spark, d), "p", 0.7)


OUTCOMES = """outcomes AS (SELECT coalesce(p.s1_id, t.s1_id) AS s1_id, coalesce(p.cand_id, t.cand_id) AS cand_id, CASE WHEN p.s1_id IS NOT NULL AND t.s1_id IS NOT NULL THEN 'TP' WHEN p.s1_id IS NOT NULL THEN 'FP' WHEN c.s1_id IS NOT NULL THEN 'FN_scored' ELSE 'FN_missed' END AS outcome
  FROM (SELECT s1_id, cand_id FROM pairs WHERE p >= 0.7) p FULL JOIN truth t ON p.s1_id = t.s1_id AND p.cand_id = t.cand_id LEFT JOIN pairs c ON c.s1_id = coalesce(p.s1_id, t.s1_id) AND c.cand_id = coalesce(p.cand_id, t.cand_id))"""


@query("SELECT c_mktsegment AS country, outcome, count(*) AS n FROM outcomes JOIN customer ON s1_id = 'S1-' || c_custkey GROUP BY ALL", (*JUDGED, OUTCOMES))
def report_errors_by_country(spark: SparkSession, d: str) -> DataFrame:
    """The market segment stands for the country."""
    who = table(spark, d, "customer").select(F.concat(F.lit("S1-"), "c_custkey").alias("s1_id"), F.col("c_mktsegment").alias("country"))
    p = pairs(spark, d)
    return mt.errors_by(mt.error_breakdown(p.where("p >= 0.7"), truth(spark, d), p), who, "country")


@query(
    "SELECT x.s1_id, x.cand_id, change, c_name AS a_text, s_name AS b_text FROM (SELECT coalesce(o.s1_id, n.s1_id) AS s1_id, coalesce(o.cand_id, n.cand_id) AS cand_id, CASE WHEN o.s1_id IS NULL THEN 'added' ELSE 'dropped' END AS change FROM (SELECT * FROM pairs WHERE p >= 0.7) o FULL JOIN (SELECT * FROM pairs WHERE p_ce >= 0.6) n ON o.s1_id = n.s1_id AND o.cand_id = n.cand_id WHERE o.s1_id IS NULL OR n.s1_id IS NULL) x "
    "JOIN customer ON x.s1_id = 'S1-' || c_custkey JOIN supplier ON substr(x.cand_id, 4) = CAST(s_suppkey AS VARCHAR)",
    PAIRS,
)
def report_output_changes(spark: SparkSession, d: str) -> DataFrame:
    """Added and dropped pairs with the records behind them."""
    p = pairs(spark, d)
    c = table(spark, d, "customer").select(F.concat(F.lit("S1-"), "c_custkey").alias("entity_id"), F.col("c_name").alias("text"))
    s = table(spark, d, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "S2-").otherwise("S3-"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("text"))
    return mt.diff_context(mt.output_diff(p.where("p >= 0.7"), p.where("p_ce >= 0.6")), c.unionByName(s))


# ---- sinks, resumption, samples ----------------------------------------------------------------------------------


@query("SELECT s1_id, cand_id FROM pairs WHERE p >= 0.7", PAIRS)
def io_submission_file(spark: SparkSession, d: str) -> DataFrame:
    """A submission written as tab-separated text and read back as pairs."""
    path = scratch_path(spark)
    io.write_submission(ids(spark, d), pairs(spark, d).where("p >= 0.7"), path)
    return io.read_submission(spark, path)


@query("SELECT 'S1-' || c_custkey AS s1_id, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT s1_id, count(*) AS n FROM pairs WHERE p >= 0.9 GROUP BY s1_id) ON s1_id = 'S1-' || c_custkey", PAIRS)
def io_pairs_and_queries(spark: SparkSession, d: str) -> DataFrame:
    """Candidate counts of every query, those without a candidate too, from the two written tables."""
    path = scratch_path(spark)
    io.write_pairs_and_queries(pairs(spark, d).where("p >= 0.9"), ids(spark, d), path)
    n = io.read_table(spark, f"{path}/pairs", ["s1_id", "cand_id"]).groupBy("s1_id").agg(F.count("*").alias("n"))
    return io.read_table(spark, f"{path}/queries").join(n, "s1_id", "left").fillna(0, ["n"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def io_replaced_table(spark: SparkSession, d: str) -> DataFrame:
    """A table that a first write made, a second one left alone and a third one replaced."""
    path, c = scratch_path(spark), table(spark, d, "customer")
    kept = [io.write_table(c, path), io.write_table(c.limit(0), path), io.write_table(c.where("c_mktsegment = 'BUILDING'"), path, overwrite=True)]
    if kept != [True, False, True]:
        raise AssertionError(kept)
    return io.read_table(spark, path, ["c_custkey", "c_name"])


@query("SELECT s1_id, cand_id, p_ce AS score FROM pairs", PAIRS)
def io_score_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a job in three parts that resumes after a half: the keyed parts make up the whole, without order."""
    path, p = scratch_path(spark), pairs(spark, d)
    work = materialize(p.select("s1_id", "cand_id", F.col("p_ce").alias("score")))
    done = work.where("score < 0.5")
    done.write.parquet(f"{path}/done")
    rest = spark.read.parquet(f"{path}/done")
    for k in range(3):
        rest = rest.unionByName(io.pending(work, done, ["s1_id", "cand_id"], k, 3))
    return rest


@query("SELECT unnest([0, 1, 2]) AS fold, unnest(['a', 'b', 'c']) AS name, 0.7::DOUBLE AS threshold")
def io_config(spark: SparkSession, d: str) -> DataFrame:
    """Settings written as JSON and read back."""
    path = f"{scratch_path(spark)}/config.json"
    io.write_json(spark, {"names": ["a", "b", "c"], "threshold": 0.7}, path)
    back = io.read_json(spark, path)
    return spark.createDataFrame([(i, n, back["threshold"]) for i, n in enumerate(back["names"])], "fold int, name string, threshold double")


@query("SELECT count(*) AS n, count(DISTINCT p_partkey) AS keys, true AS spread FROM part")
def io_spread(spark: SparkSession, d: str) -> DataFrame:
    """A table of one small file, dealt over the cores."""
    p = io.spread(table(spark, d, "part"))
    enough = p.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    return p.agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("keys")).withColumn("spread", F.lit(enough))


@query("SELECT s1_id, CAST(('0x' || substr(md5(s1_id), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM ids", JUDGED)
def sample_group_folds(spark: SparkSession, d: str) -> DataFrame:
    return ids(spark, d).select("s1_id", sp.group_fold(F.col("s1_id"), 5).alias("fold"))
