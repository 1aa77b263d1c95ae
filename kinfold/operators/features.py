"""Features of candidate pairs: similarities, support by other candidates, standing within a query's candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.similarity import similarities, tri_state, unmatched_tokens

RECORD_COLUMNS = [
    "entity_id", "name_norm", "name_core", "name_alias", "name_initials", "name_legal", "name_translit", "addr_norm",
    "addr_state", "addr_city", "addr_numbers", "addr_missing", "name_core_freq", "addr_key_freq", "country_norm",
]
RETRIEVAL = ["addr_score", "addr_rank", "both_score", "both_rank", "n_paths"]


def pair_records(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``pairs`` with structs a and b: the records of s1_id and cand_id."""
    slim = records.select("entity_id", F.struct(*[c for c in RECORD_COLUMNS if c in records.columns]).alias("rec"))
    left = slim.select(F.col("entity_id").alias("s1_id"), F.col("rec").alias("a"))
    right = slim.select(F.col("entity_id").alias("cand_id"), F.col("rec").alias("b"))
    return pairs.join(left, "s1_id").join(right, "cand_id")


def pair_features(pairs: DataFrame, records: DataFrame, support: bool = True) -> DataFrame:
    """Keyed features of ``pairs`` (s1_id, cand_id, cand_source and retrieval columns); see the column list of README."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    glued = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    last = lambda x: F.element_at(F.split(x, " "), -1)
    df = pair_records(pairs, records)
    df = df.withColumns({"kf_ga": glued(a("name_core")), "kf_gb": glued(b("name_core")), "kf_na": last(a("addr_numbers")), "kf_nb": last(b("addr_numbers"))})
    two = lambda kernel, c: (kernel, a(c), b(c))
    wanted = {
        "core_ratio": two("ratio", "name_core"),
        "core_tsort": two("token_sort", "name_core"),
        "core_tset": two("token_set", "name_core"),
        "core_partial": two("partial", "name_core"),
        "core_jw": two("jaro_winkler", "name_core"),
        "norm_ratio": two("ratio", "name_norm"),
        "norm_tset": two("token_set", "name_norm"),
        "nospace_ratio": ("ratio", F.col("kf_ga"), F.col("kf_gb")),
        "kf_ab": ("token_set", a("name_core"), b("name_alias")),
        "kf_ba": ("token_set", a("name_alias"), b("name_core")),
        "addr_tset": two("token_set", "addr_norm"),
        "addr_tsort": two("token_sort", "addr_norm"),
        "addr_partial": two("partial_token_set", "addr_norm"),
        "num_tset": two("token_set", "addr_numbers"),
        "num_ptset": two("partial_token_set", "addr_numbers"),
        "kf_nr": ("ratio", F.col("kf_na"), F.col("kf_nb")),
        "city_ratio": two("ratio", "addr_city"),
    }
    df = df.withColumn("kf_s", similarities(wanted))
    df = df.select("*", *[F.col(f"kf_s.{n}").alias(n) for n in wanted]).drop("kf_s")
    alias = F.greatest(F.when(b("name_alias") != "", F.col("kf_ab")).otherwise(0.0), F.when(a("name_alias") != "", F.col("kf_ba")).otherwise(0.0))
    hit = ((a("name_initials") == F.col("kf_gb")) & (a("name_initials") != "")) | ((b("name_initials") == F.col("kf_ga")) & (b("name_initials") != ""))
    flag = lambda c: c.cast("int")
    df = df.withColumn("alias_best", alias).withColumns(
        {
            "cand_is_s3": flag(F.col("cand_source") == "S3"),
            "name_best": F.greatest("core_tsort", "alias_best", "nospace_ratio"),
            "core_exact": flag(a("name_core") == b("name_core")),
            "initials_hit": flag(hit),
            "legal_eq": tri_state(a("name_legal"), b("name_legal")),
            "core_len_a": F.length(a("name_core")),
            "core_len_b": F.length(b("name_core")),
            "any_translit": flag(a("name_translit") | b("name_translit")),
            "core_freq_a": F.log1p(a("name_core_freq").cast("double")),
            "core_freq_b": F.log1p(b("name_core_freq").cast("double")),
            "addr_missing_b": flag(b("addr_missing")),
            "addr_missing_any": flag(a("addr_missing") | b("addr_missing")),
            "num_exact": tri_state(a("addr_numbers"), b("addr_numbers")),
            "num_max_eq": tri_state(F.col("kf_na"), F.col("kf_nb")),
            "num_max_ratio": F.when((F.col("kf_na") != "") & (F.col("kf_nb") != ""), F.col("kf_nr")).otherwise(-1.0),
            "city_eq": tri_state(a("addr_city"), b("addr_city")),
            "state_eq": tri_state(a("addr_state"), b("addr_state")),
            "addr_freq_a": F.log1p(a("addr_key_freq").cast("double")),
            "addr_freq_b": F.log1p(b("addr_key_freq").cast("double")),
        }
    )
    if support:
        df = support_features(df.withColumns({"kf_bc": b("name_core"), "kf_bd": b("addr_norm"), "kf_bn": b("addr_numbers")}), "kf_bc", "kf_bd", "kf_bn")
    return df.drop("a", "b", *[c for c in df.columns if c.startswith("kf_")])


def anchors(df: DataFrame, quality: str, carry: list[str]) -> DataFrame:
    """``df`` plus sup_is_top and, as anchor.*, the ``carry`` columns and quality of the best other candidate of the same
    query: the first for all but itself, the second for the first. Ties by cand_id. No anchor, null."""
    group = Window.partitionBy("s1_id")
    ranked = df.withColumn("kf_r", F.row_number().over(group.orderBy(F.desc(quality), "cand_id")))
    keep = F.struct(F.col(quality).alias("q"), *[F.col(c).alias(c) for c in carry])
    at = lambda k: F.max(F.when(F.col("kf_r") == k, keep)).over(group)
    best = ranked.withColumns({"kf_1": at(1), "kf_2": at(2)})
    return best.withColumns({"sup_is_top": (F.col("kf_r") == 1).cast("int"), "anchor": F.when(F.col("kf_r") == 1, F.col("kf_2")).otherwise(F.col("kf_1"))}).drop("kf_r", "kf_1", "kf_2")


def support_features(df: DataFrame, core: str, addr: str, numbers: str) -> DataFrame:
    """Similarity of a candidate to the strongest other candidate of its query; -1 where there is none."""
    df = anchors(df.withColumn("kf_q", F.col("name_best") + F.col("addr_tset")), "kf_q", [core, addr, numbers])
    sims = similarities({"n": ("token_set", F.col(core), F.col(f"anchor.{core}")), "a": ("token_set", F.col(addr), F.col(f"anchor.{addr}")), "u": ("token_set", F.col(numbers), F.col(f"anchor.{numbers}"))})
    df = df.withColumn("kf_sup", sims)
    some = F.col("anchor").isNotNull()
    put = lambda c: F.when(some, c).otherwise(-1.0)
    out = df.withColumns({"sup_anchor_q": put(F.col("anchor.q")), "sup_name": put(F.col("kf_sup.n")), "sup_addr": put(F.col("kf_sup.a")), "sup_num": put(F.col("kf_sup.u"))})
    return out.drop("anchor", "kf_sup", "kf_q")


def standing(df: DataFrame, score: str, names: dict[str, str]) -> DataFrame:
    """Columns of a score's standing among a query's candidates. ``names`` picks from: rank (ties by cand_id), gap to the
    best, gap_src to the best of the same source, n_above 0.5, n candidates."""
    group = Window.partitionBy("s1_id")
    source = Window.partitionBy("s1_id", "cand_source")
    s = F.col(score)
    made = {
        "rank": F.row_number().over(group.orderBy(F.desc(score), "cand_id")),
        "gap": F.max(s).over(group) - s,
        "gap_src": F.max(s).over(source) - s,
        "n_above": F.sum((s > 0.5).cast("int")).over(group),
        "n": F.count("*").over(group),
    }
    return df.withColumns({out: made[kind] for kind, out in names.items()})


def group_features(df: DataFrame, score: str) -> DataFrame:
    return standing(df, score, {"rank": "g_rank_in_s1", "gap": "g_gap_to_best_s1", "n": "g_n_cands_s1", "n_above": "g_n_above_05_s1", "gap_src": "g_gap_to_best_same_src"})


def score_features(df: DataFrame, col: str) -> DataFrame:
    return standing(df, col, {"rank": f"{col}_rank", "gap": f"{col}_gap", "gap_src": f"{col}_gap_src", "n_above": f"{col}_n05"})


def stack_features(df: DataFrame, a: str = "p_lgbm", b: str = "p_ce") -> DataFrame:
    """Both scores, their product and differences, and the standing of each."""
    x, y = F.col(a), F.col(b)
    df = df.withColumns({"prod": x * y, "diff": x - y, "absdiff": F.abs(x - y), "cand_is_s3": F.col("cand_id").startswith("S3").cast("int")})
    df = df.withColumn("cand_source", F.when(F.col("cand_is_s3") == 1, "S3").otherwise("S2")) if "cand_source" not in df.columns else df
    for c in (a, b):
        df = standing(df, c, {"rank": f"rank_{c}", "gap": f"gap_{c}", "n_above": f"n_above_{c}", "gap_src": f"gap_src_{c}"})
    return standing(df, a, {"n": "n_cands"})


def word_features(pairs: DataFrame, records: DataFrame, idf: DataFrame, default: float = 12.0) -> DataFrame:
    """Words of either name without a counterpart in the other: counts, rarest and summed rarity. ``idf`` is a table
    (country_norm, token, idf); unknown tokens are as rare as ``default``."""
    df = pair_records(pairs.select("s1_id", "cand_id"), records)
    a, b = F.col("a.name_core"), F.col("b.name_core")
    df = df.select("s1_id", "cand_id", F.col("a.country_norm").alias("country_norm"), unmatched_tokens(a, b).alias("wa"), unmatched_tokens(b, a).alias("wb"))
    words = F.concat(F.transform("wa", lambda t: F.struct(F.lit("a").alias("side"), t.alias("token"))), F.transform("wb", lambda t: F.struct(F.lit("b").alias("side"), t.alias("token"))))
    each = df.select("s1_id", "cand_id", "country_norm", F.explode_outer(words).alias("w")).select("s1_id", "cand_id", "country_norm", "w.side", "w.token")
    each = each.join(idf, ["country_norm", "token"], "left").withColumn("idf", F.when(F.col("token").isNotNull(), F.coalesce("idf", F.lit(default))))
    side = lambda s, c: F.when(F.col("side") == s, c)
    most = lambda s: F.coalesce(F.max(side(s, F.col("idf"))), F.lit(0.0))
    return each.groupBy("s1_id", "cand_id").agg(
        F.count(side("a", F.lit(1))).alias("wd_n_a"), F.count(side("b", F.lit(1))).alias("wd_n_b"), most("a").alias("wd_maxidf_a"), most("b").alias("wd_maxidf_b"), F.coalesce(F.sum("idf"), F.lit(0.0)).alias("wd_sumidf")
    )
