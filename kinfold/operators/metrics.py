"""Match quality: F0.5 per entity, its mean over all entities, and breakdowns of errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.similarity import similarities

PAIR = ["s1_id", "cand_id"]


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """1.25 tp / (n_pred + 0.25 n_true); both empty give 1, one empty 0."""
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when((n_pred == 0) | (n_true == 0), 0.0).otherwise(1.25 * tp / (n_pred + 0.25 * n_true))


def macro_f05_by(pred: DataFrame, keys: Sequence[str], grid: Sequence[tuple], ids: DataFrame, truth: DataFrame) -> DataFrame:
    """(keys, f05): mean F0.5 over all ``ids`` (s1_id), for every tuple of key values in ``grid``. Predictions of each
    setting and entity are counted first, so what meets the ids is one row per entity and setting."""
    keys = list(keys)
    settings = None if not keys else F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, g)]) for g in grid])).alias("g")
    n_true = truth.distinct().groupBy("s1_id").agg(F.count("*").alias("n_true"))
    hit = pred.select(*keys, *PAIR).distinct().join(truth.distinct().withColumn("hit", F.lit(1)), PAIR, "left")
    counts = hit.groupBy(*keys, "s1_id").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    entities = ids.select("s1_id").distinct().join(n_true, "s1_id", "left").fillna(0, ["n_true"])
    each = entities.select("*", settings).select("s1_id", "n_true", "g.*") if keys else entities
    each = each.join(counts, [*keys, "s1_id"], "left").fillna(0, ["n_pred", "tp"])
    value = F.round(F.avg(f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))), 6).alias("f05")
    return each.groupBy(*keys).agg(value) if keys else each.agg(value)


def macro_f05(ids: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    return macro_f05_by(pred, [], [], ids, truth)


def entity_f05(ids: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, f05) of every entity."""
    n_true = truth.distinct().groupBy("s1_id").agg(F.count("*").alias("n_true"))
    hit = pred.select(*PAIR).distinct().join(truth.distinct().withColumn("hit", F.lit(1)), PAIR, "left")
    counts = hit.groupBy("s1_id").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    each = ids.select("s1_id").distinct().join(n_true, "s1_id", "left").join(counts, "s1_id", "left").fillna(0)
    return each.select("s1_id", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")).alias("f05"))


def error_breakdown(pred: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1_id, cand_id, outcome): TP, FP, FN_scored (a candidate that was turned down) or FN_missed (never retrieved)."""
    p, t, c = pred.select(*PAIR).distinct(), truth.select(*PAIR).distinct(), candidates.select(*PAIR).distinct()
    both = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), PAIR, "full_outer").join(c.withColumn("c", F.lit(1)), PAIR, "left")
    outcome = F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), "TP").when(F.col("p").isNotNull(), "FP").when(F.col("c").isNotNull(), "FN_scored").otherwise("FN_missed")
    return both.select(*PAIR, outcome.alias("outcome"))


def errors_by(outcomes: DataFrame, ids: DataFrame, by: str) -> DataFrame:
    """(by, outcome, n): outcomes of :func:`error_breakdown` by a column of ``ids`` (s1_id, by)."""
    return outcomes.join(ids, "s1_id").groupBy(by, "outcome").agg(F.count("*").alias("n"))


def diff_context(diff: DataFrame, texts: DataFrame) -> DataFrame:
    """(s1_id, cand_id, change, a_text, b_text): added and dropped pairs with the texts (entity_id, text) of both sides."""
    side = lambda i, c: texts.select(F.col("entity_id").alias(i), F.col("text").alias(c))
    return diff.where("change <> 'kept'").join(side("s1_id", "a_text"), "s1_id").join(side("cand_id", "b_text"), "cand_id").select(*PAIR, "change", "a_text", "b_text")


def normalisation_audit(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """One row over ``pairs``: their number, mean similarity of names before (raw) and after normalisation (norm) and of
    addresses (addr), and how often states agree and numbers overlap where both sides have some."""
    side = lambda i, p: records.select(F.col("entity_id").alias(i), *[F.col(c).alias(f"{p}_{c}") for c in ("name_norm", "addr_norm", "addr_state", "addr_numbers")], F.lower(F.coalesce("business_name", F.lit(""))).alias(f"{p}_raw"))
    j = pairs.select(*PAIR).join(side("s1_id", "a"), "s1_id").join(side("cand_id", "b"), "cand_id")
    two = lambda kernel, c: (kernel, F.col(f"a_{c}"), F.col(f"b_{c}"))
    j = j.withColumn("s", similarities({"raw": two("ratio", "raw"), "norm": two("ratio", "name_norm"), "addr": two("token_set", "addr_norm")}))
    both = lambda c, hit: F.when((F.col(f"a_{c}") != "") & (F.col(f"b_{c}") != ""), hit.cast("double"))
    state = both("addr_state", F.col("a_addr_state") == F.col("b_addr_state"))
    shared = both("addr_numbers", F.arrays_overlap(F.split("a_addr_numbers", " "), F.split("b_addr_numbers", " ")))
    return j.agg(F.count("*").alias("n"), *[F.round(F.avg(f"s.{c}"), 3).alias(c) for c in ("raw", "norm", "addr")], F.round(F.avg(state), 3).alias("state_eq"), F.round(F.avg(shared), 3).alias("number_overlap"))


def output_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(s1_id, cand_id, change): kept, added or dropped between two outputs."""
    both = old.select(*PAIR).distinct().withColumn("o", F.lit(1)).join(new.select(*PAIR).distinct().withColumn("n", F.lit(1)), PAIR, "full_outer")
    return both.select(*PAIR, F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "dropped").otherwise("kept").alias("change"))


def match_profile(ids: DataFrame, matches: DataFrame, by: str) -> DataFrame:
    """(by, mean, share_0, share_6_up): matches per entity of ``ids`` (s1_id, by)."""
    n = matches.groupBy("s1_id").agg(F.count("*").alias("n"))
    each = ids.join(n, "s1_id", "left").fillna(0, ["n"])
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return each.groupBy(by).agg(F.round(F.avg("n"), 6).alias("mean_matches"), share(F.col("n") == 0).alias("share_0"), share(F.col("n") >= 6).alias("share_6_up"))


def oracle_variants(scored: DataFrame, ids: DataFrame, pred: DataFrame, truth: DataFrame, score: str, threshold: float) -> DataFrame:
    """(variant, f05): how good the output would be without false matches, with all retrieved misses, with a perfect
    choice among candidates, with the truth itself, and with entities that have no match left empty."""
    right = pred.join(truth, PAIR, "left_semi").select(*PAIR)
    low = scored.where((F.col("label") == 1) & (F.col(score) < threshold)).select(*PAIR)
    single = ids.join(truth, "s1_id", "left_anti")
    variants = {
        "current": pred.select(*PAIR),
        "no_false_matches": right,
        "misses_recovered": right.unionByName(low),
        "perfect_on_candidates": scored.where("label = 1").select(*PAIR),
        "perfect": truth.select(*PAIR),
        "singletons_empty": pred.join(single, "s1_id", "left_anti").select(*PAIR),
    }
    out = None
    for name, p in variants.items():
        one = p.withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return macro_f05_by(out, ["variant"], [(n,) for n in variants], ids, truth)
