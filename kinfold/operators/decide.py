"""From scores to matches: one owner per record, thresholds, stress copies, sweeps and choice rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.metrics import macro_f05_by

THRESHOLDS = tuple(round(0.30 + 0.05 * k, 2) for k in range(14))


def one_owner(scored: DataFrame, score: str) -> DataFrame:
    """Pairs whose query scores the record highest; tied owners all stay."""
    return scored.withColumn("kf_top", F.max(score).over(Window.partitionBy("cand_id"))).where(F.col(score) >= F.col("kf_top")).drop("kf_top")


def decide(scored: DataFrame, score: str, threshold: float, owner: bool = True) -> DataFrame:
    """(s1_id, cand_id) of the matches. Owners are judged on all scores, before the threshold."""
    kept = one_owner(scored, score) if owner else scored
    return kept.where(F.col(score) >= threshold).select("s1_id", "cand_id")


def stress_copy(scored: DataFrame, scores: Sequence[str], copies: int = 2) -> DataFrame:
    """Adds copies of hard negatives (no match, some score above 0.3) under new ids, so look-alikes are more common."""
    top = F.greatest(*[F.col(s) for s in scores]) if len(scores) > 1 else F.col(scores[0])
    hard = scored.where((F.col("label") == 0) & (top > 0.3))
    if copies < 2:
        return scored
    again = hard.withColumn("kf_r", F.explode(F.sequence(F.lit(0), F.lit(copies - 2)))).withColumn("cand_id", F.concat("cand_id", F.lit("_dup"), F.col("kf_r"))).drop("kf_r")
    return scored.unionByName(again)


def add_extra_scores(pairs: DataFrame, extra: Sequence[DataFrame], column: str = "p_ce") -> DataFrame:
    """Scores of other models as ce0, ce1, ...; missing ones stay null, and of repeated pairs the largest counts."""
    for i, e in enumerate(extra):
        one = e.groupBy("s1_id", "cand_id").agg(F.max(column).alias(f"ce{i}"))
        pairs = pairs.join(one, ["s1_id", "cand_id"], "left")
    return pairs


def require_scores(pairs: DataFrame, columns: Sequence[str], must: DataFrame | None = None) -> DataFrame:
    """Pairs of the queries for which no pair lacks one of the scores. Queries of ``must`` (s1_id), those of a validation
    split say, may not be among the dropped ones: that is an error."""
    lacks = F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0))
    marked = pairs.withColumn("kf_any", F.max(lacks).over(Window.partitionBy("s1_id")))
    if must is not None:
        lost = marked.where("kf_any = 1").join(must.select("s1_id"), "s1_id", "left_semi").select("s1_id").distinct().count()
        if lost:
            raise ValueError(f"{lost} queries that must stay lack a score")
    return marked.where("kf_any = 0").drop("kf_any")


def merge_scores(new: DataFrame, old: DataFrame) -> DataFrame:
    """Union of score tables; a pair in both keeps the new score."""
    return new.unionByName(old.join(new.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti").select(*new.columns))


def blend(a: str, b: str, weight: float):
    """weight * a + (1 - weight) * b"""
    return weight * F.col(a) + (1 - weight) * F.col(b)


def sweep(scored: DataFrame, methods: dict[str, str], thresholds: Sequence[float], ids: DataFrame, truth: DataFrame) -> DataFrame:
    """(method, threshold, f05): macro F0.5 with one owner for every method (name to score column) and threshold. One
    pass: scores are unpivoted, and every pair joins the thresholds that it passes."""
    long = scored.select("s1_id", "cand_id", F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).cast("double").alias("s")) for n, c in methods.items()])).alias("m")).select("s1_id", "cand_id", "m.method", "m.s")
    top = F.max("s").over(Window.partitionBy("method", "cand_id"))
    owned = long.withColumn("top", top).where("s >= top")
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    kept = owned.select("s1_id", "cand_id", "method", F.explode(F.filter(levels, lambda t: t <= F.col("s"))).alias("threshold"))
    return macro_f05_by(kept, ["method", "threshold"], [(n, float(t)) for n in methods for t in thresholds], ids, truth)


def tune(scored: DataFrame, score: str, ids: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS, slack: float = 0.0005) -> DataFrame:
    """One row: the threshold of best stress score among those within ``slack`` of the best normal score, lowest first."""
    normal = sweep(scored, {score: score}, thresholds, ids, truth).select("threshold", F.col("f05").alias("normal"))
    stress = sweep(stress_copy(scored, [score]), {score: score}, thresholds, ids, truth).select("threshold", F.col("f05").alias("stress"))
    few = Window.partitionBy(F.lit(0))  # one row per threshold
    best = normal.join(stress, "threshold").withColumn("best_normal", F.max("normal").over(few))
    return best.where(F.col("normal") >= F.col("best_normal") - slack).orderBy(F.desc("stress"), "threshold").limit(1)


def rule_table(scored: DataFrame, methods: dict[str, str], thresholds: Sequence[float], hard: Sequence[str], ids: DataFrame, truth: DataFrame) -> DataFrame:
    """(method, threshold, normal, stress): macro F0.5 on the scores and on their stress copy; ``hard`` are the scores
    that make a negative a hard one."""
    normal = sweep(scored, methods, thresholds, ids, truth).withColumnRenamed("f05", "normal")
    stress = sweep(stress_copy(scored, hard), methods, thresholds, ids, truth).withColumnRenamed("f05", "stress")
    return normal.join(stress, ["method", "threshold"])


def choose_rule(results: DataFrame, base: str = "lgbm", slack: float = 0.0005, force: tuple[str, float] | None = None) -> DataFrame:
    """One row of ``results`` (method, threshold, normal, stress): the best stress score among those within ``slack`` of
    the base method's best normal score; or the forced one."""
    if force:
        return results.where((F.col("method") == force[0]) & (F.abs(F.col("threshold") - force[1]) < 1e-8)).orderBy("method").limit(1)
    few = Window.partitionBy(F.lit(0))  # one row per method and threshold
    limit = F.max(F.when(F.col("method") == base, F.col("normal"))).over(few)
    return results.withColumn("base_normal", limit).where(F.col("normal") >= F.col("base_normal") - slack).orderBy(F.desc("stress"), "method", "threshold").limit(1).drop("base_normal")


def expected_f05_select(scored: DataFrame, score: str = "p", miss_rate: float = 0.02, min_p: float = 0.05) -> DataFrame:
    """(s1_id, cand_id): for each query the k best candidates with the largest expected F0.5, or none if that beats it."""
    order = Window.partitionBy("s1_id").orderBy(F.desc(score), "cand_id")
    whole = Window.partitionBy("s1_id")
    p = F.col(score)
    d = scored.where(p >= min_p).select("s1_id", "cand_id", p)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"k": F.row_number().over(order), "tp": F.sum(p).over(run), "total": F.sum(p).over(whole) / (1 - miss_rate), "none": F.exp(F.sum(F.log1p(-F.least(F.greatest(p, F.lit(0.0)), F.lit(1 - 1e-9)))).over(whole))})
    d = d.withColumn("ef", 1.25 * F.col("tp") / (0.25 * F.col("total") + F.col("k")))
    d = d.withColumn("best", F.max_by("k", F.struct("ef", (-F.col("k")).alias("first"))).over(whole)).withColumn("most", F.max("ef").over(whole))
    return d.where((F.col("most") > F.col("none")) & (F.col("k") <= F.col("best"))).select("s1_id", "cand_id")
