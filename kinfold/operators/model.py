"""Learned scores: two-stage gradient boosting with out-of-fold first-stage scores, stacking, and plug-in scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.features import group_features, stack_features
from kinfold.operators.sampling import group_fold
from kinfold.sources.storage import materialize
from kinfold.sources.tables import read_json, write_json

GROUP_COLUMNS = ["g_rank_in_s1", "g_gap_to_best_s1", "g_n_cands_s1", "g_n_above_05_s1", "g_gap_to_best_same_src"]


@dataclass(frozen=True)
class Boosting:
    """Training parameters; depth stands in for a number of leaves."""

    rounds: int = 60
    depth: int = 6
    step: float = 0.05
    min_rows: int = 200
    rows: float = 0.8
    features: str = "0.8"
    seed: int = 0


def drop_features(columns: Sequence[str], prefixes: Sequence[str]) -> list[str]:
    """Feature names without those that begin with a prefix."""
    return [c for c in columns if not any(c.startswith(p) for p in prefixes)]


def _fit(df: DataFrame, columns: Sequence[str], p: Boosting) -> PipelineModel:
    gbt = GBTClassifier(labelCol="label", featuresCol="kf_x", maxIter=p.rounds, maxDepth=p.depth, stepSize=p.step, minInstancesPerNode=p.min_rows, subsamplingRate=p.rows, featureSubsetStrategy=p.features, seed=p.seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="kf_x", handleInvalid="keep"), gbt]).fit(df)


def _score(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    done = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return done.drop("kf_x", "rawPrediction", "probability", "prediction")


def filled(df: DataFrame, columns: Sequence[str], missing: float = -1.0) -> DataFrame:
    """Feature columns as doubles; missing values get a value of their own."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in columns})


@dataclass
class Matcher:
    """Stage one: a model for each fold. Stage two: features, the mean first-stage score and its standing."""

    first: list[PipelineModel]
    second: PipelineModel
    columns: list[str]

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        df = filled(df, self.columns)
        names = []
        for k, m in enumerate(self.first):
            df = _score(m, df, f"kf_p{k}")
            names.append(f"kf_p{k}")
        mean = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names)
        df = group_features(df.withColumn("p1", mean), "p1")
        return _score(self.second, filled(df, GROUP_COLUMNS), out).drop(*names)

    def importance(self) -> list[tuple[str, float]]:
        """Share of the total gain by feature of the second stage, largest first."""
        names = [*self.columns, "p1", *GROUP_COLUMNS]
        values = self.second.stages[-1].featureImportances.toArray()
        return sorted(zip(names, values.tolist()), key=lambda x: (-x[1], x[0]))

    def save(self, path: str, spark: SparkSession, threshold: float | None = None) -> None:
        """The models and, as JSON, the feature list, number of folds and decision threshold."""
        for k, m in enumerate(self.first):
            m.write().overwrite().save(f"{path}/first_{k}")
        self.second.write().overwrite().save(f"{path}/second")
        write_json(spark, {"columns": self.columns, "folds": len(self.first), "threshold": threshold}, f"{path}/config.json")

    @staticmethod
    def load(path: str, spark: SparkSession) -> tuple["Matcher", float | None]:
        """The saved matcher and its threshold."""
        config = read_json(spark, f"{path}/config.json")
        first = [PipelineModel.load(f"{path}/first_{k}") for k in range(config["folds"])]
        return Matcher(first, PipelineModel.load(f"{path}/second"), config["columns"]), config["threshold"]


def train_matcher(df: DataFrame, columns: Sequence[str], folds: int = 3, p: Boosting = Boosting()) -> Matcher:
    """``df`` has s1_id, cand_id, cand_source, label and the feature ``columns``. First-stage scores of training rows come
    from the model that didn't see their query."""
    keep = ["s1_id", "cand_id", "cand_source", "label", *columns]
    df = materialize(filled(df, columns).select(*dict.fromkeys(keep)).withColumn("kf_fold", group_fold(F.col("s1_id"), folds)))  # every fit reads it again
    first, scored = [], None
    for k in range(folds):
        m = _fit(df.where(F.col("kf_fold") != k), columns, p)
        part = _score(m, df.where(F.col("kf_fold") == k), "p1")
        scored = part if scored is None else scored.unionByName(part)
        first.append(m)
    staged = materialize(filled(group_features(scored, "p1"), GROUP_COLUMNS))
    return Matcher(first, _fit(staged, [*columns, "p1", *GROUP_COLUMNS], p), list(columns))


STACK_COLUMNS = ["p_lgbm", "p_ce", "prod", "diff", "absdiff", "cand_is_s3", *[f"{k}_{c}" for c in ("p_lgbm", "p_ce") for k in ("rank", "gap", "n_above", "gap_src")], "n_cands"]


def stack_out_of_fold(df: DataFrame, folds: int = 5, p: Boosting = Boosting(rounds=30, depth=5, min_rows=200)) -> tuple[DataFrame, PipelineModel]:
    """``df`` (s1_id, cand_id, label, p_lgbm, p_ce) plus out-of-fold p_stack, and the model fitted on all of it."""
    x = materialize(filled(stack_features(df), STACK_COLUMNS).withColumn("kf_fold", group_fold(F.col("s1_id"), folds)))
    out = None
    for k in range(folds):
        part = _score(_fit(x.where(F.col("kf_fold") != k), STACK_COLUMNS, p), x.where(F.col("kf_fold") == k), "p_stack")
        out = part if out is None else out.unionByName(part)
    return out.drop("kf_fold"), _fit(x, STACK_COLUMNS, p)


def score_pairs_with(pairs: DataFrame, texts: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], both_orders: bool = True, out: str = "p_ce") -> DataFrame:
    """Scores of a text-pair model, any callable on batches of texts; the mean of both orders if asked. ``texts`` has
    entity_id and text; an unknown id has an empty text. The slot for a transformer, which isn't part of this package."""
    left = texts.select(F.col("entity_id").alias("s1_id"), F.col("text").alias("kf_a"))
    right = texts.select(F.col("entity_id").alias("cand_id"), F.col("text").alias("kf_b"))
    known = pairs.join(left, "s1_id", "left").join(right, "cand_id", "left").fillna("", ["kf_a", "kf_b"])

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            s = pd.Series(scorer(list(a), list(b)), dtype=float)
            yield (s + pd.Series(scorer(list(b), list(a)), dtype=float)) / 2 if both_orders else s

    return known.withColumn(out, F.pandas_udf(run, "double")("kf_a", "kf_b")).drop("kf_a", "kf_b")
