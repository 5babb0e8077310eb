"""Learned rankers, filters and matchers on Spark ML (L1-L12): folds, out-of-fold scores, stacking, ensembles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import fold

#: Features that grow with the pool, and those of the query's script, are left out of matchers.
# The columns' names.
POOL_SIZED = ("idf_name", "idf_addr", "block_score", "n_name_shared", "n_addr_shared", "n_candidates_for_entity", "pool_name_freq", "pool_core_freq", "pool_addr_freq", "s1_core_freq", "s1_addr_freq")
QUERY_SCRIPT = ("name_script_1", "name_script_match")


def feature_columns(columns: Sequence[str], robust: bool = False) -> list[str]:
    left_out = {"country", "s1_id", "pool_id", "label", *QUERY_SCRIPT, *(POOL_SIZED if robust else ())}
    return [c for c in columns if c not in left_out]


def fit(rows: DataFrame, features: Sequence[str], kind: str = "gbt", seed: int = 42, rounds: int = 20, validation: str | None = None) -> PipelineModel:
    """``gbt``: boosted trees, missing values as a value of their own, early stop on ``validation`` rows.
    ``lr``: median imputation with indicators, scaling, logistic regression (L5)."""
    if kind == "lr":
        medians = Imputer(strategy="median", inputCols=list(features), outputCols=[f"{c}_filled" for c in features])
        inputs = [f"{c}_filled" for c in features]
        steps = [medians, VectorAssembler(inputCols=inputs + [f"{c}_null" for c in features], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features"), LogisticRegression(regParam=0.01)]
    else:
        model = GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.2, seed=seed, **({"validationIndicatorCol": validation} if validation else {}))
        steps = [VectorAssembler(inputCols=list(features), outputCol="features"), model]
    return Pipeline(stages=steps).fit(prepared(rows, features, kind))


def prepared(rows: DataFrame, features: Sequence[str], kind: str) -> DataFrame:
    doubles = {c: F.col(c).cast("double") for c in features}
    if kind == "lr":
        return rows.withColumns({f"{c}_null": F.col(c).isNull().cast("double") for c in features} | doubles)
    return rows.withColumns({c: F.coalesce(v, F.lit(-1.0)) for c, v in doubles.items()})


def score(model: PipelineModel, rows: DataFrame, features: Sequence[str], kind: str = "gbt", out: str = "p") -> DataFrame:
    """``rows`` with the probability of label 1; model columns are dropped."""
    scored = model.transform(prepared(rows.withColumnsRenamed({c: c for c in rows.columns}), features, kind))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "raw", "rawPrediction", "probability", "prediction", *[f"{c}_{s}" for c in features for s in ("filled", "null")])


def out_of_fold(rows: DataFrame, features: Sequence[str], k: int = 3, entity: str = "s1_id", kind: str = "gbt", out: str = "p") -> DataFrame:
    """Every row scored by a model that saw no row of its entity's fold."""
    rows = rows.withColumn("x_fold", fold(F.col(entity), k)).persist()
    parts = [score(fit(rows.where(F.col("x_fold") != i), features, kind), rows.where(F.col("x_fold") == i), features, kind, out) for i in range(k)]
    return reduce(DataFrame.unionByName, parts).drop("x_fold")


def ensemble(models: Sequence[PipelineModel], rows: DataFrame, features: Sequence[str], kind: str = "gbt", out: str = "p") -> DataFrame:
    """The mean of the members' probabilities."""
    for i, m in enumerate(models):
        rows = score(m, rows, features, kind, f"{out}_{i}")
    members = [f"{out}_{i}" for i in range(len(models))]
    return rows.withColumn(out, sum((F.col(c) for c in members[1:]), F.col(members[0])) / len(members)).drop(*members)


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Gain importances, largest first."""
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])
