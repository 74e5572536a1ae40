"""Yield models on Spark ML: boosted trees for the mean and for quantiles, and leaf quantiles of a forest."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions.scalars import align_features
from fieldlens.operators.metrics import regression_metrics
from fieldlens.operators.splits import fold_parts, time_folds
from fieldlens.plans import boosting
from fieldlens.schemas import FEATURE_COLS, TARGET
from fieldlens.session import cut_lineage

# fixed values: model settings
DEFAULTS = {
    "max_depth": 6,
    "learning_rate": 0.1,
    "n_estimators": 300,
    "subsample": 0.8,
    "colsample": 0.8,
    "min_child": 5,
    "seed": 42,
}
LOWER_Q, UPPER_Q = 0.10, 0.90
FALLBACK_WIDTH = 0.15
SKETCH = 1000  # rank error 0.1 % per leaf; keeps the sketches of all leaves small in a task


def vectors(df: DataFrame, features: Sequence[str] = FEATURE_COLS, keep: Sequence[str] = ()):
    """Aligned numeric features as one vector column."""
    aligned = align_features(df, features, keep)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return assembler.transform(aligned).select(*keep, "features")


def _training(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    return vectors(df.filter(F.col(target).isNotNull()), features, [target])


def _boosted(
    df: DataFrame, losses: Sequence[float | None], params: Mapping[str, float] | None,
    features: Sequence[str], target: str,
) -> list[GBTRegressionModel]:
    p = {**DEFAULTS, **(params or {})}
    whole = ("max_depth", "n_estimators", "min_child", "seed")
    settings = boosting.Settings(**{k: int(v) if k in whole else float(v) for k, v in p.items()})
    rows = _training(df, features, target).select(vector_to_array("features").alias("x"), F.col(target).alias("y"))
    return boosting.fit(rows, losses, settings)


def fit_mean(
    df: DataFrame,
    params: Mapping[str, float] | None = None,
    features: Sequence[str] = FEATURE_COLS,
    target: str = TARGET,
) -> GBTRegressionModel:
    """Boosted trees for the mean. Columns and rows are sampled per tree."""
    return _boosted(df, [None], params, features, target)[0]


@dataclass
class YieldModels:
    mean: GBTRegressionModel
    lower: GBTRegressionModel
    upper: GBTRegressionModel


def fit_all(
    df: DataFrame,
    params: Mapping[str, float] | None = None,
    features: Sequence[str] = FEATURE_COLS,
    target: str = TARGET,
    lower: float = LOWER_Q,
    upper: float = UPPER_Q,
) -> YieldModels:
    """The mean and both bounds with the same settings; their trees grow in the same jobs."""
    return YieldModels(*_boosted(df, [None, lower, upper], params, features, target))


def predict_all(models: YieldModels, rows: DataFrame) -> DataFrame:
    """Add `prediction`, `lower_bound` and `upper_bound` to rows with a `features` vector."""
    for model, name in (
        (models.lower, "lower_bound"), (models.upper, "upper_bound"), (models.mean, "prediction")
    ):
        rows = model.copy().setPredictionCol(name).transform(rows)
    return rows


@dataclass
class IntervalModel:
    """A forest that names leaves, and the target quantiles of every (tree, leaf)."""

    forest: RandomForestRegressionModel
    leaves: DataFrame
    n_trees: int


def _with_leaves(scored: DataFrame) -> DataFrame:
    """The forest's leaf vector as an array, one entry per tree."""
    return scored.withColumn("_leaves", vector_to_array("_leaf"))


def fit_interval(
    df: DataFrame,
    lower: float = LOWER_Q,
    upper: float = UPPER_Q,
    n_trees: int = 20,
    params: Mapping[str, float] | None = None,
    features: Sequence[str] = FEATURE_COLS,
    target: str = TARGET,
) -> IntervalModel:
    """Conditional quantiles without a quantile loss.

    A forest splits the feature space; the quantiles of the target are taken per leaf of each
    tree. That is an approximation of quantile regression. There are at most trees x 2^depth
    leaves, and each is reduced to a fixed-size sketch before the shuffle.
    """
    p = {**DEFAULTS, **(params or {})}
    training = _training(df, features, target)
    forest = RandomForestRegressor(
        featuresCol="features",
        labelCol=target,
        leafCol="_leaf",
        numTrees=n_trees,
        maxDepth=int(p["max_depth"]),
        subsamplingRate=float(p["subsample"]),
        featureSubsetStrategy=str(float(p["colsample"])),
        minInstancesPerNode=max(int(p["min_child"]), 20),
        seed=int(p["seed"]),
    ).fit(training)
    cells = _with_leaves(forest.transform(training)).select(
        F.col(target).alias("_y"), F.posexplode("_leaves").alias("_tree", "_id")
    )
    quantiles = F.percentile_approx(
        "_y", F.array(F.lit(float(lower)), F.lit(float(upper))), F.lit(SKETCH)
    )
    leaves = (
        cells.groupBy("_tree", F.col("_id").cast("int").alias("_id"))
        .agg(quantiles.alias("_q"))
        .select("_tree", "_id", F.col("_q")[0].alias("_low"), F.col("_q")[1].alias("_high"))
    )
    return IntervalModel(forest, cut_lineage(leaves), n_trees)


def predict_interval(model: IntervalModel, rows: DataFrame) -> DataFrame:
    """Adds `lower_bound` / `upper_bound`: leaf quantiles averaged over the trees.

    `rows` has a `features` vector. The leaf table holds at most trees x 2^depth rows, so it
    travels as one scalar (a map per tree) and every row is scored in place.
    """
    per_tree = model.leaves.groupBy("_tree").agg(
        F.map_from_entries(
            F.collect_list(F.struct("_id", F.struct("_low", "_high")))
        ).alias("_map")
    )
    lookup = per_tree.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_tree", F.map_entries("_map").alias("_e")))),
            lambda t: F.map_from_entries(t["_e"]),
        )
    ).scalar()
    bare = model.forest.copy({model.forest.predictionCol: ""})
    scored = _with_leaves(bare.transform(rows)).withColumn("_tables", lookup)
    bounds = F.zip_with(
        "_tables", "_leaves", lambda table, leaf: F.try_element_at(table, leaf.cast("int"))
    )
    scored = scored.withColumn("_bounds", F.filter(bounds, lambda b: b.isNotNull()))

    def average(name: str):
        total = F.aggregate("_bounds", F.lit(0.0), lambda acc, b: acc + b[name])
        return F.try_divide(total, F.size("_bounds"))

    return scored.select(
        *rows.columns, average("_low").alias("lower_bound"), average("_high").alias("upper_bound")
    )


def with_interval(
    df: DataFrame, mean: str = "prediction", lower: str = "lower_bound",
    upper: str = "upper_bound", width: float = FALLBACK_WIDTH,
) -> DataFrame:
    """Keep lower <= mean <= upper; without bounds use a fixed share around the mean."""
    if lower in df.columns and upper in df.columns:
        low, high = F.col(lower), F.col(upper)
    else:
        low, high = F.col(mean) * (1 - width), F.col(mean) * (1 + width)
    # no prediction, no interval: least / greatest would otherwise skip the null
    scored = F.col(mean).isNotNull()
    return df.withColumns(
        {
            lower: F.when(scored, F.least(low, F.col(mean))),
            upper: F.when(scored, F.greatest(high, F.col(mean))),
        }
    )


def importance(
    model: GBTRegressionModel, spark: SparkSession, features: Sequence[str] = FEATURE_COLS
) -> DataFrame:
    """(feature, importance): one row per model feature."""
    scores = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(
        list(zip(features, scores)), "feature string, importance double"
    )


def explain(
    df: DataFrame, importances: Mapping[str, float], features: Sequence[str] = FEATURE_COLS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Contribution proxy per feature: value x importance / total importance, 4 decimals."""
    total = sum(importances.values()) or 1.0
    aligned = align_features(df, features, keep)
    return aligned.select(
        *keep,
        *[
            F.round(F.col(c) * float(importances.get(c, 0.0)) / total, 4).alias(c)
            for c in features
        ],
    )


# --- search --------------------------------------------------------------------------


def draw_params(n_trials: int, seed: int = 42) -> list[dict[str, float]]:
    """Seeded random draws from the search space."""
    rng = random.Random(seed)
    return [
        {
            "max_depth": rng.randint(4, 10),
            "learning_rate": math.exp(rng.uniform(math.log(0.01), math.log(0.3))),
            "n_estimators": rng.randint(100, 1000),
            "subsample": rng.uniform(0.6, 1.0),
            "colsample": rng.uniform(0.6, 1.0),
            "min_child": rng.randint(1, 10),
        }
        for _ in range(n_trials)
    ]


@dataclass
class Search:
    best: dict[str, float]
    trials: DataFrame = field(repr=False)


def cross_validate(
    folded: DataFrame,
    n_folds: int,
    params: Mapping[str, float],
    features: Sequence[str] = FEATURE_COLS,
    target: str = TARGET,
) -> list[dict[str, float]]:
    """Metrics of each expanding fold; every fit is a distributed job."""
    results = []
    for k in range(1, n_folds + 1):
        train, test = fold_parts(folded, k)
        model = fit_mean(train, params, features, target)
        scored = model.transform(_training(test, features, target))
        row = regression_metrics(scored, target, "prediction").first()
        results.append({"fold": k, "rmse": row.rmse, "mae": row.mae, "r2": row.r2})
    return results


def search(
    df: DataFrame,
    n_trials: int = 50,
    n_folds: int = 5,
    seed: int = 42,
    features: Sequence[str] = FEATURE_COLS,
    target: str = TARGET,
    date: str = "week_start",
    tie: Sequence[str] = ("field_id",),
    parallelism: int = 4,
    draws: Sequence[Mapping[str, float]] | None = None,
) -> Search:
    """Random search over time folds, smallest mean RMSE wins.

    The folded table is written once to the checkpoint folder; trials run side by side, each made
    of distributed fits.
    """
    labelled = df.filter(F.col(target).isNotNull()).select(
        *dict.fromkeys([date, *tie, target, *[c for c in features if c in df.columns]])
    )
    folded = cut_lineage(time_folds(labelled, n_folds, date, tie))
    draws = list(draws or draw_params(n_trials, seed))

    def run(i: int) -> list[tuple]:
        return [
            (i, r["fold"], r["rmse"], r["mae"], r["r2"])
            for r in cross_validate(folded, n_folds, draws[i], features, target)
        ]

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        rows = [row for part in pool.map(run, range(len(draws))) for row in part]
    means: dict[int, list[float]] = {}
    for trial, _, rmse, _, _ in rows:
        means.setdefault(trial, []).append(rmse)
    best = min(means, key=lambda t: (sum(means[t]) / len(means[t]), t))
    trials = df.sparkSession.createDataFrame(
        rows, "trial int, fold int, rmse double, mae double, r2 double"
    )
    return Search(dict(draws[best]), trials)
