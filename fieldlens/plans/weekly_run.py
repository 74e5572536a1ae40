"""The weekly run: checked inputs, features, online snapshot, model, gate, promotion, monitoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.scalars import moment
from fieldlens.operators.asof import merge_snapshot, online_latest
from fieldlens.operators.assemble import assemble_weekly, enrich, unknown_fields
from fieldlens.operators.drift import psi, psi_profile, retrain_from_psi, to_long
from fieldlens.operators.metrics import (
    compare_runs,
    promotion_decision,
    quality_gate,
    regression_metrics,
    regression_metrics_by,
)
from fieldlens.operators.quality import validate, verdict
from fieldlens.operators.splits import temporal_split
from fieldlens.operators.weekly import soil_weekly, vegetation_weekly, weather_weekly
from fieldlens.plans.model import fit_mean, vectors
from fieldlens.schemas import TARGET, struct
from fieldlens.session import cut_lineage
from fieldlens.sources.commits import CommittedTable, bucket
from fieldlens.sources.tables import append_metrics, read_metrics, write_table


class BadBatch(RuntimeError):
    """A source failed its contract; nothing after the check has run."""


@dataclass
class WeeklyRun:
    features: DataFrame
    model: GBTRegressionModel
    holdout: DataFrame
    by_crop: DataFrame


def checked(df: DataFrame, suite: Sequence, name: str) -> DataFrame:
    if not verdict(validate(df, suite)).first().valid:
        raise BadBatch(name)
    return df


def build_features(
    soil: DataFrame, weather: DataFrame, scenes: DataFrame, labels: DataFrame, fields: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Landed events to one row per (field, week) with label and field attributes.

    The second table has the weeks whose field the dimension does not know.
    """
    weekly = assemble_weekly(
        soil_weekly(soil), weather_weekly(weather), vegetation_weekly(scenes), labels
    )
    return enrich(weekly, fields), unknown_fields(weekly, fields)


def train_and_judge(
    features: DataFrame,
    feature_names: Sequence[str],
    params: Mapping[str, float] | None = None,
    crop: str = "crop_type",
) -> WeeklyRun:
    """Split by time, fit on the older part, report errors on the newer one."""
    labelled = cut_lineage(features.dropna(subset=[TARGET]))
    parts = temporal_split(labelled, tie=["field_id"])
    model = fit_mean(parts.filter("split = 'train'"), params, feature_names)
    test = parts.filter("split = 'test'")
    scored = model.transform(vectors(test, feature_names, [TARGET, crop]))
    return WeeklyRun(
        labelled,
        model,
        regression_metrics(scored, TARGET, "prediction"),
        regression_metrics_by(scored, [crop], TARGET, "prediction"),
    )


# --- the run as a whole ----------------------------------------------------------------

CHAMPION = struct("run_id string, promoted timestamp")
ONLINE_PARTS = 64


@dataclass(frozen=True)
class WeekInputs:
    """Landed rows, labels and the field dimension; `suites` names the contract of each landed table."""

    soil: DataFrame
    weather: DataFrame
    scenes: DataFrame
    labels: DataFrame
    fields: DataFrame
    suites: Mapping[str, Sequence]


@dataclass
class WeekReport:
    """What a run leaves: tables under its root, and these figures."""

    run_id: str
    unknown: DataFrame
    gate: DataFrame
    decision: DataFrame
    promoted: bool
    drift: DataFrame
    retrain: DataFrame


def champion_table(spark, root: str) -> CommittedTable:
    return CommittedTable(spark, f"{root}/champion", CHAMPION, F.lit("all"))


def online_table(features: DataFrame, root: str) -> CommittedTable:
    return CommittedTable(features.sparkSession, f"{root}/online", features.schema, bucket(["field_id"], ONLINE_PARTS))


def run_metrics(run: WeeklyRun, run_id: str, now: datetime, crop: str) -> DataFrame:
    """Holdout errors as rows of the metric history: one for all, one per crop."""
    at = moment(now).alias("ts")
    name = F.lit(run_id).alias("run_id")
    whole = run.holdout.select(name, F.lit("holdout_rmse").alias("metric"), F.col("rmse").alias("value"), at)
    each = run.by_crop.select(name, F.concat(F.col(crop).cast("string"), F.lit("_rmse")).alias("metric"),
                              F.col("rmse").alias("value"), at)
    return whole.unionByName(each)


def run_week(
    root: str,
    inputs: WeekInputs,
    feature_names: Sequence[str],
    run_id: str,
    now: datetime,
    params: Mapping[str, float] | None = None,
    crop: str = "crop_type",
    limit: float | None = None,
) -> WeekReport:
    """One weekly run over the tables under `root`.

    A table that fails its contract ends the run before anything is written. Then weekly features replace their weeks,
    the newest row of every field goes online, a model is fitted and judged, and it becomes the champion if it passes
    the gate and beats the last one. Last, the newest week is compared with the weeks the model has learned from.
    A run that is repeated under its id changes nothing but its own metrics' time.
    """
    spark = inputs.soil.sparkSession
    for name, suite in inputs.suites.items():
        checked(getattr(inputs, name), suite, name)
    features, unknown = build_features(inputs.soil, inputs.weather, inputs.scenes, inputs.labels, inputs.fields)
    write_table(features.withColumn("week", F.col("week_start").cast("date")), f"{root}/features", ["week"])
    features = spark.read.parquet(f"{root}/features").drop("week")
    newest = online_latest(features, "field_id", "week_start")
    online_table(features, root).merge(
        newest, run_id, 0, lambda kept, batch: merge_snapshot(kept, batch, "field_id", "week_start")
    )

    run = train_and_judge(features, feature_names, params, crop)
    append_metrics(run_metrics(run, run_id, now, crop), f"{root}/metrics")
    metrics = read_metrics(spark, f"{root}/metrics")
    champions = champion_table(spark, root)
    # one row
    last = champions.read().first()
    gate = quality_gate(metrics.filter(F.col("run_id") == run_id), *([limit] if limit is not None else []))
    decision = cut_lineage(promotion_decision(compare_runs(metrics, last.run_id if last else "", run_id)))
    passed = gate.agg(F.bool_and("passed")).first()[0]
    promoted = bool(passed) and bool(decision.first().promote) and not (last and last.run_id == run_id)
    run.model.write().overwrite().save(f"{root}/models/{run_id}")
    if promoted:
        row = spark.createDataFrame([(run_id,)], "run_id string").withColumn("promoted", moment(now))
        champions.merge(row, run_id, 0, lambda kept, new: new)

    first = F.lit(features.agg(F.max("week_start")).first()[0])
    names = [c for c in feature_names if c in features.columns]
    profile = psi_profile(to_long(features.filter(F.col("week_start") < first), [], names))
    drift = psi(profile, to_long(features.filter(F.col("week_start") >= first), [], names))
    return WeekReport(run_id, unknown, gate, decision, promoted, drift, retrain_from_psi(drift))
