"""Scoring every field in one plan: dimension, live weather, drift verdict, model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.scalars import encode_map, to_number
from fieldlens.plans.model import IntervalModel, predict_interval, vectors, with_interval
from fieldlens.schemas import FEATURE_COLS, LIVE_TO_MODEL

OUTPUT = [
    "field_id",
    "name",
    "lat",
    "lon",
    "crop_type",
    "region",
    "area_ha",
    "soil_type",
    "predicted_yield_kg_ha",
    "lower_bound",
    "upper_bound",
    "drift_warning",
    "drift_level",
    "stale_features",
    "temp_c",
    "rainfall_mm",
    "solar_rad_mj_m2",
    "error",
]


def model_inputs(
    fields: DataFrame, codes: Mapping[str, Mapping[str, int]], default: int = 0
) -> DataFrame:
    """Field and live columns under their model names: the one mapping for fit and score.

    `codes` gives the label codes of crop_type, soil_type and region.
    """
    renamed = {
        model: F.col(live) for live, model in LIVE_TO_MODEL.items() if live in fields.columns
    }
    encoded = {
        f"{name}_encoded": encode_map(name, table, default)
        for name, table in codes.items()
        if name in fields.columns
    }
    calendar = {}
    if "forecast_date" in fields.columns:
        day = F.col("forecast_date").try_cast("date")
        calendar = {"week_of_year": F.weekofyear(day), "year": F.year(day)}
    return fields.withColumns({**renamed, **encoded, **calendar})


def score(
    fields: DataFrame,
    live: DataFrame,
    drift: DataFrame,
    model: GBTRegressionModel,
    codes: Mapping[str, Mapping[str, int]],
    interval: IntervalModel | None = None,
) -> DataFrame:
    """One row per field. A field that cannot be scored has nulls and an `error`; the rest is
    unaffected."""
    dims = [c for c in fields.columns if c != "field_id"]
    joined = fields.join(live.drop(*[c for c in dims if c in live.columns]), "field_id", "left").join(
        drift.select("field_id", "drift_warning", F.col("drift_level").alias("_level")),
        "field_id",
        "left",
    )
    problem = (
        F.when(to_number("lat").isNull() | to_number("lon").isNull(), "missing_location")
        .when(F.col("forecast_date").isNull(), "missing_live_features")
    )
    prepared = model_inputs(joined.withColumn("_error", problem), codes)
    carried = [c for c in prepared.columns if c not in FEATURE_COLS]
    kept = prepared.select(
        *carried, *[c for c in FEATURE_COLS if c in prepared.columns],
        F.struct("lat", "lon", "area_ha").alias("_dim"),
    )
    keep = [*carried, "_dim"]
    scored = model.transform(vectors(kept, keep=keep))
    if interval is not None:
        scored = predict_interval(interval, scored)
    scored = with_interval(scored)
    ok = F.col("_error").isNull()

    def when_ok(col: Column) -> Column:
        return F.when(ok, col)

    return scored.select(
        "field_id",
        F.coalesce(F.col("name"), F.col("field_id")).alias("name"),
        F.col("_dim.lat").alias("lat"),
        F.col("_dim.lon").alias("lon"),
        F.coalesce("crop_type", F.lit("")).alias("crop_type"),
        F.coalesce("region", F.lit("")).alias("region"),
        F.round(F.coalesce("_dim.area_ha", F.lit(0.0)), 1).alias("area_ha"),
        F.coalesce("soil_type", F.lit("")).alias("soil_type"),
        when_ok(F.round("prediction", 1)).alias("predicted_yield_kg_ha"),
        when_ok(F.round("lower_bound", 1)).alias("lower_bound"),
        when_ok(F.round("upper_bound", 1)).alias("upper_bound"),
        F.coalesce(when_ok(F.col("drift_warning")), F.lit(False)).alias("drift_warning"),
        F.when(ok, F.coalesce("_level", F.lit("green"))).otherwise("none").alias("drift_level"),
        F.coalesce(when_ok(F.col("stale_features")), F.lit(False)).alias("stale_features"),
        when_ok(F.col("t2m_max_today")).alias("temp_c"),
        when_ok(F.col("rainfall_today_mm")).alias("rainfall_mm"),
        when_ok(F.col("solar_radiation_today")).alias("solar_rad_mj_m2"),
        F.col("_error").alias("error"),
    )
