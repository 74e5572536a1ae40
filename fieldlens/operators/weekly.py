"""Weekly features per field.

Every aggregate here is algebraic, so Spark combines rows before the one shuffle on
(field_id, week_start); a field that holds a third of the rows costs no more than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions.scalars import event_time, nan_as_null, week_start

FIELD_WEEK = ["field_id", "week_start"]


def with_week(df: DataFrame) -> DataFrame:
    """Add `event_time` (from epoch ms, unless present) and `week_start`."""
    if "event_time" not in df.columns:
        df = df.withColumn("event_time", event_time("timestamp"))
    return df.withColumn("week_start", week_start("event_time"))


def soil_statistics(mask_faults: bool = False) -> list[Column]:
    """Weekly soil columns. `mask_faults` drops temperatures of DROPOUT / BURST readings."""
    temperature = F.col("temperature").cast("double")
    if mask_faults:
        broken = F.coalesce(F.col("fault_mode").isin("DROPOUT", "BURST"), F.lit(False))
        temperature = F.when(~broken, temperature)
    moisture = F.col("moisture").cast("double")
    return [
        F.avg(temperature).alias("soil_temp_mean"),
        F.min(temperature).alias("soil_temp_min"),
        F.max(temperature).alias("soil_temp_max"),
        F.stddev_samp(temperature).alias("soil_temp_std"),
        F.avg(moisture).alias("moisture_mean"),
        F.min(moisture).alias("moisture_min"),
        F.max(moisture).alias("moisture_max"),
        F.stddev_samp(moisture).alias("moisture_std"),
        F.avg("ph").alias("ph_mean"),
        F.avg("nitrogen").alias("nitrogen_mean"),
        F.avg("phosphorus").alias("phosphorus_mean"),
        F.avg("potassium").alias("potassium_mean"),
    ]


def weather_statistics() -> list[Column]:
    """Weekly weather columns. Missing precipitation counts as no rain."""
    rain = F.coalesce(F.col("precipitation").cast("double"), F.lit(0.0))
    return [
        F.avg("temperature").alias("air_temp_mean"),
        F.sum(rain).alias("precip_total"),
        F.avg("humidity").alias("humidity_mean"),
        F.avg("wind_speed").alias("wind_speed_mean"),
    ]


def soil_weekly(readings: DataFrame, mask_faults: bool = False) -> DataFrame:
    return with_week(readings).groupBy(*FIELD_WEEK).agg(*soil_statistics(mask_faults))


def weather_weekly(readings: DataFrame) -> DataFrame:
    """Weekly weather per field. NaN counts as null."""
    readings = nan_as_null(readings, ["temperature", "precipitation", "humidity", "wind_speed"])
    return with_week(readings).groupBy(*FIELD_WEEK).agg(*weather_statistics())


def climate_weekly(daily: DataFrame) -> DataFrame:
    """Daily climate rows to weeks. The temperature columns describe daily maxima. NaN counts as null."""
    return (
        nan_as_null(daily, ["T2M_MAX", "PRECTOTCORR", "RH2M", "WS2M"])
        .withColumn("week_start", week_start("date"))
        .groupBy(*FIELD_WEEK)
        .agg(
            F.avg("T2M_MAX").alias("air_temp_mean"),
            F.stddev_samp("T2M_MAX").alias("air_temp_std"),
            F.coalesce(F.sum("PRECTOTCORR"), F.lit(0.0)).alias("precip_total"),
            F.avg("RH2M").alias("humidity_mean"),
            F.avg("WS2M").alias("wind_speed_mean"),
        )
    )


def latest_per_week(scenes: DataFrame) -> DataFrame:
    """Newest scene of each (field, week); equal times are settled by scene id.

    The rank filter reaches below the shuffle, so each task sends at most one row per key.
    """
    newest = Window.partitionBy(*FIELD_WEEK).orderBy(
        F.col("event_time").desc(), F.col("scene_id").desc()
    )
    return (
        with_week(scenes)
        .withColumn("_rank", F.row_number().over(newest))
        .filter("_rank = 1")
        .drop("_rank")
    )


def fill_ndvi(latest: DataFrame, ignore_nulls: bool = False) -> DataFrame:
    """Fill a missing index from the field's previous observed week and flag it.

    Takes one row per (field, week): the window therefore holds one row per calendar week. By
    default only the row before is looked at; `ignore_nulls` looks back to the last known value.
    """
    weeks = Window.partitionBy("field_id").orderBy("week_start")
    if ignore_nulls:
        back = weeks.rowsBetween(Window.unboundedPreceding, -1)
        previous = F.last("ndvi", ignorenulls=True).over(back)
    else:
        previous = F.lag("ndvi").over(weeks)
    absent = F.col("ndvi").isNull()
    return latest.select(
        "field_id",
        "week_start",
        F.when(absent, previous).otherwise(F.col("ndvi")).alias("latest_ndvi"),
        "cloud_cover_pct",
        F.when(absent, F.lit(True)).otherwise(F.col("ndvi_interpolated")).alias(
            "ndvi_interpolated"
        ),
        F.coalesce(F.col("ndvi_proxied"), F.lit(False)).alias("ndvi_proxied"),
    )


def vegetation_weekly(scenes: DataFrame, ignore_nulls: bool = False) -> DataFrame:
    return fill_ndvi(latest_per_week(scenes), ignore_nulls)
