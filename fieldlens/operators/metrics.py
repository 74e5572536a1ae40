"""Error metrics, baselines, gates and promotion. Each report is one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.scalars import nan_as_null
from fieldlens.session import small_side

# fixed values: gates
RMSE_GATE = 2000.0
MIN_GAIN = 0.02
MAX_CROP_LOSS = 0.05


def _errors(y: str, p: str) -> list[Column]:
    truth, guess = F.col(y).cast("double"), F.col(p).cast("double")
    both = truth.isNotNull() & guess.isNotNull()
    miss = F.when(both, truth - guess)
    squared = F.sum(miss * miss)
    n = F.count(miss)
    # spread around the mean; not regr_r2, which is a squared correlation
    total = F.var_pop(F.when(both, truth)) * n
    r2 = F.when(total == 0, F.when(squared == 0, 1.0).otherwise(0.0)).otherwise(
        1 - squared / total
    )
    return [
        n.alias("n"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg(F.abs(miss)).alias("mae"),
        r2.alias("r2"),
    ]


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(*_errors(y, p))


def regression_metrics_by(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    return df.groupBy(*keys).agg(*_errors(y, p))


def season_of(ts: Column | str) -> Column:
    """Meteorological season of a date."""
    month = F.month(F.col(ts) if isinstance(ts, str) else ts)
    return (
        F.when(month.between(3, 5), "Spring")
        .when(month.between(6, 8), "Summer")
        .when(month.between(9, 11), "Autumn")
        .otherwise("Winter")
    )


def crop_mean_fit(train: DataFrame, crop: str = "crop_type", y: str = "yield_kg_per_ha"):
    """Mean target per crop, plus the overall mean under a null crop; one pass, computed now."""
    means = train.groupBy(crop).agg(F.sum(y).alias("_sum"), F.count(y).alias("_n"))
    mean = F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean_target")
    per_crop = means.filter(F.col(crop).isNotNull()).groupBy(crop).agg(mean)
    overall = means.agg(mean).select(F.lit(None).cast("string").alias(crop), "mean_target")
    return small_side(per_crop.unionByName(overall))


def crop_mean_predict(
    df: DataFrame, model: DataFrame, crop: str = "crop_type", out: str = "prediction"
) -> DataFrame:
    """Crop mean, or the overall mean for a crop that was not seen."""
    overall = model.filter(F.col(crop).isNull()).select("mean_target").scalar()
    known = model.filter(F.col(crop).isNotNull()).withColumnRenamed("mean_target", "_mean")
    return df.join(known, crop, "left").withColumn(out, F.coalesce("_mean", overall)).drop("_mean")


def null_rates(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Share of nulls per column, long form. NaN counts as null."""
    df = nan_as_null(df, cols)
    rates = df.groupBy(*keys).agg(
        *[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols]
    )
    return rates.unpivot(list(keys), list(cols), "column", "null_rate")


def range_violations(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whether daily climate holds an impossible temperature or negative rain. NaN is neither."""
    df = nan_as_null(df, ["T2M_MAX", "PRECTOTCORR"])
    hot = (F.col("T2M_MAX") < -20) | (F.col("T2M_MAX") > 50)
    return df.groupBy(*keys).agg(
        F.coalesce(F.bool_or(hot), F.lit(False)).alias("temperature_out_of_range"),
        F.coalesce(F.bool_or(F.col("PRECTOTCORR") < 0), F.lit(False)).alias("negative_rain"),
    )


def summarise(
    df: DataFrame, y: str = "yield_kg_per_ha", year: str = "year", field: str = "field_id"
) -> DataFrame:
    """Row count, target range, years and number of fields."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(y).alias("min_target"),
        F.max(y).alias("max_target"),
        F.sort_array(F.collect_set(year)).alias("years"),
        F.count_distinct(field).alias("n_fields"),
    )


def cv_summary(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Fold averages; the spread of RMSE is the population one."""
    return folds.groupBy(*keys).agg(
        F.avg("rmse").alias("cv_rmse_mean"),
        F.stddev_pop("rmse").alias("cv_rmse_std"),
        F.avg("mae").alias("cv_mae_mean"),
        F.avg("r2").alias("cv_r2_mean"),
    )


def interval_report(
    df: DataFrame, y: str = "yield_kg_per_ha", mean: str = "prediction",
    lower: str = "lower_bound", upper: str = "upper_bound", keys: Sequence[str] = (),
) -> DataFrame:
    """Ordering violations, share of targets inside the interval, and mean width."""
    low, mid, high, truth = (F.col(c) for c in (lower, mean, upper, y))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((low > mid) | (mid > high)).alias("ordering_violations"),
        F.avg(truth.between(low, high).cast("int")).alias("coverage"),
        F.avg(high - low).alias("mean_width"),
    )


def quality_gate(
    metrics: DataFrame, limit: float = RMSE_GATE, metric: str = "holdout_rmse"
) -> DataFrame:
    """Verdict per run: RMSE must not exceed the limit."""
    return metrics.filter(F.col("metric") == metric).select(
        "run_id", F.col("value").alias("rmse"), (F.col("value") <= limit).alias("passed")
    )


# --- promotion -----------------------------------------------------------------------


def compare_runs(metrics: DataFrame, champion: str, challenger: str) -> DataFrame:
    """Champion and challenger side by side per metric; the newest value of a metric counts."""
    wanted = metrics.filter(F.col("run_id").isin(champion, challenger))

    def value_of(run: str) -> Column:
        return F.max_by("value", F.when(F.col("run_id") == run, F.col("ts")))

    return wanted.groupBy("metric").agg(
        value_of(champion).alias("champion"), value_of(challenger).alias("challenger")
    )


def promotion_decision(
    compared: DataFrame,
    min_gain: float = MIN_GAIN,
    max_crop_loss: float = MAX_CROP_LOSS,
    headline: str = "holdout_rmse",
    strict: bool = False,
) -> DataFrame:
    """One row: promote or not, why, and the figures behind it.

    The challenger needs a relative RMSE gain of at least `min_gain` (more than it, if `strict`)
    and no crop may get worse by more than `max_crop_loss`. A missing headline value means no; no
    champion metrics at all means yes.
    """
    main = F.col("metric") == headline
    per_crop = (
        F.col("metric").endswith("_rmse")
        & ~F.col("metric").contains("holdout")
        & ~F.col("metric").contains("cv")
    )
    # a zero or missing figure on either side is not compared
    loss = F.when(
        per_crop & (F.col("champion") != 0) & (F.col("challenger") != 0),
        (F.col("challenger") - F.col("champion")) / F.nullif(F.col("champion"), F.lit(0.0)),
    )
    figures = compared.agg(
        F.count("champion").alias("n_champion"),
        F.max(F.when(main, F.col("champion"))).alias("champion_rmse"),
        F.max(F.when(main, F.col("challenger"))).alias("challenger_rmse"),
        F.max(loss).alias("worst_crop_loss"),
        F.max_by(F.regexp_extract("metric", r"^(.*?)_rmse", 1), loss).alias("worst_crop"),
    )
    gain = F.try_divide(
        F.col("champion_rmse") - F.col("challenger_rmse"), F.col("champion_rmse")
    )
    enough = (F.col("gain") > min_gain) if strict else (F.col("gain") >= min_gain)
    reason = (
        F.when(F.col("n_champion") == 0, "no_champion")
        .when(F.col("champion_rmse").isNull() | F.col("challenger_rmse").isNull(), "missing_metric")
        .when(~F.coalesce(enough, F.lit(False)), "gain_too_small")
        .when(F.col("worst_crop_loss") > max_crop_loss, "crop_regression")
        .otherwise("better")
    )
    return (
        figures.withColumn("gain", gain)
        .withColumn("reason", reason)
        .withColumn("promote", F.col("reason").isin("no_champion", "better"))
        .select(
            "promote", "reason", "champion_rmse", "challenger_rmse", "gain", "worst_crop",
            "worst_crop_loss",
        )
    )
