"""Tables written in every form the library knows, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.features import soil_sql
from checks.tables import DAILY, PREDICTIONS, daily_climate, load, predictions, readings, rounded, scratch, shown, ts_sql
from fieldlens.operators.weekly import soil_weekly
from fieldlens.schemas import FIELDS, PREDICTION_LOG
from fieldlens.sources.tables import (
    append_metrics,
    append_predictions,
    read_daily,
    read_fields,
    read_metrics,
    read_predictions,
    read_table,
    read_wide_years,
    write_daily,
    write_table,
)


def q_table_overwrite(spark, sf):
    """Weekly features, written twice: the second write replaces the weeks it has, spoilt before."""
    path = f"{scratch(spark)}/weekly"
    weekly = soil_weekly(readings(spark, sf)).withColumn("week", F.col("week_start").cast("date"))
    late = F.col("week") >= "2024-01-15"
    write_table(weekly.withColumn("moisture_mean", F.when(late, -1.0).otherwise(F.col("moisture_mean"))), path, ["week"])
    write_table(weekly.filter(late), path, ["week"])
    return shown(read_table(spark, path).drop("week"))


def q_daily_round_trip(spark, sf):
    """Daily climate by field and year, read back for some days of one year."""
    path = f"{scratch(spark)}/daily"
    write_daily(daily_climate(spark, sf), path, ["year"])
    found = read_daily(spark, path).filter((F.col("year") == 2024) & (F.col("date") >= "2024-01-20"))
    return shown(found.select("field_id", "date", "PRECTOTCORR", "T2M_MAX", "T2M_MIN", "RH2M", "year"))


DAILY_SQL = f"""WITH {DAILY} SELECT field_id, {ts_sql('date')} AS date,
  {rounded('PRECTOTCORR', 'T2M_MAX', 'T2M_MIN', 'RH2M')}, CAST(year(date) AS INTEGER) AS year FROM daily
WHERE year(date) = 2024 AND date >= TIMESTAMP '2024-01-20'"""


def q_fields_csv(spark, sf):
    path = f"{scratch(spark)}/fields"
    fields = load(spark, sf, "customer").select(
        F.concat(F.lit("F"), "c_custkey").alias("field_id"), F.col("c_name").alias("name"),
        (F.col("c_nationkey") + 50.5).alias("lat"), F.lit(None).cast("double").alias("lon"),
        F.col("c_mktsegment").alias("crop_type"), F.lit("a, \"b\"").alias("region"),
        F.col("c_acctbal").alias("area_ha"), F.lit("clay").alias("soil_type"),
    )
    fields.select([f.name for f in FIELDS.fields]).write.option("header", True).option("escape", "\"").csv(path)
    return shown(read_fields(spark, path).drop("region"))


FIELDS_SQL = f"""SELECT 'F' || c_custkey AS field_id, c_name AS name, {rounded('c_nationkey + 50.5::DOUBLE AS lat')},
  NULL::DOUBLE AS lon, c_mktsegment AS crop_type, {rounded('c_acctbal AS area_ha')}, 'clay' AS soil_type FROM customer"""

YEARS = (1994, 1995, 1996)


def q_wide_csv_years(spark, sf):
    """A table of months per year and supplier; years and their months come from the files."""
    root = scratch(spark)
    lines = load(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("field_id"), "l_quantity",
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
    )
    paths = [f"{root}/climate/{year}/sums.csv" for year in YEARS]
    for year, path in zip(YEARS, paths, strict=True):
        months = [f"{year}-{m:02}" for m in range(1, 13)]
        wide = lines.filter(F.col("month").isin(months)).groupBy("field_id").pivot("month", months).agg(F.sum("l_quantity"))
        wide.coalesce(1).write.option("header", True).csv(path)
    wide = read_wide_years(spark, paths)
    months = [c for c in wide.columns if c not in ("field_id", "Year")]
    long = wide.unpivot(["field_id", "Year"], months, "month", "total").filter("total is not null")
    return shown(long.withColumn("total", F.col("total").cast("double")))


WIDE_SQL = f"""SELECT 'S' || l_suppkey AS field_id, CAST(year(l_shipdate) AS INTEGER) AS "Year",
  strftime(l_shipdate, '%Y-%m') AS month, {rounded('sum(l_quantity)::DOUBLE AS total')} FROM lineitem
WHERE year(l_shipdate) IN {YEARS} GROUP BY ALL"""


def logged(spark, sf):
    return predictions(spark, sf).select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("S"), "l_suppkey").alias("field_id"),
        F.col("prediction").alias("predicted_yield_kg_per_ha"), (F.col("prediction") * 0.85).alias("lower_bound"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("prediction") * 1.15).alias("upper_bound"), F.lit("v1").alias("model_version"),
    )


def q_prediction_log(spark, sf):
    """Two appends to the log of predictions, read back and counted per field."""
    path, rows = f"{scratch(spark)}/log", logged(spark, sf)
    early = F.col("ts") < "1995-01-01"
    append_predictions(rows.filter(early), path)
    append_predictions(rows.filter(~early), path)
    found = read_predictions(spark, path)
    assert [f.name for f in found.schema.fields] == [f.name for f in PREDICTION_LOG.fields]
    return shown(
        found.groupBy("field_id", "model_version").agg(
            F.count(F.lit(1)).alias("n"), F.count("upper_bound").alias("n_upper"), F.min("ts").alias("first"),
            F.max("ts").alias("last"), F.sum("predicted_yield_kg_per_ha").alias("total"),
        ), 2
    )


LOG_SQL = f"""WITH {PREDICTIONS} SELECT 'S' || l_suppkey AS field_id, 'v1' AS model_version, count(*) AS n,
  count(*) FILTER (l_suppkey % 2 = 0) AS n_upper, {ts_sql('min(ts)')} AS "first", {ts_sql('max(ts)')} AS "last",
  round(sum(p), 2) AS total FROM pred GROUP BY l_suppkey"""


def q_metric_history(spark, sf):
    """Runs whose metrics have other columns than those before; older rows have nulls there."""
    path = f"{scratch(spark)}/metrics"
    per = load(spark, sf, "events").groupBy(F.col("event_type").alias("run_id"))
    append_metrics(per.agg(F.avg("value").alias("rmse")), path)
    append_metrics(per.agg(F.avg("value").alias("rmse"), F.max("value").alias("worst"), F.count("*").alias("n")), path)
    return shown(read_metrics(spark, path).select("run_id", "rmse", "worst", "n"))


HISTORY_SQL = f"""WITH m AS (SELECT event_type AS run_id, avg(value) AS rmse, max(value) AS worst, count(*) AS n
  FROM events GROUP BY ALL)
SELECT run_id, {rounded('rmse')}, NULL::DOUBLE AS worst, NULL::BIGINT AS n FROM m
UNION ALL SELECT run_id, {rounded('rmse', 'worst')}, n FROM m"""

QUERIES = {
    "table_overwrite": (q_table_overwrite, soil_sql()),
    "daily_round_trip": (q_daily_round_trip, DAILY_SQL),
    "fields_csv": (q_fields_csv, FIELDS_SQL),
    "wide_csv_years": (q_wide_csv_years, WIDE_SQL),
    "prediction_log": (q_prediction_log, LOG_SQL),
    "metric_history": (q_metric_history, HISTORY_SQL),
}
