"""Error metrics, baselines, summaries, gates, promotion, time splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.tables import (
    METRIC_COLS,
    METRICS,
    PREDICTIONS,
    daily_climate,
    DAILY,
    load,
    predictions,
    rounded,
    scratch,
    shown,
    ts_sql,
    with_nan,
)
from fieldlens.operators.metrics import (
    compare_runs,
    crop_mean_fit,
    crop_mean_predict,
    cv_summary,
    interval_report,
    null_rates,
    promotion_decision,
    quality_gate,
    range_violations,
    regression_metrics,
    regression_metrics_by,
    season_of,
    summarise,
)
from fieldlens.operators.ranking import newest, sample
from fieldlens.operators.splits import temporal_split, time_folds
from fieldlens.plans.model import with_interval
from fieldlens.sources.tables import append_metrics, read_metrics

Y, P = "yield_kg_per_ha", "prediction"


def q_regression_metrics(spark, sf):
    return shown(regression_metrics(predictions(spark, sf), Y, P))


ALL_SQL = f"WITH {PREDICTIONS}, m AS (SELECT {METRICS} FROM pred) SELECT n, {METRIC_COLS} FROM m"


def q_regression_metrics_by(spark, sf):
    return shown(regression_metrics_by(predictions(spark, sf), ["crop_type"], Y, P))


BY_SQL = f"""WITH {PREDICTIONS}, m AS (SELECT crop_type, {METRICS} FROM pred GROUP BY ALL)
SELECT crop_type, n, {METRIC_COLS} FROM m"""


def q_regression_metrics_season(spark, sf):
    rows = predictions(spark, sf).withColumn("season", season_of("ts"))
    return shown(regression_metrics_by(rows, ["season"], Y, P))


SEASON_SQL = f"""WITH {PREDICTIONS}, m AS (SELECT CASE WHEN month(ts) BETWEEN 3 AND 5 THEN 'Spring'
    WHEN month(ts) BETWEEN 6 AND 8 THEN 'Summer' WHEN month(ts) BETWEEN 9 AND 11 THEN 'Autumn'
    ELSE 'Winter' END AS season, {METRICS} FROM pred GROUP BY ALL)
SELECT season, n, {METRIC_COLS} FROM m"""


def q_baseline_by_crop(spark, sf):
    """Mean price per brand on the older lines, tested on the newer; one brand is unseen."""
    rows = predictions(spark, sf)
    old = (F.col("ts") < "2000-01-01") & (F.col("crop_type") != "Brand#7")
    model = crop_mean_fit(rows.filter(old))
    test = rows.filter(F.col("ts") >= "2000-01-01").drop(P)
    guessed = crop_mean_predict(test, model)
    return shown(regression_metrics_by(guessed, ["crop_type"], Y, P), 4)


BASELINE_SQL = f"""WITH {PREDICTIONS}, train AS (
  SELECT * FROM pred WHERE ts < TIMESTAMP '2000-01-01' AND crop_type <> 'Brand#7'),
  means AS (SELECT crop_type, avg(y) AS m FROM train GROUP BY ALL),
  g AS (SELECT pred.crop_type, y, coalesce(m, (SELECT avg(y) FROM train)) AS p
    FROM pred LEFT JOIN means USING (crop_type) WHERE ts >= TIMESTAMP '2000-01-01'),
  s AS (SELECT crop_type, {METRICS} FROM g GROUP BY ALL)
SELECT crop_type, n, {rounded('rmse', 'mae', 'r2', digits=4)} FROM s"""


def q_null_rates(spark, sf):
    cols = ["PRECTOTCORR", "T2M_MAX", "T2M_MIN", "RH2M"]
    return shown(null_rates(with_nan(daily_climate(spark, sf)), cols))


NULL_SQL = f"""WITH {DAILY}, r AS (SELECT avg(CAST(PRECTOTCORR IS NULL AS INTEGER)) AS PRECTOTCORR,
    avg(CAST(T2M_MAX IS NULL AS INTEGER)) AS T2M_MAX, avg(CAST(T2M_MIN IS NULL AS INTEGER)) AS T2M_MIN,
    avg(CAST(RH2M IS NULL AS INTEGER)) AS RH2M FROM daily)
SELECT "column", round(null_rate, 6) AS null_rate
FROM (UNPIVOT r ON PRECTOTCORR, T2M_MAX, T2M_MIN, RH2M INTO NAME "column" VALUE null_rate)"""


def q_range_violations(spark, sf):
    shifted = daily_climate(spark, sf).withColumn("PRECTOTCORR", F.col("PRECTOTCORR") - 3)
    return range_violations(shifted, ["field_id"])


RANGE_SQL = f"""WITH {DAILY} SELECT field_id,
  coalesce(bool_or(T2M_MAX < -20 OR T2M_MAX > 50), FALSE) AS temperature_out_of_range,
  coalesce(bool_or(PRECTOTCORR - 3 < 0), FALSE) AS negative_rain FROM daily GROUP BY field_id"""


def q_summary(spark, sf):
    rows = predictions(spark, sf).select(
        Y, F.year("ts").alias("year"), F.col("l_suppkey").alias("field_id")
    )
    return shown(summarise(rows).withColumn("years", F.array_join("years", ",")))


SUMMARY_SQL = f"""WITH {PREDICTIONS}
SELECT count(*) AS n_rows, {rounded('min(y) AS min_target', 'max(y) AS max_target')},
  array_to_string(list_sort(list_distinct(list(year(ts)))), ',') AS years,
  count(DISTINCT l_suppkey) AS n_fields FROM pred"""


def folded_orders(spark, sf, n=5):
    return time_folds(load(spark, sf, "orders"), n, "o_orderdate", ["o_orderkey"])


def q_cv_summary(spark, sf):
    """Error of a flat guess per time fold, summarised."""
    folds = folded_orders(spark, sf).filter("fold > 0").withColumn("guess", F.lit(250000.0))
    return shown(cv_summary(regression_metrics_by(folds, ["fold"], "o_totalprice", "guess")), 4)


ORDERED = """ordered AS (SELECT *, row_number() OVER (
    ORDER BY o_orderdate, md5(CAST(o_orderkey AS VARCHAR))) - 1 AS pos, count(*) OVER () AS n
  FROM orders)"""
FOLDED = f"""{ORDERED}, folded AS (SELECT *, CASE WHEN pos < n - 5 * (n // 6) THEN 0
    ELSE (pos - (n - 5 * (n // 6))) // (n // 6) + 1 END AS fold FROM ordered)"""

CV_SQL = f"""WITH {FOLDED}, f AS (SELECT fold, o_totalprice AS y, 250000.0::DOUBLE AS p
    FROM folded WHERE fold > 0),
  m AS (SELECT fold, {METRICS} FROM f GROUP BY ALL)
SELECT {rounded('avg(rmse) AS cv_rmse_mean', 'stddev_pop(rmse) AS cv_rmse_std',
  'avg(mae) AS cv_mae_mean', 'avg(r2) AS cv_r2_mean', digits=4)} FROM m"""


def q_temporal_split(spark, sf):
    parts = temporal_split(load(spark, sf, "orders"), "o_orderdate", tie=["o_orderkey"])
    return parts.select("o_orderkey", "split")


SPLIT_SQL = f"""WITH {ORDERED} SELECT o_orderkey,
  CASE WHEN pos < CAST(floor(n * (1 - 0.2::DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM ordered"""


def q_temporal_split_weeks(spark, sf):
    parts = temporal_split(
        load(spark, sf, "lineitem"), "l_shipdate", 0.3, ["l_orderkey", "l_linenumber"], True
    )
    return shown(
        parts.groupBy("split").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("l_shipdate").alias("first"),
            F.max("l_shipdate").alias("last"),
        )
    )


WEEKS_SQL = f"""WITH o AS (SELECT l_shipdate, row_number() OVER (ORDER BY l_shipdate) - 1 AS pos,
    count(*) OVER () AS n FROM lineitem),
  c AS (SELECT l_shipdate AS cut FROM o WHERE pos = CAST(floor(n * (1 - 0.3::DOUBLE)) AS BIGINT))
SELECT CASE WHEN l_shipdate < cut THEN 'train' ELSE 'test' END AS split, count(*) AS n,
  {ts_sql('min(l_shipdate)')} AS first, {ts_sql('max(l_shipdate)')} AS last
FROM lineitem, c GROUP BY ALL"""


def q_time_folds(spark, sf):
    return folded_orders(spark, sf).select("o_orderkey", "fold")


FOLDS_SQL = f"WITH {FOLDED} SELECT o_orderkey, CAST(fold AS INTEGER) AS fold FROM folded"


def q_interval_report(spark, sf):
    ordered = with_interval(predictions(spark, sf))
    raw = interval_report(predictions(spark, sf), keys=["crop_type"])
    fixed = interval_report(ordered, keys=["crop_type"]).select(
        "crop_type", F.col("ordering_violations").alias("violations_after")
    )
    return shown(raw.join(fixed, "crop_type"))


INTERVAL_SQL = f"""WITH {PREDICTIONS} SELECT crop_type, count(*) AS n,
  count(*) FILTER (lo > p OR p > hi) AS ordering_violations,
  {rounded('avg(CAST(y BETWEEN lo AND hi AS INTEGER)) AS coverage', 'avg(hi - lo) AS mean_width')},
  CAST(0 AS BIGINT) AS violations_after FROM pred GROUP BY crop_type"""


# --- runs: one per year, with overall and per-brand errors ------------------------------


def run_metrics(spark, sf):
    rows = predictions(spark, sf).withColumn("run_id", F.year("ts").cast("string"))
    overall = regression_metrics_by(rows, ["run_id"], Y, P).select(
        "run_id", F.lit("holdout_rmse").alias("metric"), F.col("rmse").alias("value")
    )
    by_crop = regression_metrics_by(rows, ["run_id", "crop_type"], Y, P).select(
        "run_id", F.concat("crop_type", F.lit("_rmse")).alias("metric"), F.col("rmse").alias("value")
    )
    return overall.unionByName(by_crop).withColumn(
        "ts", F.to_timestamp(F.concat("run_id", F.lit("-12-31")))
    )


RUNS = f"""{PREDICTIONS}, m AS (
  SELECT CAST(year(ts) AS VARCHAR) AS run_id, 'holdout_rmse' AS metric,
    sqrt(avg((y - p) * (y - p))) AS value FROM pred GROUP BY ALL
  UNION ALL SELECT CAST(year(ts) AS VARCHAR), crop_type || '_rmse',
    sqrt(avg((y - p) * (y - p))) FROM pred GROUP BY year(ts), crop_type)"""


def q_quality_gate(spark, sf):
    return shown(quality_gate(run_metrics(spark, sf), 33000.0))


GATE_SQL = f"""WITH {RUNS} SELECT run_id, round(value, 6) AS rmse, value <= 33000 AS passed
FROM m WHERE metric = 'holdout_rmse'"""


def q_compare_runs(spark, sf):
    return shown(compare_runs(run_metrics(spark, sf), "1997", "1999"))


COMPARE_SQL = f"""WITH {RUNS} SELECT metric, round(max(value) FILTER (run_id = '1997'), 6) AS champion,
  round(max(value) FILTER (run_id = '1999'), 6) AS challenger
FROM m WHERE run_id IN ('1997', '1999') GROUP BY metric"""


def q_promotion_decision(spark, sf):
    """Every year against the year before, by the default rule and by the strict one."""
    path = f"{scratch(spark)}/metrics"
    append_metrics(run_metrics(spark, sf), path)
    metrics = read_metrics(spark, path)
    parts = []
    for year in range(1996, 2002):
        compared = compare_runs(metrics, str(year - 1), str(year))
        for rule, gain, strict in (("default", -0.01, False), ("strict", 0.0, True)):
            parts.append(
                promotion_decision(compared, gain, 0.2, strict=strict).select(
                    F.lit(year).alias("year"), F.lit(rule).alias("rule"), "*"
                )
            )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return shown(rows)


PROMOTION_SQL = f"""WITH {RUNS}, years AS (SELECT unnest(range(1996, 2002)) AS yr),
  c AS (SELECT yr, metric, max(value) FILTER (run_id = CAST(yr - 1 AS VARCHAR)) AS champion,
      max(value) FILTER (run_id = CAST(yr AS VARCHAR)) AS challenger
    FROM m JOIN years ON run_id IN (CAST(yr - 1 AS VARCHAR), CAST(yr AS VARCHAR)) GROUP BY ALL),
  l AS (SELECT *, CASE WHEN metric <> 'holdout_rmse' THEN (challenger - champion) / champion END
    AS loss FROM c),
  a AS (SELECT yr, max(champion) FILTER (metric = 'holdout_rmse') AS champion_rmse,
    max(challenger) FILTER (metric = 'holdout_rmse') AS challenger_rmse,
    max(loss) AS worst_crop_loss, arg_max(replace(metric, '_rmse', ''), loss) AS worst_crop
    FROM l GROUP BY yr),
  g AS (SELECT *, (champion_rmse - challenger_rmse) / champion_rmse AS gain FROM a),
  r AS (SELECT *, 'default' AS rule, gain >= -0.01 AS enough FROM g
    UNION ALL SELECT *, 'strict', gain > 0 FROM g),
  d AS (SELECT *, CASE WHEN NOT enough THEN 'gain_too_small' WHEN worst_crop_loss > 0.2
    THEN 'crop_regression' ELSE 'better' END AS reason FROM r)
SELECT CAST(yr AS INTEGER) AS year, rule, reason = 'better' AS promote, reason,
  {rounded('champion_rmse', 'challenger_rmse', 'gain', 'worst_crop_loss')}, worst_crop FROM d"""


# --- ordered reports -------------------------------------------------------------------


def q_sample_rows(spark, sf):
    rows = sample(load(spark, sf, "orders"), 100, ["o_orderdate", "o_orderkey"])
    return shown(rows.select("o_orderkey", "o_orderdate", "o_totalprice"))


SAMPLE_SQL = f"""SELECT o_orderkey, {ts_sql('o_orderdate')} AS o_orderdate,
  round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY orders.o_orderdate, o_orderkey LIMIT 100"""


def q_newest_row(spark, sf):
    row = newest(load(spark, sf, "orders"), "o_orderdate", ["o_orderkey"])
    return shown(row.select("o_orderkey", "o_orderdate", "o_totalprice"))


NEWEST_SQL = f"""SELECT o_orderkey, {ts_sql('o_orderdate')} AS o_orderdate,
  round(o_totalprice, 6) AS o_totalprice
FROM orders ORDER BY orders.o_orderdate DESC, o_orderkey DESC LIMIT 1"""

QUERIES = {
    "regression_metrics": (q_regression_metrics, ALL_SQL),
    "regression_metrics_by": (q_regression_metrics_by, BY_SQL),
    "regression_metrics_season": (q_regression_metrics_season, SEASON_SQL),
    "baseline_by_crop": (q_baseline_by_crop, BASELINE_SQL),
    "null_rates": (q_null_rates, NULL_SQL),
    "range_violations": (q_range_violations, RANGE_SQL),
    "summary": (q_summary, SUMMARY_SQL),
    "cv_summary": (q_cv_summary, CV_SQL),
    "temporal_split": (q_temporal_split, SPLIT_SQL),
    "temporal_split_weeks": (q_temporal_split_weeks, WEEKS_SQL),
    "time_folds": (q_time_folds, FOLDS_SQL),
    "interval_report": (q_interval_report, INTERVAL_SQL),
    "quality_gate": (q_quality_gate, GATE_SQL),
    "compare_runs": (q_compare_runs, COMPARE_SQL),
    "promotion_decision": (q_promotion_decision, PROMOTION_SQL),
    "sample_rows": (q_sample_rows, SAMPLE_SQL),
    "newest_row": (q_newest_row, NEWEST_SQL),
}
