"""Models fitted on line items with part attributes: scores, intervals, search, explanations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.features import FIELDS, event_weather, fields_of, labels_of
from checks.tables import READINGS, load, readings, rounded, scenes, scratch, shown
from fieldlens.operators.asof import live_features, monthly_defaults
from fieldlens.operators.drift import drift_level, drift_scores, psi_profile, rolling_buffer, to_long
from fieldlens.operators.metrics import (
    crop_mean_fit,
    crop_mean_predict,
    interval_report,
    regression_metrics_by,
)
from fieldlens.operators.ranking import ranked_importance, top_contributions
from fieldlens.operators.splits import temporal_split
from fieldlens.plans.model import (
    explain,
    fit_all,
    fit_mean,
    importance,
    predict_all,
    search,
    vectors,
    with_interval,
)
from fieldlens.operators.quality import SENSOR_SUITE
from fieldlens.plans.scoring import score
from fieldlens.plans.weekly_run import BadBatch, WeekInputs, online_table, run_week
from fieldlens.schemas import TARGET
from fieldlens.session import cut_lineage
from fieldlens.sources.tables import read_metrics

FEATURES = ["lat", "area_ha", "ndvi", "soil_moisture", "year"]


def training_rows(spark, sf):
    """The value of a line at list price, with a tenth of its own price as noise, by the line's columns.

    The prices of the given lines do not depend on the other columns, so they alone leave nothing to learn.
    """
    part = load(spark, sf, "part").select("p_partkey", "p_retailprice", "p_brand")
    lines = load(spark, sf, "lineitem")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("field_id"),
        F.date_trunc("week", "l_shipdate").alias("week_start"),
        F.col("l_quantity").alias("lat"),
        F.col("p_retailprice").alias("area_ha"),
        F.col("l_discount").alias("ndvi"),
        F.col("l_tax").alias("soil_moisture"),
        F.year("l_shipdate").alias("year"),
        F.col("p_brand").alias("crop_type"),
        (F.col("l_quantity") * F.col("p_retailprice") + F.col("l_extendedprice") / 10).alias(TARGET),
    )


def halves(spark, sf):
    # whole weeks: the split is then a date, which SQL can find as well
    parts = cut_lineage(temporal_split(training_rows(spark, sf), whole_weeks=True))
    return parts.filter("split = 'train'"), parts.filter("split = 'test'")


def fitted(spark, sf):
    train, test = halves(spark, sf)
    return train, test, fit_mean(train, features=FEATURES)


SPLIT = """rows AS (SELECT date_trunc('week', l_shipdate) AS w, p_brand AS crop_type
    FROM lineitem JOIN part ON l_partkey = p_partkey),
  o AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS pos, count(*) OVER () AS n FROM rows),
  cut AS (SELECT w AS first FROM o WHERE pos = CAST(floor(n * (1 - 0.2::DOUBLE)) AS BIGINT)),
  test AS (SELECT rows.* FROM rows, cut WHERE w >= first)"""


def q_yield_model_score(spark, sf):
    """Per brand: rows held out, and whether the trees beat the brand's mean price there."""
    train, test, model = fitted(spark, sf)
    scored = model.transform(vectors(test, FEATURES, [TARGET, "crop_type"]))
    trees = regression_metrics_by(scored, ["crop_type"], TARGET, "prediction")
    means = crop_mean_predict(test, crop_mean_fit(train, "crop_type", TARGET))
    plain = regression_metrics_by(means, ["crop_type"], TARGET, "prediction")
    plain = plain.select("crop_type", F.col("rmse").alias("baseline_rmse"))
    better = F.col("rmse") < F.col("baseline_rmse") / 2
    return trees.join(plain, "crop_type").select("crop_type", "n", better.alias("halves_the_error"))


SCORE_SQL = f"WITH {SPLIT} SELECT crop_type, count(*) AS n, TRUE AS halves_the_error FROM test GROUP BY crop_type"


def q_interval_model(spark, sf):
    """The 80 % interval on the holdout: rows, order, and whether its coverage is near what it says."""
    train, test = halves(spark, sf)
    scored = predict_all(fit_all(train, features=FEATURES), vectors(test, FEATURES, [TARGET]))
    report = interval_report(with_interval(scored))
    near = F.col("coverage").between(0.75, 0.85)
    return report.select("n", "ordering_violations", near.alias("covers"))


COVER_SQL = f"WITH {SPLIT} SELECT count(*) AS n, CAST(0 AS BIGINT) AS ordering_violations, TRUE AS covers FROM test"


def q_importance(spark, sf):
    """Every feature with the share it has, checked to be a share."""
    _, _, model = fitted(spark, sf)
    ranked = ranked_importance(importance(model, spark, FEATURES))
    # one row per feature
    total = F.sum("importance").over(Window.partitionBy(F.lit(1)))
    first = F.max("importance").over(Window.partitionBy(F.lit(1)))
    sound = (F.col("importance") >= 0) & (F.abs(total - 1) < 1e-6)
    # a price is its quantity times its list price
    leads = (F.col("importance") == first) == (F.col("feature") == "lat")
    return ranked.select("feature", sound.alias("is_share"), leads.alias("as_expected"))


IMPORTANCE_SQL = f"SELECT unnest({FEATURES}) AS feature, TRUE AS is_share, TRUE AS as_expected"


WEIGHTS = {"lat": 0.5, "area_ha": 0.3, "ndvi": 0.15, "soil_moisture": 0.05}


def q_explain(spark, sf):
    """Contributions of every line, the three largest first."""
    rows = explain(training_rows(spark, sf), WEIGHTS, FEATURES, ["field_id"])
    top = top_contributions(rows, FEATURES, 3)
    return top.select(
        "field_id",
        *[F.col(f) for f in FEATURES],
        F.array_join(F.transform("top", lambda t: t["feature"]), ",").alias("order"),
    )


EXPLAIN_SQL = """WITH c AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)
    AS field_id, round(l_quantity * 0.5::DOUBLE, 4) AS lat,
    round(p_retailprice * 0.3::DOUBLE, 4) AS area_ha, round(l_discount * 0.15::DOUBLE, 4) AS ndvi,
    round(l_tax * 0.05::DOUBLE, 4) AS soil_moisture, 0::DOUBLE AS year
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT *, array_to_string(list_transform(list_reverse_sort([
    {'s': abs(lat), 'f': 'lat'}, {'s': abs(area_ha), 'f': 'area_ha'}, {'s': abs(ndvi), 'f': 'ndvi'},
    {'s': abs(soil_moisture), 'f': 'soil_moisture'}, {'s': abs(year), 'f': 'year'}])[1:3],
  lambda x: x.f), ',') AS "order" FROM c"""


def q_heuristic_interval(spark, sf):
    rows = load(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("prediction"))
    return shown(with_interval(rows))


HEURISTIC_SQL = f"""SELECT p_partkey, {rounded('p_retailprice AS prediction',
  'p_retailprice * (1 - 0.15::DOUBLE) AS lower_bound',
  'p_retailprice * (1 + 0.15::DOUBLE) AS upper_bound')} FROM part"""


def q_search(spark, sf):
    """Three drawn settings, two time folds each."""
    draws = [
        {"max_depth": 3, "n_estimators": 3, "learning_rate": 0.3},
        {"max_depth": 4, "n_estimators": 3, "learning_rate": 0.5},
        {"max_depth": 2, "n_estimators": 3, "learning_rate": 0.3},
    ]
    found = search(
        training_rows(spark, sf), n_folds=2, features=FEATURES, draws=draws, parallelism=3
    )
    means = found.trials.groupBy("trial").agg(F.avg("rmse").alias("mean"))
    best = draws[means.orderBy("mean", "trial").first()["trial"]]
    return found.trials.select(
        "trial", "fold", ((F.col("rmse") > 0) & (F.col("r2") > 0)).alias("learns"),
        F.lit(found.best == best).alias("best_is_least"),
    )


SEARCH_SQL = """SELECT CAST(t AS INTEGER) AS trial, CAST(f AS INTEGER) AS fold, TRUE AS learns, TRUE AS best_is_least
FROM range(3) a(t), range(1, 3) b(f)"""


def q_score_fields(spark, sf):
    """Every customer scored as a field: dimension, live weather, drift verdict, model."""
    train = training_rows(spark, sf)
    names = ["lat", "lon", "area_ha", "temperature_2m_mean", "precipitation_sum", "year"]
    renamed = train.withColumns(
        {
            "temperature_2m_mean": F.col("ndvi") * 300,
            "precipitation_sum": F.col("soil_moisture") * 100,
            "lon": F.lit(0.0),
        }
    )
    model = fit_mean(renamed)
    fields = load(spark, sf, "customer").select(
        F.concat(F.lit("F"), "c_custkey").alias("field_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("double")).alias("lat"),
        F.lit(-1.5).alias("lon"),
        F.col("c_mktsegment").alias("crop_type"),
        F.lit("region").alias("region"),
        F.col("c_acctbal").alias("area_ha"),
        F.lit("loam").alias("soil_type"),
    )
    k = F.get_json_object("props", "$.k").cast("double")
    observed = load(spark, sf, "events").select(
        F.concat(F.lit("F"), "user_id").alias("field_id"),
        F.col("ts").alias("fetched_at"),
        "event_id",
        F.col("value").alias("rainfall_today_mm"),
        k.alias("t2m_max_today"),
        F.lit(12.0).alias("solar_radiation_today"),
        F.lit(2.5).alias("et0_today"),
    )
    cols = ["rainfall_today_mm", "t2m_max_today", "solar_radiation_today", "et0_today"]
    live = live_features(
        fields.select("field_id"), observed, monthly_defaults(spark),
        datetime(2024, 1, 16, 0, 30), cols, tie=["event_id"],
    )
    halfway = F.col("fetched_at") < "2024-01-16"
    profile = psi_profile(to_long(observed.filter(halfway), [], cols[:2]))
    recent = to_long(observed.filter(~halfway), ["field_id", "fetched_at", "event_id"], cols[:2])
    buffer = rolling_buffer(recent, ts="fetched_at", tie=["event_id"])
    drift = drift_level(drift_scores(buffer, profile))
    codes = {"crop_type": {"BUILDING": 0, "MACHINERY": 2}, "soil_type": {}, "region": {}}
    codes = {name: table or {"": 0} for name, table in codes.items()}
    return score(fields, live, drift, model, codes)


WEEK_FEATURES = ["soil_temp_mean", "moisture_mean", "ph_mean", "air_temp_mean", "area_ha"]


def q_weekly_run(spark, sf):
    """Two weekly runs over the events, the second with the first one's champion: what each step leaves.

    The fits have 20 trees: 750 rows and the steps around the fit are what is looked at.
    """
    soil = readings(spark, sf)
    calm = soil.withColumns({"temperature": F.col("moisture") / 2, "nitrogen": F.col("moisture"), "potassium": F.col("moisture")})
    inputs = WeekInputs(calm, event_weather(spark, sf), scenes(spark, sf), labels_of(spark, sf), fields_of(spark, sf),
                        {"soil": SENSOR_SUITE})
    root, out = scratch(spark), []
    for run_id, day in (("first", 8), ("second", 15)):
        report = run_week(root, inputs, WEEK_FEATURES, run_id, datetime(2024, 2, day), {"n_estimators": 20}, limit=1e9)
        steps = {
            "features": spark.read.parquet(f"{root}/features").count(),
            "online": online_table(spark.read.parquet(f"{root}/features").drop("week"), root).read().count(),
            "metrics": read_metrics(spark, f"{root}/metrics").filter(F.col("run_id") == run_id).count(),
            "passed": int(report.gate.filter("passed").count()),
            "promoted": int(report.promoted),
            "drift": report.drift.count(),
        }
        out += [(run_id, step, n) for step, n in steps.items()]
        out.append((run_id, "reason " + report.decision.first().reason, 1))
    try:
        bad = WeekInputs(soil, *[getattr(inputs, n) for n in ("weather", "scenes", "labels", "fields", "suites")])
        run_week(root, bad, WEEK_FEATURES, "third", datetime(2024, 2, 22))
    except BadBatch:
        out.append(("third", "stopped", 1))
    return spark.createDataFrame(out, "run_id string, step string, n long")


WEEKLY_SQL = f"""WITH {READINGS}, {FIELDS},
  f AS (SELECT DISTINCT field_id, week_start, crop_type FROM readings JOIN fields USING (field_id)),
  l AS (SELECT DISTINCT 'F' || user_id AS field_id, date_trunc('week', ts) AS week_start FROM events WHERE event_type = 'signup'
    AND value IS NOT NULL),
  t AS (SELECT f.*, row_number() OVER (ORDER BY week_start) - 1 AS pos, count(*) OVER () AS n
    FROM f JOIN l USING (field_id, week_start)),
  runs(run_id) AS (VALUES ('first'), ('second'))
SELECT run_id, 'features' AS step, (SELECT count(*) FROM f) AS n FROM runs
UNION ALL SELECT run_id, 'online', (SELECT count(DISTINCT field_id) FROM f) FROM runs
UNION ALL SELECT run_id, 'passed', 1 FROM runs
UNION ALL SELECT run_id, 'drift', {len(WEEK_FEATURES)} FROM runs
UNION ALL SELECT run_id, 'metrics', (SELECT count(DISTINCT crop_type) + 1 FROM t WHERE pos >= floor(n * 0.8)) FROM runs
UNION ALL SELECT 'first', 'promoted', 1 UNION ALL SELECT 'second', 'promoted', 0
UNION ALL SELECT 'first', 'reason no_champion', 1 UNION ALL SELECT 'second', 'reason gain_too_small', 1
UNION ALL SELECT 'third', 'stopped', 1"""


QUERIES = {
    "weekly_run": (q_weekly_run, WEEKLY_SQL),
    "yield_model_score": (q_yield_model_score, SCORE_SQL),
    "interval_model": (q_interval_model, COVER_SQL),
    "importance": (q_importance, IMPORTANCE_SQL),
    "explain": (q_explain, EXPLAIN_SQL),
    "heuristic_interval": (q_heuristic_interval, HEURISTIC_SQL),
    "search": (q_search, SEARCH_SQL),
    "score_fields": (q_score_fields, None),
}
