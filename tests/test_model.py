from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import plan
from pyspark.sql import functions as F

from fieldlens.operators.metrics import interval_report, regression_metrics
from fieldlens.operators.quality import SENSOR_SUITE
from fieldlens.plans import model as pm
from fieldlens.plans import weekly_run
from fieldlens.plans.scoring import OUTPUT, score
from fieldlens.schemas import FEATURE_COLS, FIELDS, SOIL, TARGET

SMALL = {"n_estimators": 10, "max_depth": 4, "learning_rate": 0.3}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(42)
    data = rng.uniform(0, 1, (500, len(FEATURE_COLS)))
    rows = []
    for i, row in enumerate(data):
        y = 2000 * row[0] + 300 * row[7] + rng.normal(0, 200)
        rows.append((f"f{i % 5}", datetime(2020, 1, 6) + timedelta(weeks=i // 5), "abc"[i % 3], *map(float, row), float(y)))
    cols = ", ".join(f"{c} double" for c in FEATURE_COLS)
    return spark.createDataFrame(
        rows, f"field_id string, week_start timestamp, crop_type string, {cols}, {TARGET} double").cache()


@pytest.fixture(scope="module")
def fitted(table):
    return pm.fit_mean(table, SMALL)


def test_mean_model_beats_the_mean(table, fitted):
    scored = fitted.transform(pm.vectors(table, keep=[TARGET]))
    assert regression_metrics(scored, TARGET, "prediction").first().r2 > 0.5


def test_importance_and_explain(spark, table, fitted):
    imp = pm.importance(fitted, spark)
    table_ = {r.feature: r.importance for r in imp.collect()}
    assert list(table_) == FEATURE_COLS and min(table_.values()) >= 0 and sum(table_.values()) > 0
    assert max(table_, key=table_.get) == "lat"
    got = pm.explain(table.limit(1), {"lat": 3.0, "ndvi": 1.0}, keep=["field_id"]).first()
    row = table.limit(1).first()
    assert got.lat == round(row.lat * 0.75, 4) and got.year == 0.0
    assert pm.explain(table.limit(1), {}).first().lat == 0.0


def test_interval_is_ordered_and_covers(spark):
    rng = np.random.default_rng(7)

    def sample(n):
        x = rng.uniform(0, 1, n)
        noise = np.where(x < 0.5, 1.0, 2.0) * rng.normal(0, 4, n)
        return spark.createDataFrame(
            [(float(a), float(10 * a + b)) for a, b in zip(x, noise)], f"lat double, {TARGET} double")

    train, test = sample(4000), sample(2000)
    mean = pm.fit_mean(train, {**SMALL, "n_estimators": 5}, ["lat"])
    bounds = pm.fit_interval(train, n_trees=10, features=["lat"])
    scored = pm.predict_interval(bounds, mean.transform(pm.vectors(test, ["lat"], [TARGET])))
    got = interval_report(pm.with_interval(scored)).first()
    assert got.ordering_violations == 0 and 0.75 <= got.coverage <= 0.85
    halves = scored.withColumn("wide", F.col("prediction") > 5).groupBy("wide").agg(
        F.avg(F.col("upper_bound") - F.col("lower_bound")).alias("w"))
    width = {r.wide: r.w for r in halves.collect()}
    assert width[True] > 1.5 * width[False]
    text = plan(scored)
    assert "Python" not in text and "Join" not in text


def test_fallback_interval(frame):
    got = pm.with_interval(frame("prediction double", (100.0,), (None,))).collect()
    assert (got[0].lower_bound, got[0].upper_bound) == (85.0, pytest.approx(115.0))
    assert got[1].lower_bound is None
    crossed = frame("prediction double, lower_bound double, upper_bound double", (5.0, 6.0, 4.0))
    assert tuple(pm.with_interval(crossed).first()) == (5.0, 5.0, 5.0)


def test_draws_and_search(table):
    draws = pm.draw_params(50)
    assert draws == pm.draw_params(50) and len(draws) == 50
    assert all(4 <= d["max_depth"] <= 10 and 0.01 <= d["learning_rate"] <= 0.3 and 100 <= d["n_estimators"] <= 1000
               and 0.6 <= d["subsample"] <= 1 and 1 <= d["min_child"] <= 10 for d in draws)
    settings = [{"n_estimators": 1, "max_depth": 1}, {"n_estimators": 8, "max_depth": 4, "learning_rate": 0.3}]
    found = pm.search(table, n_folds=2, draws=settings)
    assert found.best == settings[1]
    assert found.trials.count() == 4


def fields(spark):
    return spark.createDataFrame(
        [("F001", "Alpha Farm", 52.0, -1.5, "winter_wheat", "East Anglia", 50.0, "clay"),
         ("F002", "Bravo Farm", 53.0, -2.0, "winter_barley", "Yorkshire", 80.0, "sandy_loam"),
         ("F003", "Charlie Farm", None, 0.5, "oilseed_rape", "Midlands", 30.0, "loam"),
         ("F004", None, 51.0, 0.5, "oilseed_rape", "Midlands", 30.0, "loam")], FIELDS)


def test_score_every_field(spark, frame, table):
    grown = table.withColumns({"lat": F.col("lat") * 4 + 50, "precipitation_sum": F.col("precipitation_sum") * 10})
    fitted = pm.fit_mean(grown, SMALL)
    live = frame(
        "field_id string, rainfall_today_mm double, t2m_max_today double, solar_radiation_today double, "
        "et0_today double, forecast_date string, stale_features boolean",
        ("F001", 0.5, 12.0, 3.0, 1.0, "2024-06-01", False), ("F002", 9.5, 14.0, 3.0, 1.0, "2024-06-01", True),
        ("F003", 0.5, 12.0, 3.0, 1.0, "2024-06-01", False))
    drift = frame("field_id string, drift_warning boolean, drift_level string", ("F002", True, "red"), ("F003", True, "red"))
    codes = {"crop_type": {"winter_wheat": 0, "winter_barley": 2}, "soil_type": {"clay": 1}, "region": {"Yorkshire": 3}}
    out = score(fields(spark), live, drift, fitted, codes)
    assert out.columns == OUTPUT
    got = {r.field_id: r for r in out.collect()}
    assert len(got) == 4
    a, b, c, d = (got[f"F00{i}"] for i in range(1, 5))
    assert a.error is None and a.lower_bound < a.predicted_yield_kg_ha < a.upper_bound
    assert a.predicted_yield_kg_ha != b.predicted_yield_kg_ha
    assert (a.drift_level, b.drift_level, b.drift_warning, b.stale_features) == ("green", "red", True, True)
    assert (c.error, c.predicted_yield_kg_ha, c.drift_level, c.drift_warning) == ("missing_location", None, "none", False)
    assert (d.error, d.name, d.temp_c) == ("missing_live_features", "F004", None)


def test_weekly_run(spark, table):
    bad = spark.createDataFrame([("f", "d", 1, 99.0, 30.0, 6.5, 80.0, 30.0, 120.0, "NONE")], SOIL)
    with pytest.raises(weekly_run.BadBatch):
        weekly_run.checked(bad, SENSOR_SUITE, "soil")
    got = weekly_run.train_and_judge(table, FEATURE_COLS, SMALL)
    assert got.holdout.first().n == 100
    assert got.by_crop.count() == 3
