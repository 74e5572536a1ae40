import random
from datetime import datetime, timedelta

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from fieldlens.operators import metrics as m
from fieldlens.operators.ranking import newest, ranked_importance, sample, top_contributions
from fieldlens.operators.splits import fold_parts, temporal_split, time_folds


def test_regression_metrics(frame):
    good = frame("y double, p double", (100.0, 100.0), (200.0, 200.0), (300.0, 300.0))
    assert rows(m.regression_metrics(good, "y", "p")) == [(3, 0.0, 0.0, 1.0)]
    off = frame("c string, y double, p double", ("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", 3.0, 4.0), ("b", 5.0, 5.0))
    got = m.regression_metrics_by(off, ["c"], "y", "p").orderBy("c").collect()
    assert got[0].r2 == pytest.approx(-0.5) and got[0].rmse == 1.0
    assert got[1].r2 == 1.0


def test_baseline(frame):
    train = frame("crop_type string, yield_kg_per_ha double", ("w", 10.0), ("w", 20.0), ("b", 60.0), (None, 30.0))
    model = m.crop_mean_fit(train)
    test = frame("i int, crop_type string", (1, "w"), (2, "b"), (3, "x"), (4, None))
    got = m.crop_mean_predict(test, model).orderBy("i").collect()
    assert [r.prediction for r in got] == [15.0, 60.0, 30.0, 30.0]


def test_null_rates_ranges_summary(frame):
    df = frame(
        "field_id string, year int, T2M_MAX double, PRECTOTCORR double, yield_kg_per_ha double",
        ("a", 2024, 51.0, 1.0, 5.0), ("a", 2023, None, -1.0, 7.0), ("b", 2024, 3.0, None, 6.0),
    )
    assert rows(m.null_rates(df, ["T2M_MAX", "year"]), "column") == [
        ("T2M_MAX", pytest.approx(1 / 3)), ("year", 0.0),
    ]
    assert rows(m.range_violations(df, ["field_id"]), "field_id") == [("a", True, True), ("b", False, False)]
    got = m.summarise(df).first()
    assert (got.n_rows, got.min_target, got.max_target, got.years, got.n_fields) == (3, 5.0, 7.0, [2023, 2024], 2)


def test_cv_summary_uses_population_spread(frame):
    df = frame("rmse double, mae double, r2 double", (1.0, 1.0, 0.5), (3.0, 2.0, 0.7))
    assert rows(m.cv_summary(df)) == [(2.0, 1.0, 1.5, pytest.approx(0.6))]


def test_interval_report(frame):
    df = frame(
        "yield_kg_per_ha double, prediction double, lower_bound double, upper_bound double",
        (5.0, 5.0, 4.0, 6.0), (9.0, 5.0, 6.0, 8.0),
    )
    assert rows(m.interval_report(df)) == [(2, 1, 0.5, 2.0)]


def run_rows(frame, **values):
    data = [(run, k, v, "2024-01-01") for run, table in values.items() for k, v in table.items()]
    return frame("run_id string, metric string, value double, ts timestamp", *data)


BASE = {"holdout_rmse": 100.0, "wheat_rmse": 50.0, "cv_rmse_mean": 9.0, "cv_fold_0_rmse": 1.0}


@pytest.mark.parametrize(
    "champion, challenger, promote, reason",
    [
        (BASE, {**BASE, "holdout_rmse": 98.0}, True, "better"),
        (BASE, {**BASE, "holdout_rmse": 98.5}, False, "gain_too_small"),
        (BASE, {**BASE, "holdout_rmse": 90.0, "wheat_rmse": 53.0}, False, "crop_regression"),
        (BASE, {**BASE, "holdout_rmse": 90.0, "wheat_rmse": 52.0, "cv_fold_0_rmse": 99.0}, True, "better"),
        (BASE, {"wheat_rmse": 50.0}, False, "missing_metric"),
        ({}, BASE, True, "no_champion"),
    ],
)
def test_promotion(frame, champion, challenger, promote, reason):
    table = run_rows(frame, a=champion, b=challenger)
    got = m.promotion_decision(m.compare_runs(table, "a", "b")).first()
    assert (got.promote, got.reason) == (promote, reason)


def test_strict_promotion_and_gate(frame):
    table = run_rows(frame, a=BASE, b=BASE)
    got = m.promotion_decision(m.compare_runs(table, "a", "b"), 0.0, strict=True).first()
    assert not got.promote
    assert rows(m.quality_gate(run_rows(frame, a={"holdout_rmse": 2000.0}, b={"holdout_rmse": 2000.1})), "run_id") == [
        ("a", 2000.0, True), ("b", 2000.1, False),
    ]


def weekly(frame, n, fields=1):
    data = [
        (f"f{f}", (datetime(2020, 1, 6) + timedelta(weeks=i)).isoformat(sep=" "), float(i))
        for i in range(n) for f in range(fields)
    ]
    random.Random(0).shuffle(data)
    return frame("field_id string, week_start timestamp, x double", *data)


def test_split_by_unique_weeks(frame):
    parts = temporal_split(weekly(frame, 100))
    train, test = (parts.filter(F.col("split") == s) for s in ("train", "test"))
    assert (train.count(), test.count()) == (80, 20)
    assert train.agg(F.max("week_start")).first()[0] < test.agg(F.min("week_start")).first()[0]


@pytest.mark.parametrize("n, fields", [(7, 9), (1, 50), (3, 1), (0, 1), (1, 1)])
def test_split_is_exact_inside_a_week(frame, n, fields):
    total = n * fields
    parts = temporal_split(weekly(frame, n, fields))
    counts = {r.split: r.n for r in parts.groupBy("split").agg(F.count("x").alias("n")).collect()}
    assert counts.get("train", 0) == int(total * 0.8)
    assert sum(counts.values()) == total
    if counts.get("train") and counts.get("test"):
        bounds = {r.split: r for r in parts.groupBy("split").agg(
            F.max("week_start").alias("hi"), F.min("week_start").alias("lo")).collect()}
        assert bounds["train"].hi <= bounds["test"].lo


def test_whole_weeks(frame):
    parts = temporal_split(weekly(frame, 7, 9), whole_weeks=True)
    assert parts.groupBy("week_start").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_missing_time_sorts_last(frame):
    df = frame("field_id string, week_start timestamp", ("a", None), ("b", "2024-01-01"), ("c", "2024-01-08"),
               ("d", "2024-01-15"), ("e", "2024-01-22"))
    parts = temporal_split(df)
    assert rows(parts.filter("split = 'test'").select("field_id")) == [("a",)]


@pytest.mark.parametrize("n, fields, folds", [(20, 1, 5), (13, 7, 5), (2, 11, 2), (3, 1, 5)])
def test_folds(frame, n, fields, folds):
    total = n * fields
    folded = time_folds(weekly(frame, n, fields), folds)
    part = total // (folds + 1)
    counts = {r.fold: r.n for r in folded.groupBy("fold").agg(F.count("x").alias("n")).collect()}
    assert counts.get(0, 0) == total - folds * part
    assert all(counts.get(k, 0) == part for k in range(1, folds + 1))
    for k in range(1, folds + 1):
        train, test = fold_parts(folded, k)
        if part:
            assert train.agg(F.max("week_start")).first()[0] <= test.agg(F.min("week_start")).first()[0]


def test_split_does_not_shuffle_facts(frame):
    text = plan(temporal_split(weekly(frame, 30, 3)))
    assert "Exchange" not in text and "Window" not in text


def test_ranking(frame):
    imp = frame("feature string, importance double", ("b", 0.2), ("a", 0.2), ("c", 0.6))
    assert [r.feature for r in ranked_importance(imp).collect()] == ["c", "a", "b"]
    df = frame("id int, x double, y double, z double", (1, -3.0, 1.0, 2.0))
    got = top_contributions(df, ["x", "y", "z"], 2).first().top
    assert [(t.feature, t.contribution) for t in got] == [("x", -3.0), ("z", 2.0)]
    assert sample(imp, 2, ["feature"]).count() == 2
    assert newest(imp, "importance").first().feature == "c"
    assert "TakeOrderedAndProject" in plan(sample(imp, 2, ["feature"]))
