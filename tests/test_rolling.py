from datetime import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from fieldlens.operators.rolling import gdd, per_day, rate, rolling_sum
from fieldlens.operators.telemetry import (
    LATENCY_BUCKETS,
    bucket_histogram,
    freshness,
    histogram_quantile,
    usage_counts,
    yield_summary,
)


def test_rolling_sum_by_calendar_days(frame):
    df = frame("field_id string, ts timestamp, r double", ("f", "2024-01-01 03:00:00", 1.0),
               ("f", "2024-01-01 09:00:00", 2.0), ("f", "2024-01-30", 4.0), ("f", "2024-01-31", 8.0), ("g", "2024-01-30", 16.0))
    got = rolling_sum(per_day(df, {"r": "sum"}), "r")
    assert [r.r_30d for r in got.orderBy("field_id", "date").collect()] == [3.0, 7.0, 12.0, 16.0]


def test_gdd(frame):
    daily = frame("field_id string, date timestamp, T2M_MAX double, T2M_MIN double",
                  ("f", "2024-03-01", 30.0, 20.0), ("f", "2024-03-02", 10.0, 4.0),
                  ("f", "2024-03-03", 5.0, 1.0), ("f", "2024-03-04", None, 4.0), ("f", "2024-03-05", 16.0, 4.0))
    sowing = frame("field_id string, sowing_date timestamp", ("f", "2024-03-02"))
    got = gdd(daily, sowing).orderBy("date").collect()
    assert [r.gdd_accumulation for r in got] == [2.0, 2.0, 2.0, 7.0]


def test_rate_counts_each_event_in_every_window(frame):
    log = frame("ts timestamp, crop string", ("2024-01-01 00:07:00", "w"), ("2024-01-01 00:12:00", "w"))
    got = rate(log, "10 minutes", "5 minutes", ["crop"]).orderBy("window_end").collect()
    assert [(r.window_end.minute, r.increase) for r in got] == [(10, 1), (15, 2), (20, 1)]
    assert got[1].rate_per_second == pytest.approx(2 / 600)


def test_histogram_and_quantile(frame):
    df = frame("k string, x double", *[("a", v) for v in (0.04, 0.05, 0.2, 0.3, 9.0, None)], ("b", 8.0))
    buckets = bucket_histogram(df, "x", LATENCY_BUCKETS, ["k"])
    got = rows(buckets.filter("k = 'a'").select("le", "count"), "le")
    assert got[:3] == [(0.05, 2), (0.1, 2), (0.25, 3)] and got[-1] == (float("inf"), 5)
    q = {r.k: r.quantile for r in histogram_quantile(buckets, 0.5, ["k"]).collect()}
    # rank 2.5 lies in the bucket (0.1, 0.25] that takes the count from 2 to 3
    assert q["a"] == pytest.approx(0.1 + 0.15 * 0.5) and q["b"] == 5.0
    assert histogram_quantile(bucket_histogram(df.filter("false"), "x", [1.0]), 0.5).first().quantile is None


def test_usage_and_summary(frame):
    log = frame("ts timestamp, crop_type string, predicted_yield_kg_per_ha double",
                ("2024-01-01", "w", 1.0), ("2024-01-03", "w", 2.0), ("2024-01-02", "b", None))
    assert rows(usage_counts(log, ["crop_type"]), "crop_type") == [
        ("b", 1, datetime(2024, 1, 2)), ("w", 2, datetime(2024, 1, 3))]
    assert rows(yield_summary(log), "crop_type") == [("b", 0, None), ("w", 2, 3.0)]


def test_freshness(frame):
    df = frame("ts timestamp", ("2024-01-01",), (None,))
    assert freshness(df, "ts", datetime(2024, 1, 2, 0, 59)).first().fresh
    assert not freshness(df, "ts", datetime(2024, 1, 2, 1)).first().fresh
    assert not freshness(df.filter("false"), "ts", datetime(2024, 1, 2)).first().fresh


def test_rates_of_several_windows_from_one_count(spark):
    import random
    from collections import Counter
    from datetime import datetime, timedelta

    from fieldlens.operators.rolling import rates

    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows_ = [(rng.choice("ab"), start + timedelta(seconds=rng.choice([5, 700, 90_000]) * rng.randrange(60))) for _ in range(150)]
    log = spark.createDataFrame([*rows_, ("a", None)], "k string, ts timestamp")
    lengths = {"10 minutes": 600, "1 hour": 3600, "24 hours": 86_400}
    want = Counter()
    for k, ts in rows_:
        pane = int((ts - datetime(1970, 1, 1)).total_seconds()) // 600
        for w, n in lengths.items():
            for e in range(pane + 1, pane + 1 + n // 600):
                want[k, w, e * 600] += 1
    got = rates(log, list(lengths), "10 minutes", ["k"]).withColumn("at", F.unix_seconds("window_end")).collect()
    assert {(r.k, r.window, r.at): r.increase for r in got} == dict(want)
    assert all(r.rate_per_second == r.increase / lengths[r.window] for r in got)
    assert rates(log.limit(0), ["1 hour"], "1 hour").collect() == []
