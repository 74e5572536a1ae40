from datetime import datetime

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from fieldlens.operators.quality import (
    FEATURE_CONTRACT,
    NDVI_SUITE,
    SENSOR_SUITE,
    WEATHER_SUITE,
    Between,
    Increasing,
    InSet,
    NotNull,
    check_contract,
    climate_gate,
    dead_letter,
    gated,
    split_rows,
    strictly_increasing,
    validate,
    verdict,
)
from fieldlens.schemas import NDVI, SOIL, WEATHER


def test_checks(frame):
    df = frame("x double, s string", *[(float(i), "a") for i in range(19)], (None, "zz"), (-1.0, None))
    got = {(r.check, r.column): r for r in validate(
        df, [NotNull("x"), Between("x", 0, 50, 0.95), Between("x", 0, 50, 0.96), InSet("s", ("a",))]
    ).collect()}
    assert (got["not_null", "x"].n_checked, got["not_null", "x"].n_bad) == (21, 1)
    assert not got["not_null", "x"].success
    assert (got["in_set", "s"].n_checked, got["in_set", "s"].n_bad) == (20, 1)
    both = validate(df, [Between("x", 0, 50, 0.95), Between("x", 0, 50, 0.96)]).orderBy("mostly").collect()
    # 19 of 20 non-null values are in range
    assert [r.success for r in both] == [True, False]


def test_all_null_column_passes_range(frame):
    df = frame("x double", (None,), (None,))
    assert validate(df, [Between("x", 0, 1)]).first().success


def test_reference_batch_is_valid(spark):
    df = spark.createDataFrame(
        [("field_001", "sensor_001", 1700000000000, 22.5, 45.2, 6.5, 85.0, 28.0, 125.0, "NONE"),
         ("field_002", "sensor_002", 1700000060000, 24.1, 51.3, 6.8, 92.0, 31.0, 118.0, "NONE")], SOIL)
    suite = [*SENSOR_SUITE, Increasing("timestamp", "timestamp")]
    assert verdict(validate(df, suite)).first().valid
    broken = df.withColumn("fault_mode", F.lit("ODD"))
    assert rows(verdict(validate(broken, suite))) == [(False, 1)]
    good, bad = split_rows(broken.unionByName(df), SENSOR_SUITE)
    assert (good.count(), bad.count()) == (2, 2)


def test_plain_checks_are_one_aggregation(spark):
    text = plan(validate(spark.createDataFrame([], SOIL), SENSOR_SUITE))
    assert text.count("Exchange") == 1


def test_other_suites(spark):
    weather = spark.createDataFrame([("s", "f", 1, 60.0, 1.0, 50.0, 3.0, "x"), ("s", "f", 2, None, 1.0, 50.0, 3.0, "x")], WEATHER)
    failed = validate(weather, WEATHER_SUITE).filter("not success")
    assert rows(failed.select("check", "column"), "check") == [("between", "temperature"), ("not_null", "temperature")]
    ndvi = spark.createDataFrame([("f", "s", 1, 0.5, 101.0, None, True, "x")], NDVI)
    assert rows(validate(ndvi, NDVI_SUITE).filter("not success").select("column")) == [("cloud_cover_pct",)]


@pytest.mark.parametrize("width", [1.0, 3.0, 1000.0])
def test_increasing_in_stretches(frame, width):
    data = [("a", i, v) for i, v in enumerate([1, 2, 2, 5, 4, 6, 7, 8, 8, 9])]
    data += [("b", i * 7, i) for i in range(5)] + [("c", 1, None), ("c", 2, 3)]
    df = frame("k string, o int, v int", *data)
    got = strictly_increasing(df, "v", "o", ["k"], width)
    assert rows(got, "k") == [("a", 9, 3, False), ("b", 4, 0, True), ("c", 0, 0, True)]


def test_increasing_by_time(frame):
    df = frame("o timestamp, v int", ("2024-01-01", 1), ("2024-01-05", 2), ("2024-01-09", 2))
    assert rows(strictly_increasing(df, "v", "o")) == [(2, 1, False)]


def test_contract(frame):
    df = frame(
        "rainfall_today_mm double, t2m_max_today string, et0_today double, ndvi_latest double",
        *[(1.0, "x", None, 0.5)] * 19, (None, "x", 25.0, None),
    )
    got = {r.feature: r for r in check_contract(df).collect()}
    assert len(got) == len(FEATURE_CONTRACT) == 11
    assert got["rainfall_today_mm"].success and got["rainfall_today_mm"].null_rate == 0.05
    assert not got["t2m_max_today"].type_ok and not got["t2m_max_today"].success
    assert got["et0_today"].n_out_of_range == 1 and not got["et0_today"].success
    assert got["ndvi_latest"].success
    assert not got["gdd_accumulation"].present and not got["gdd_accumulation"].success


def test_climate_gate(frame):
    good = [("ok", 1.0, 10.0, 1.0, 50.0)] * 20
    df = frame(
        "field_id string, PRECTOTCORR double, T2M_MAX double, T2M_MIN double, RH2M double",
        *good, ("nulls", None, 1.0, 1.0, 1.0), ("hot", 1.0, 51.0, 1.0, 1.0), ("rain", -0.1, 1.0, 1.0, 1.0),
        ("ok", 1.0, None, 1.0, 50.0),
    )
    assert rows(climate_gate(df).select("field_id", "passed"), "field_id") == [
        ("hot", False), ("nulls", False), ("ok", True), ("rain", False),
    ]
    assert {r.field_id for r in gated(df).collect()} == {"ok"}


def test_dead_letters(spark):
    raw = spark.createDataFrame(
        [("a", '{"field_id":"a","device_id":"d","timestamp":1,"temperature":2.5}'),
         ("b", '{"field_id":"b","buffered_value":3}'), ("c", "not json"), ("d", None)],
        "key string, value string")
    at = F.timestamp_millis(F.lit(1700000000000))
    good, bad = dead_letter(raw, SOIL, ["field_id", "timestamp"], at)
    assert rows(good.select("field_id", "timestamp", "temperature", "fault_mode")) == [("a", 1, 2.5, None)]
    assert rows(bad.select("key", "error", "timestamp"), "key") == [
        ("b", "missing_timestamp", 1700000000000), ("c", "malformed_json", 1700000000000),
        ("d", "malformed_json", 1700000000000),
    ]
