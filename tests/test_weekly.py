import math
from datetime import datetime

from helpers import plan, rows

from fieldlens.operators.assemble import assemble_weekly, enrich, unknown_fields
from fieldlens.operators.weekly import (
    climate_weekly,
    fill_ndvi,
    latest_per_week,
    soil_weekly,
    vegetation_weekly,
    weather_weekly,
)
from fieldlens.schemas import NDVI, SOIL, WEATHER

DAY = 86_400_000
MONDAY = 1_704_067_200_000  # 2024-01-01


def soil(spark, *values):
    base = [("f", "d", MONDAY + i * DAY, t, 40.0, 6.5, 80.0, 28.0, 125.0, mode)
            for i, (t, mode) in enumerate(values)]
    return spark.createDataFrame(base, SOIL)


def test_soil_weekly(spark):
    got = soil_weekly(soil(spark, (10.0, "NONE"), (14.0, "DROPOUT"), (None, "NONE"))).first()
    assert got.week_start == datetime(2024, 1, 1)
    assert (got.soil_temp_mean, got.soil_temp_min, got.soil_temp_max) == (12.0, 10.0, 14.0)
    assert math.isclose(got.soil_temp_std, math.sqrt(8))
    assert got.moisture_std == 0.0
    one = soil_weekly(soil(spark, (10.0, "NONE"))).first()
    assert one.soil_temp_std is None


def test_soil_weekly_masks_faults(spark):
    rows_ = soil(spark, (10.0, "NONE"), (0.0, "DROPOUT"), (0.0, "BURST"), (12.0, "DRIFT"))
    assert soil_weekly(rows_).first().soil_temp_mean == 5.5
    assert soil_weekly(rows_, mask_faults=True).first().soil_temp_mean == 11.0


def test_week_boundary(spark):
    df = soil(spark, *[(1.0, "NONE")] * 8)
    assert [r.week_start for r in soil_weekly(df).orderBy("week_start").collect()] == [
        datetime(2024, 1, 1), datetime(2024, 1, 8),
    ]


def test_weather_weekly_zero_fills_rain(spark):
    df = spark.createDataFrame(
        [("s", "f", MONDAY, None, None, 50.0, 1.0, "x"), ("s", "f", MONDAY, 4.0, 2.0, None, 3.0, "x"),
         ("s", "g", MONDAY, None, None, None, None, "x")], WEATHER)
    got = weather_weekly(df).orderBy("field_id").collect()
    assert tuple(got[0])[2:] == (4.0, 2.0, 50.0, 2.0)
    assert tuple(got[1])[2:] == (None, 0.0, None, None)


def test_climate_weekly_all_null_rain(frame):
    df = frame(
        "field_id string, date timestamp, T2M_MAX double, PRECTOTCORR double, RH2M double, WS2M double",
        ("f", "2024-01-02", 5.0, None, 80.0, 2.0), ("f", "2024-01-07", 7.0, None, 60.0, 4.0),
    )
    got = climate_weekly(df).first()
    assert (got.air_temp_mean, got.precip_total, got.humidity_mean) == (6.0, 0.0, 70.0)


def scenes(spark, *parts):
    base = [("f", s, MONDAY + d * DAY, v, 10.0, False, p, "x") for s, d, v, p in parts]
    return spark.createDataFrame(base, NDVI)


def test_latest_per_week_breaks_ties(spark):
    df = scenes(spark, ("a", 0, 0.1, False), ("b", 2, 0.2, False), ("c", 2, 0.3, None), ("d", 8, 0.4, None))
    got = latest_per_week(df)
    assert [r.scene_id for r in got.orderBy("week_start").collect()] == ["c", "d"]
    assert plan(got).count("WindowGroupLimit") == 2


def test_fill_ndvi_looks_one_row_back(spark):
    df = latest_per_week(
        scenes(spark, ("a", 0, 0.5, None), ("b", 7, None, True), ("c", 14, None, False), ("d", 21, 0.75, None))
    )
    got = fill_ndvi(df).orderBy("week_start").collect()
    assert [r.latest_ndvi for r in got] == [0.5, 0.5, None, 0.75]
    assert [r.ndvi_interpolated for r in got] == [False, True, True, False]
    assert [r.ndvi_proxied for r in got] == [False, True, False, False]
    known = fill_ndvi(df, ignore_nulls=True).orderBy("week_start").collect()
    assert [r.latest_ndvi for r in known] == [0.5, 0.5, 0.5, 0.75]


def test_assemble_keeps_soil_rows(spark, frame):
    soil_rows = soil_weekly(soil(spark, *[(1.0, "NONE")] * 8))
    weather = weather_weekly(
        spark.createDataFrame([("s", "f", MONDAY, 4.0, 2.0, 50.0, 1.0, "x")], WEATHER))
    veg = vegetation_weekly(scenes(spark, ("a", 8, 0.5, None)))
    labels = frame("field_id string, week_start timestamp, yield_kg_per_ha double", ("f", "2024-01-01", 5.0))
    got = assemble_weekly(soil_rows, weather, veg, labels)
    table = got.orderBy("week_start").collect()
    assert [(r.air_temp_mean, r.latest_ndvi, r.yield_kg_per_ha) for r in table] == [
        (4.0, None, 5.0), (None, 0.5, None),
    ]


def test_enrich_and_unknown(frame):
    facts = frame("field_id string, x int", ("a", 1), ("b", 2))
    dim = frame("field_id string, crop_type string", ("a", "wheat"))
    assert rows(enrich(facts, dim)) == [("a", 1, "wheat")]
    assert rows(unknown_fields(facts, dim)) == [("b", 2)]


def test_nan_counts_as_missing(frame):
    from fieldlens.operators.metrics import null_rates, range_violations
    from fieldlens.operators.quality import climate_gate
    from fieldlens.operators.weekly import climate_weekly, weather_weekly

    nan = float("nan")
    daily = frame(
        "field_id string, date timestamp, T2M_MAX double, T2M_MIN double, PRECTOTCORR double, RH2M double, WS2M double",
        ("f", "2024-01-01", 10.0, 1.0, nan, 50.0, 1.0), ("f", "2024-01-02", nan, 1.0, 2.0, 50.0, nan),
    )
    gate = climate_gate(daily).first()
    assert gate.max_null_rate == 0.5 and not gate.passed and not gate.temperature_out_of_range
    week = climate_weekly(daily).first()
    assert (week.air_temp_mean, week.precip_total, week.wind_speed_mean) == (10.0, 2.0, 1.0)
    rates = {r.column: r.null_rate for r in null_rates(daily, ["PRECTOTCORR", "RH2M"]).collect()}
    assert rates == {"PRECTOTCORR": 0.5, "RH2M": 0.0}
    assert not range_violations(daily).first().temperature_out_of_range
    rain = frame(
        "field_id string, timestamp long, temperature double, precipitation double, humidity double, wind_speed double",
        ("f", 0, 1.0, nan, 1.0, 1.0), ("f", 1, 3.0, 4.0, nan, 1.0),
    )
    row = weather_weekly(rain).first()
    assert (row.precip_total, row.humidity_mean, row.air_temp_mean) == (4.0, 1.0, 2.0)


def test_lookups_do_not_multiply_rows(frame):
    from fieldlens.operators.assemble import build_training_rows

    yields = frame(
        "ID long, grid_ID long, Crop string, east double, north double, Yield double",
        (1, 7, "x", 1.0, 1.0, 3.0), (1, 7, "x", 1.0, 1.0, 4.0),
    )
    sar = frame("ID long, sar_ratio_mean double, row_order long", (1, 500.0, 2), (1, 700.0, 1))
    soil = frame("grid_ID long, text string, awc double", (7, "2", 0.1), (7, "2", 0.2))
    climate = frame(
        "grid_ID long, temperature_2m_mean double, precipitation_sum double, "
        "shortwave_radiation_sum double, et0_fao_evapotranspiration double",
        (7, 1.0, 2.0, 3.0, 4.0), (7, 1.0, 2.0, 3.0, 5.0),
    )
    got = build_training_rows(yields, sar, climate, soil, 2020).collect()
    assert sorted(r.yield_kg_per_ha for r in got) == [3000.0, 4000.0]
    # the first in the order given, else the smallest
    assert {(r.ndvi, r.soil_moisture, r.et0_fao_evapotranspiration) for r in got} == {(0.7, 0.1, 4.0)}
