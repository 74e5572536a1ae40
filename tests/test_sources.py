from datetime import date, datetime

from helpers import plan, rows
from pyspark.sql import functions as F

from fieldlens.operators import assemble as a
from fieldlens.schemas import DAILY_CLIMATE, FIELDS, SOIL
from fieldlens.sources import tables as t
from fieldlens.sources.documents import (
    flatten_forecast,
    flatten_forecast_days,
    flatten_power,
    flatten_station,
)
from fieldlens.sources.topics import read_topic_files, to_messages, to_topic_files


def soil(spark, n, start=0):
    return spark.createDataFrame(
        [(f"f{i}", "d", i, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, "NONE") for i in range(start, start + n)], SOIL)


def test_landing_batches_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "soil")
    t.land(soil(spark, 3), path, 0)
    t.land(soil(spark, 2, 10), path, 1)
    t.land(soil(spark, 2, 10), path, 1)
    got = t.read_landing(spark, path, SOIL)
    assert got.count() == 5 and got.schema == SOIL


def test_write_table_replaces_only_present_weeks(spark, frame, tmp_path):
    path = str(tmp_path / "weekly")
    first = frame("field_id string, week string, x int", ("a", "2024-01-01", 1), ("a", "2024-01-08", 2))
    t.write_table(first, path, ["week"])
    t.write_table(frame("field_id string, week string, x int", ("a", "2024-01-08", 9)), path, ["week"])
    assert rows(t.read_table(spark, path).select("x"), "x") == [(1,), (9,)]
    t.write_table(first, path)
    assert t.read_table(spark, path).count() == 2


def test_daily_partitions_prune(spark, tmp_path):
    path = str(tmp_path / "daily")
    df = spark.createDataFrame(
        [(datetime(y, 5, d), 1.0, 2.0, float(d), 4.0, 5.0, 6.0, 7.0, f)
         for y in (2022, 2023) for d in (1, 2) for f in ("F001", "F002")], DAILY_CLIMATE)
    t.write_daily(df, path)
    t.write_daily(df.filter("field_id = 'F001' and year(date) = 2022"), path)
    got = t.read_daily(spark, path)
    assert got.count() == 8
    text = plan(got.filter("field_id = 'F001' and year = 2023").select("T2M_MAX"))
    assert "PartitionFilters: [isnotnull(field_id" in text
    assert "ReadSchema: struct<T2M_MAX:double>" in text


def test_daily_by_year_only(spark, tmp_path):
    path = str(tmp_path / "daily")
    df = spark.createDataFrame(
        [(datetime(y, 5, 1), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, f"F{i}")
         for y in (2022, 2023) for i in range(20)], DAILY_CLIMATE)
    t.write_daily(df, path, ["year"])
    got = t.read_daily(spark, path).filter("field_id = 'F7' and year = 2023")
    assert got.count() == 1 and "PushedFilters: [IsNotNull(field_id), EqualTo(field_id,F7)]" in plan(got)


def test_fields_csv(spark, tmp_path):
    (tmp_path / "fields.csv").write_text(
        "field_id,name,lat,lon,crop_type,region,area_ha,soil_type\n"
        "F001,Alpha Farm,52.0,-1.5,winter_wheat,East Anglia,50.0,clay\n")
    got = t.read_fields(spark, str(tmp_path / "fields.csv"))
    assert got.schema == FIELDS
    assert got.first().area_ha == 50.0


def test_wide_csv_to_training_rows(spark, tmp_path):
    (tmp_path / "yield.csv").write_text(
        "Unnamed: 0,ID,grid_ID,Crop,east,north,Yield,X2015.04.01,X2015.05.01,X2015.04.01.1,X2014.05.01\n"
        "0,1,10,Wheat,400000,100000,8.5,500,NA,3,1\n"
        "1,2,11,Kale,500000,200000,4.0,,,,1\n")
    (tmp_path / "tas.csv").write_text(
        "Unnamed: 0,grid_ID,X2015.03.01,X2015.04.01,X2015.09.30,X2015.10.01\n"
        "0,10,99,10,12,99\n1,10,99,20,,99\n2,11,99,,,99\n")
    (tmp_path / "soil.csv").write_text(
        "grid_ID,clay,sand,silt,awc,bd,fc,ks,text\n10,,1,1,,1,1,1,7\n10,5,1,1,0.2,1,1,1,8\n")
    y = t.read_wide_csv(spark, str(tmp_path / "yield.csv"), 2015)
    assert "Unnamed: 0" not in y.columns and y.first().Year == 2015
    sar = a.sar_features(y, 2015).orderBy("ID").collect()
    assert (sar[0].sar_ratio_mean, sar[0].sar_ratio_range, sar[0].sar_ratio_count) == (500.0, 0.0, 1)
    assert (sar[0].sar_ratio2_mean, sar[0].sar_ratio2_count) == (3.0, 1)
    assert (sar[1].sar_ratio_mean, sar[1].sar_ratio_count) == (None, 0)

    tas = t.read_wide_csv(spark, str(tmp_path / "tas.csv"))
    names = ["temperature_2m_mean", "precipitation_sum", "shortwave_radiation_sum",
             "et0_fao_evapotranspiration"]
    climate = a.climate_season({name: tas for name in names})
    # row means 11 and 20, then the mean of the rows
    assert rows(climate.select("grid_ID", names[0]), "grid_ID") == [("10", 15.5), ("11", None)]

    raw = t.read_wide_csv(spark, str(tmp_path / "soil.csv")).withColumn("o", F.monotonically_increasing_id())
    soil_rows = a.soil_by_grid(raw, "o")
    assert rows(soil_rows.select("clay", "awc", "text")) == [("5", "0.2", "7")]

    got = a.build_training_rows(y, a.sar_features(y, 2015), climate, soil_rows, 2015).orderBy("field_id").collect()
    assert (got[0].crop_type_encoded, got[0].soil_type_encoded, got[0].soil_moisture, got[0].ndvi) == (0, 7, 0.2, 0.5)
    assert (got[0].lat, got[0].lon, got[0].yield_kg_per_ha) == (52.5, -1.5, 8500.0)
    # a present cell keeps its null, a missing soil cell gets the defaults
    assert (got[1].crop_type_encoded, got[1].temperature_2m_mean, got[1].soil_type_encoded) == (3, None, 0)
    assert (got[1].soil_moisture, got[1].ndvi) == (0.35, 0.5)
    assert got[0].week_start == datetime(2015, 6, 22)


def test_climate_cell_must_be_in_every_table(frame):
    one = frame("grid_ID string, X0 string", ("1", "x")).withColumnRenamed("X0", "X2015.05.01")
    two = frame("grid_ID string, X0 string", ("2", "4")).withColumnRenamed("X0", "X2015.05.01")
    assert a.climate_season({"p": one, "q": two}).count() == 0


def test_prediction_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "p.jsonl").write_text(
        '{"ts": "2026-05-03T10:46:56.224590+00:00", "field_id": "field_1", '
        '"predicted_yield_kg_per_ha": 4941.4, "lower_bound": 4200.2, "upper_bound": 5682.6, "model_version": "1"}\n')
    path = str(tmp_path / "log")
    got = t.read_predictions(spark, path)
    assert got.first().ts == datetime(2026, 5, 3, 10, 46, 56, 224590)
    kept = spark.createDataFrame(got.collect(), got.schema)
    t.append_predictions(kept, path)
    again = t.read_predictions(spark, path)
    assert again.count() == 2 and again.select("ts").distinct().count() == 1


def test_metric_history_gains_columns(spark, frame, tmp_path):
    path = str(tmp_path / "metrics")
    t.append_metrics(frame("run_id string, value double", ("a", 1.0)), path)
    t.append_metrics(frame("run_id string, value double, note string", ("b", 2.0, "x")), path)
    assert rows(t.read_metrics(spark, path).select("run_id", "note"), "run_id") == [("a", None), ("b", "x")]


def test_unions(frame):
    x, y = frame("a int, b int", (1, 2)), frame("b int, a int", (4, 3))
    assert rows(a.union_all([x, y]), "a") == [(1, 2), (3, 4)]
    assert rows(a.union_relaxed(x, frame("a int, c int", (5, 6))), "a") == [(1, 2, None), (5, None, 6)]


def test_topic_files(spark, tmp_path):
    path = str(tmp_path / "topic")
    to_topic_files(soil(spark, 2), "field_id", path)
    got = read_topic_files(spark, path, stream=False)
    assert {r.key for r in got.collect()} == {"f0", "f1"}
    assert '"timestamp":0' in to_messages(soil(spark, 1), "field_id").first().value


def test_power_document(spark):
    doc = ('{"properties":{"parameter":{"T2M_MAX":{"20240101":5.5,"20240102":-999.0},'
           '"PRECTOTCORR":{"20240101":0.0,"20240103":2.0},"OTHER":{"20240101":1}}}}')
    got = flatten_power(spark.createDataFrame([("f", doc)], "field_id string, value string"))
    table = got.select("date", "T2M_MAX", "PRECTOTCORR", "RH2M")
    assert rows(table, "date") == [
        (datetime(2024, 1, 1), 5.5, 0.0, None), (datetime(2024, 1, 2), None, None, None),
        (datetime(2024, 1, 3), None, 2.0, None),
    ]


def test_forecast_document(spark):
    doc = '{"daily":{"time":["2024-01-01","2024-01-02"],"precipitation_sum":[1.5,2.5],"temperature_2m_max":[null,9]}}'
    df = spark.createDataFrame([("f", doc), ("g", '{"daily":{"precipitation_sum":[]}}'), ("h", "{}")],
                               "field_id string, value string")
    got = flatten_forecast(df, date(2024, 1, 1)).select("field_id", "rainfall_today_mm", "t2m_max_today", "forecast_date")
    assert rows(got, "field_id") == [("f", 1.5, None, "2024-01-01"), ("g", None, None, "2024-01-01"), ("h", None, None, "2024-01-01")]
    days = flatten_forecast_days(df).select("day_offset", "date", "t2m_max_today")
    assert rows(days, "day_offset") == [(0, date(2024, 1, 1), None), (1, date(2024, 1, 2), 9.0)]


def test_station_document(spark):
    def doc(*pairs):
        return '{"results":[' + ",".join(f'{{"datatype":"{k}","value":{v}}}' for k, v in pairs) + "]}"

    df = spark.createDataFrame(
        [("s1", doc(("TMAX", 0), ("TMIN", -50), ("PRCP", 12), ("AWND", 35))), ("s2", doc(("TMIN", 41))),
         ("s3", doc(("TMAX", 10), ("TMAX", 20))), ("s4", "{}")], "station_id string, value string")
    stations = spark.createDataFrame([("s1", "field_001")], "station_id string, field_id string")
    got = flatten_station(df, stations, F.timestamp_millis(F.lit(5))).orderBy("station_id").collect()
    assert [(r.field_id, r.temperature, r.precipitation, r.wind_speed) for r in got] == [
        ("field_001", 0.0, 1.2, 3.5), ("unknown", 4.1, 0.0, None), ("unknown", 2.0, 0.0, None),
        ("unknown", None, 0.0, None),
    ]
    assert got[0].timestamp == 5 and got[0].humidity is None and got[0].source == "noaa_ghcn"
