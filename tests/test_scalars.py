from datetime import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from fieldlens.functions import agronomy, scalars
from fieldlens.schemas import FEATURE_COLS, SOIL, TOPICS


def test_event_time_and_week(frame):
    df = frame("t bigint", (1700000000000,), (None,))
    at = scalars.event_time("t")
    got = rows(df.select(at.alias("at"), scalars.week_start(at).alias("w")), F.col("at").desc())
    assert got[0] == (datetime(2023, 11, 14, 22, 13, 20), datetime(2023, 11, 13))
    assert got[1] == (None, None)


@pytest.mark.parametrize(
    "year, week, monday",
    [
        (2015, 26, datetime(2015, 6, 22)),
        (2020, 53, datetime(2020, 12, 28)),
        (2021, 53, None),
        (2021, 1, datetime(2021, 1, 4)),
        (2015, 0, None),
        (2015, 60, None),
        (None, 5, None),
    ],
)
def test_iso_week(frame, year, week, monday):
    df = frame("y int, w int", (year, week))
    assert df.select(scalars.iso_week_monday("y", "w")).first()[0] == monday


def test_sentinel_clip_and_numbers(frame):
    df = frame(
        "i int, x double, s string", (1, -999.0, "3.5"), (2, 7.0, "oops"), (3, None, None),
        (4, float("nan"), "NaN"),
    )
    out = scalars.null_sentinel(df, ["x"]).select(
        "i", "x", scalars.clip("x", 0, 5).alias("c"), scalars.to_number("s").alias("n")
    )
    got = rows(out, "i")
    assert got[0] == (1, None, None, 3.5)
    assert got[1] == (2, 7.0, 5.0, None)
    assert got[2] == (3, None, None, None)
    assert got[3][3] is None
    zero = scalars.numbers_or_zero(df, ["x", "s"])
    assert rows(zero, "i") == [(1, -999.0, 3.5), (2, 7.0, 0.0), (3, 0.0, 0.0), (4, 0.0, 0.0)]


def test_encoders(frame):
    df = frame("i int, c string", (1, "Wheat"), (2, "OSR"), (3, "Kale"), (4, None))
    coded = scalars.encode_sorted(
        df.withColumn("m", scalars.encode_map("c", {"Wheat": 0, "OSR": 4}, 3)), "c", "s"
    )
    assert rows(coded.select("i", "m", "s"), "i") == [
        (1, 0, 2), (2, 4, 1), (3, 3, 0), (4, 3, None),
    ]


def test_grid(frame):
    lat, lon = scalars.grid_to_latlon("e", "n")
    got = frame("e double, n double", (400000.0, 100000.0)).select(lat, lon).first()
    assert tuple(got) == (52.5, -1.5)


def test_align_features_order_and_gaps(frame):
    df = frame("field_id string, lat string, ndvi double, junk int", ("a", "52.5", None, 9))
    out = scalars.align_features(df, keep=["field_id"])
    assert out.columns == ["field_id", *FEATURE_COLS]
    got = out.first()
    assert got.lat == 52.5 and got.ndvi == 0.0 and got.year == 0.0


def test_feature_cols_excludes_keys(frame):
    df = frame(
        "lat double, yield_kg_per_ha double, week_start timestamp, field_id string, year int",
        (1.0, 2.0, "2024-01-01", "a", 2024),
    )
    assert scalars.feature_cols(df) == ["lat", "year"]
    assert FEATURE_COLS[0] == "lat" and FEATURE_COLS[-1] == "year"


def test_schemas():
    assert [f.name for f in SOIL.fields][:3] == ["field_id", "device_id", "timestamp"]
    assert set(TOPICS) == {"soil-sensors", "weather-events", "satellite-ndvi"}


def test_expected_yield_and_proxies(frame):
    df = frame(
        "crop_type string, air_temp_mean double, air_temp_std double, precip_total double",
        ("winter_wheat", 20.0, None, 700.0),
        ("unknown", 20.0, 1.0, 15.0),
    )
    got = agronomy.expected_yield(agronomy.soil_proxies(df)).orderBy("crop_type").collect()
    wheat = got[1]
    assert wheat.expected_yield_kg_per_ha == pytest.approx(8000 + 10 * 40 + 20 * 16)
    assert wheat.soil_temp_mean == 17.0 and wheat.soil_temp_std == 0.0
    assert wheat.moisture_mean == 100.0 and wheat.moisture_std == 10.0
    assert got[0].expected_yield_kg_per_ha is None


def test_scene_ndvi(frame, spark):
    px = frame(
        "scene_id string, red double, nir double",
        ("a", 1.0, 3.0), ("a", 0.0, 0.0), ("a", 2.0, 2.0), ("a", None, 2.0), ("b", 0.0, 0.0),
    )
    assert rows(agronomy.scene_ndvi(px), "scene_id") == [("a", 0.25), ("b", None)]
    tiles = spark.createDataFrame(
        [("a", [1.0, 0.0], [3.0, 0.0]), ("a", [2.0, None], [2.0, 2.0]), ("b", [0.0], [0.0])],
        "scene_id string, red array<double>, nir array<double>",
    )
    assert rows(agronomy.scene_ndvi_tiles(tiles), "scene_id") == [("a", 0.25), ("b", None)]
