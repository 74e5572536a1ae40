"""Declared schemas for every source. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def struct(spec: str) -> T.StructType:
    """Schema from "name type, …"; usable before a session exists."""
    pairs = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


# --- fixed values: event contracts ------------------------------------------------
SOIL = struct(
    "field_id string, device_id string, timestamp bigint, temperature float, moisture float, "
    "ph float, nitrogen float, phosphorus float, potassium float, fault_mode string"
)
WEATHER = struct(
    "station_id string, field_id string, timestamp bigint, temperature float, "
    "precipitation float, humidity float, wind_speed float, source string"
)
NDVI = struct(
    "field_id string, scene_id string, timestamp bigint, ndvi float, cloud_cover_pct float, "
    "ndvi_interpolated boolean, ndvi_proxied boolean, source string"
)
DEAD_LETTER = struct("station_id string, error string, timestamp bigint")

TOPICS = {"soil-sensors": SOIL, "weather-events": WEATHER, "satellite-ndvi": NDVI}

# --- fixed values: tables ---------------------------------------------------------
DAILY_CLIMATE = struct(
    "date timestamp, PRECTOTCORR double, ALLSKY_SFC_SW_DWN double, T2M_MAX double, "
    "T2M_MIN double, RH2M double, WS2M double, EVPTRNS double, field_id string"
)
CLIMATE_PARAMETERS = [
    "PRECTOTCORR",
    "ALLSKY_SFC_SW_DWN",
    "T2M_MAX",
    "T2M_MIN",
    "RH2M",
    "WS2M",
    "EVPTRNS",
]
FIELDS = struct(
    "field_id string, name string, lat double, lon double, crop_type string, region string, "
    "area_ha double, soil_type string"
)
PREDICTION_LOG = struct(
    "ts timestamp, field_id string, predicted_yield_kg_per_ha double, lower_bound double, "
    "upper_bound double, model_version string"
)
RUN_METRICS = struct("run_id string, metric string, value double, ts timestamp")

# --- fixed values: model features, in model order ---------------------------------
TARGET = "yield_kg_per_ha"
KEY_COLS = ["yield_kg_per_ha", "week_start", "field_id"]
FEATURE_COLS = [
    "lat",
    "lon",
    "area_ha",
    "crop_type_encoded",
    "soil_type_encoded",
    "region_encoded",
    "temperature_2m_mean",
    "precipitation_sum",
    "shortwave_radiation_sum",
    "et0_fao_evapotranspiration",
    "soil_moisture",
    "ndvi",
    "week_of_year",
    "year",
]

# --- fixed values: live weather names ---------------------------------------------
LIVE_FEATURES = {
    "precipitation_sum": "rainfall_today_mm",
    "shortwave_radiation_sum": "solar_radiation_today",
    "temperature_2m_max": "t2m_max_today",
    "temperature_2m_min": "t2m_min_today",
    "relative_humidity_2m_max": "rh2m_today",
    "windspeed_10m_max": "windspeed_today",
    "et0_fao_evapotranspiration": "et0_today",
}
# live feature -> column of the daily climate table that serves as its reference
DRIFT_REFERENCE = {
    "rainfall_today_mm": "PRECTOTCORR",
    "t2m_max_today": "T2M_MAX",
    "t2m_min_today": "T2M_MIN",
    "et0_today": "EVPTRNS",
    "solar_radiation_today": "ALLSKY_SFC_SW_DWN",
}
MONITORED_FEATURES = [
    "rainfall_today_mm",
    "t2m_max_today",
    "t2m_min_today",
    "et0_today",
    "solar_radiation_today",
    "gdd_accumulation",
    "ndvi_latest",
]
# live feature -> model feature: one mapping for fitting and for scoring
LIVE_TO_MODEL = {
    "t2m_max_today": "temperature_2m_mean",
    "rainfall_today_mm": "precipitation_sum",
    "solar_radiation_today": "shortwave_radiation_sum",
    "et0_today": "et0_fao_evapotranspiration",
}

# --- fixed values: monthly climate defaults ---------------------------------------
MONTHLY_DEFAULT_COLS = [
    "rainfall_today_mm",
    "solar_radiation_today",
    "t2m_max_today",
    "t2m_min_today",
    "rh2m_today",
    "windspeed_today",
    "et0_today",
]
MONTHLY_DEFAULTS = [
    (1, 3.8, 2.5, 7.0, 2.0, 82.0, 22.0, 0.6),
    (2, 2.9, 4.5, 7.5, 2.0, 79.0, 21.0, 0.9),
    (3, 2.8, 8.0, 10.0, 3.5, 75.0, 20.0, 1.6),
    (4, 2.2, 12.0, 13.0, 5.0, 71.0, 18.0, 2.5),
    (5, 2.5, 15.0, 16.0, 7.5, 70.0, 17.0, 3.4),
    (6, 2.4, 18.0, 19.0, 10.0, 68.0, 16.0, 4.1),
    (7, 2.7, 17.5, 21.0, 12.0, 70.0, 15.0, 4.0),
    (8, 3.0, 15.5, 21.0, 12.0, 72.0, 15.0, 3.5),
    (9, 3.2, 11.0, 18.0, 10.0, 75.0, 16.0, 2.5),
    (10, 3.8, 7.0, 14.0, 7.0, 79.0, 18.0, 1.4),
    (11, 3.9, 3.5, 10.0, 4.0, 82.0, 20.0, 0.8),
    (12, 4.0, 2.0, 7.5, 2.5, 84.0, 22.0, 0.5),
]

# --- fixed values: crops ----------------------------------------------------------
BASE_YIELD = {
    "winter_wheat": 8000,
    "oilseed_rape": 3500,
    "sugar_beet": 60000,
    "winter_barley": 6500,
}
CROP_CODES = {"Wheat": 0, "W-Barley": 2, "S-Barley": 3, "OSR": 4, "Beans": 5}
DEFAULT_CROP_CODE = 3

# --- fixed values: climate variable file prefix -> feature ------------------------
CLIMATE_VARIABLES = {
    "tas": "temperature_2m_mean",
    "precip": "precipitation_sum",
    "rsds": "shortwave_radiation_sum",
    "pet": "et0_fao_evapotranspiration",
    "sfcWind": "wind_speed",
    "huss": "specific_humidity",
}
