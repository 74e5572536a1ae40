"""Column functions and document flattening over the given tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks.tables import EVENTS, daily_climate, DAILY, day_sql, load, rounded, shown, ts_sql
from fieldlens.functions.scalars import (
    align_features,
    clip,
    drop_unlabelled,
    encode_map,
    encode_sorted,
    event_time,
    feature_cols,
    fill_constants,
    flag_to_int,
    from_tenths,
    grid_to_latlon,
    iso_week_monday,
    null_sentinel,
    numbers_or_zero,
    to_number,
    tonnes_to_kg,
    week_start,
)
from fieldlens.plans.scoring import model_inputs
from fieldlens.schemas import CROP_CODES, FEATURE_COLS
from fieldlens.sources.documents import (
    flatten_forecast,
    flatten_forecast_days,
    flatten_power,
    flatten_station,
)


def q_event_time(spark, sf):
    events = load(spark, sf, "events")
    at = event_time(F.unix_millis("ts"))
    return shown(
        events.select("event_id", F.unix_micros(at).alias("micros"), week_start(at).alias("week"))
    )


TIME_SQL = f"""SELECT event_id, epoch_us(ts) // 1000 * 1000 AS micros,
  {ts_sql("date_trunc('week', ts)")} AS week FROM events"""


def q_iso_week(spark, sf):
    """ISO weeks built from every order's year and a number that often names no week."""
    orders = load(spark, sf, "orders")
    week = F.col("o_orderkey") % 56
    return shown(
        orders.select("o_orderkey", iso_week_monday(F.year("o_orderdate"), week).alias("monday"))
    )


ISO_SQL = f"""WITH o AS (SELECT o_orderkey, o_orderkey % 56 AS w,
    date_trunc('week', make_date(year(o_orderdate), 1, 4)) + to_days(CAST((o_orderkey % 56 - 1) * 7
      AS INTEGER)) AS d FROM orders)
SELECT o_orderkey, CASE WHEN w >= 1 AND weekofyear(d) = w THEN {ts_sql('d')} END AS monday FROM o"""


def q_clean_numbers(spark, sf):
    """Sentinels, text that is no number, limits, flags, units, constant fills."""
    events = load(spark, sf, "events")
    text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.get_json_object("props", "$.k")
    )
    rows = events.select(
        "event_id",
        text.alias("k_text"),
        F.when(F.col("event_type") == "view", F.lit(-999.0)).otherwise(F.col("value")).alias("v"),
        (F.col("event_type") == "purchase").alias("flag"),
        F.when(F.col("event_type") != "signup", F.col("value")).alias("rain"),
    )
    rows = null_sentinel(rows, ["v"]).withColumn("k_number", to_number("k_text"))
    rows = numbers_or_zero(rows, ["k_text"]).withColumns(
        {
            "limited": clip("v", 5, 60),
            "flag": flag_to_int("flag"),
            "tenth": from_tenths("v"),
            "kilos": tonnes_to_kg("k_number"),
        }
    )
    return shown(fill_constants(rows, {"rain": 0.0}))


CLEAN_SQL = f"""WITH {EVENTS}, r AS (SELECT event_id,
    CASE WHEN event_type <> 'error' THEN k END AS k,
    CASE WHEN event_type <> 'view' THEN value END AS v,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS flag,
    CASE WHEN event_type <> 'signup' THEN value ELSE 0 END AS rain FROM ev)
SELECT event_id, coalesce(k, 0) AS k_text, round(v, 6) AS v, flag, round(rain, 6) AS rain,
  k AS k_number, CASE WHEN v IS NOT NULL THEN least(greatest(v, 5), 60) END AS limited,
  round(v / 10, 6) AS tenth, k * 1000 AS kilos FROM r"""


def q_encode(spark, sf):
    part = load(spark, sf, "part")
    crops = {"SMALL": "Wheat", "LARGE": "OSR", "MEDIUM": "Beans"}
    crop = F.coalesce(
        *[F.when(F.col("p_type") == t, F.lit(c)) for t, c in crops.items()], F.col("p_type")
    )
    coded = encode_sorted(part.withColumn("crop", crop), "p_brand", "brand_code")
    return coded.select(
        "p_partkey",
        encode_map("crop", CROP_CODES, 3).alias("crop_code"),
        encode_map("crop", CROP_CODES, -1).alias("crop_code_strict"),
        "brand_code",
    )


ENCODE_SQL = """WITH c AS (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 4
    WHEN 'MEDIUM' THEN 5 END AS code, dense_rank() OVER (ORDER BY p_brand) - 1 AS b FROM part)
SELECT p_partkey, coalesce(code, 3) AS crop_code, coalesce(code, -1) AS crop_code_strict,
  CAST(b AS INTEGER) AS brand_code FROM c"""


def q_grid_latlon(spark, sf):
    lat, lon = grid_to_latlon(F.col("c_acctbal") * 40 + 400000, F.col("c_custkey") * 7 + 90000)
    return load(spark, sf, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"))


GRID_SQL = """WITH g AS (SELECT c_custkey, c_acctbal * 40 AS e,
    52.5 + (c_custkey * 7 - 10000) / 111320 / 1000 AS lat FROM customer)
SELECT c_custkey, round(lat, 5) AS lat,
  round(-1.5 + e / (111320 * cos(radians(lat))) / 1000, 5) AS lon FROM g"""


def q_align_features(spark, sf):
    """Model columns from parts: some numeric, one textual, the rest absent."""
    part = load(spark, sf, "part").select(
        F.col("p_partkey").alias("field_id"),
        F.col("p_retailprice").alias("area_ha"),
        F.col("p_name").alias("region_encoded"),
        F.when(F.col("p_size") > 25, F.col("p_size")).alias("ndvi"),
        F.col("p_size").cast("string").alias("lat"),
    )
    return shown(align_features(part, keep=["field_id"]))


ALIGN_SQL = f"""SELECT p_partkey AS field_id, CAST(p_size AS DOUBLE) AS lat,
  CAST(p_retailprice AS DOUBLE) AS area_ha,
  CAST(CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS DOUBLE) AS ndvi,
  {', '.join(f'0::DOUBLE AS {c}' for c in FEATURE_COLS if c not in ('lat', 'area_ha', 'ndvi'))}
FROM part"""


def q_model_inputs(spark, sf):
    """Live names and labels brought to model names; rows without a target left out."""
    lines = load(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("t2m_max_today"),
        F.col("l_tax").alias("rainfall_today_mm"),
        F.col("l_returnflag").alias("crop_type"),
        F.col("l_linestatus").alias("soil_type"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("forecast_date"),
        F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("yield_kg_per_ha"),
    )
    codes = {"crop_type": {"A": 1, "R": 2}, "soil_type": {"F": 5}}
    rows = drop_unlabelled(model_inputs(lines, codes))
    kept = [c for c in feature_cols(rows) if not c.startswith("l_")]
    return shown(rows.select("l_orderkey", "l_linenumber", *kept))


INPUTS_SQL = f"""SELECT l_orderkey, l_linenumber, l_quantity AS t2m_max_today,
  l_tax AS rainfall_today_mm, l_returnflag AS crop_type, l_linestatus AS soil_type,
  {day_sql('l_shipdate')} AS forecast_date, l_quantity AS temperature_2m_mean,
  l_tax AS precipitation_sum,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS crop_type_encoded,
  CASE l_linestatus WHEN 'F' THEN 5 ELSE 0 END AS soil_type_encoded,
  CAST(weekofyear(l_shipdate) AS INTEGER) AS week_of_year, CAST(year(l_shipdate) AS INTEGER) AS year
FROM lineitem WHERE l_returnflag <> 'N'"""


# --- documents -------------------------------------------------------------------------


def q_power_daily(spark, sf):
    """Daily rows packed into one document per field, then flattened again."""
    daily = daily_climate(spark, sf)
    names = ["PRECTOTCORR", "T2M_MAX", "RH2M"]
    day = F.date_format("date", "yyyyMMdd")

    def series(name):
        cell = F.struct(day, F.coalesce(F.col(name), F.lit(-999.0)))
        return F.map_from_entries(F.collect_list(cell))

    doc = F.struct(F.struct(F.struct(*[series(n).alias(n) for n in names]).alias("parameter")).alias("properties"))
    docs = daily.groupBy("field_id").agg(F.to_json(doc["properties"]).alias("inner")).select(
        "field_id", F.concat(F.lit('{"properties":'), "inner", F.lit("}")).alias("value")
    )
    return shown(flatten_power(docs, parameters=names))


POWER_SQL = f"""WITH {DAILY} SELECT field_id, {ts_sql('date')} AS date,
  {rounded('PRECTOTCORR', 'T2M_MAX', 'RH2M')} FROM daily"""


def forecast_docs(spark, sf):
    """A document per (user, day) whose arrays are that day's events in order."""
    k = F.get_json_object("props", "$.k").cast("double")
    rows = load(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", "value", k.alias("k")))).alias("e")
    )
    daily = F.struct(
        F.transform("e", lambda x, i: F.date_add(F.col("day"), i).cast("string")).alias("time"),
        F.transform("e", lambda x: x["value"]).alias("precipitation_sum"),
        F.transform("e", lambda x: x["k"]).alias("temperature_2m_max"),
    )
    return rows.select(
        F.concat_ws("/", "user_id", "day").alias("field_id"),
        F.to_json(F.struct(daily.alias("daily"))).alias("value"),
    )


def q_forecast_today(spark, sf):
    rows = flatten_forecast(forecast_docs(spark, sf), date(2024, 1, 31))
    return shown(
        rows.select("field_id", "rainfall_today_mm", "t2m_max_today", "et0_today", "forecast_date")
    )


FORECAST_SQL = f"""WITH {EVENTS}
SELECT user_id || '/' || {day_sql('ts')} AS field_id,
  arg_min(value, event_id) AS rainfall_today_mm, arg_min(k, event_id) AS t2m_max_today,
  CAST(NULL AS DOUBLE) AS et0_today, '2024-01-31' AS forecast_date FROM ev
GROUP BY user_id, {day_sql('ts')}"""


def q_forecast_days(spark, sf):
    rows = flatten_forecast_days(forecast_docs(spark, sf))
    return shown(rows.select("field_id", "day_offset", "date", "rainfall_today_mm", "t2m_max_today"))


DAYS_SQL = f"""WITH {EVENTS}, r AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (
    PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) - 1 AS i FROM ev)
SELECT user_id || '/' || {day_sql('day')} AS field_id, CAST(i AS INTEGER) AS day_offset,
  strftime(day + CAST(i AS INTEGER), '%Y-%m-%d') AS date, value AS rainfall_today_mm,
  k AS t2m_max_today FROM r"""


def q_station_rows(spark, sf):
    """A document per order whose readings are its lines; the last of a type counts."""
    kind = (
        F.when(F.col("l_returnflag") == "A", "TMAX")
        .when(F.col("l_returnflag") == "N", "TMIN")
        .otherwise("PRCP")
    )
    place = F.concat_ws("-", F.format_string("%02d", "l_linenumber"),
                        F.format_string("%012d", "l_partkey"), F.format_string("%012d", "l_suppkey"))
    docs = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("station_id")).agg(
        F.array_sort(
            F.collect_list(F.struct(place.alias("o"), kind.alias("datatype"), F.col("l_quantity").alias("value")))
        ).alias("results"),
        F.max("l_shipdate").alias("at"),
    ).select(
        "station_id",
        F.to_json(F.struct("results")).alias("value"),
    )
    stations = load(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("station_id"),
        F.concat(F.lit("F"), "o_custkey").alias("field_id"),
    )
    at = F.timestamp_millis(F.lit(1700000000000))
    return shown(flatten_station(docs, stations, at).drop("humidity"))


STATION_SQL = """WITH l AS (SELECT *, (l_linenumber, l_partkey, l_suppkey) AS o FROM lineitem),
  r AS (SELECT l_orderkey AS station_id, arg_max(l_quantity, o) FILTER (l_returnflag = 'A') AS hi,
    arg_max(l_quantity, o) FILTER (l_returnflag = 'N') AS lo,
    arg_max(l_quantity, o) FILTER (l_returnflag = 'R') AS rain FROM l GROUP BY l_orderkey)
SELECT station_id, CASE WHEN o_orderstatus <> 'P' THEN 'F' || o_custkey ELSE 'unknown' END AS field_id,
  1700000000000 AS timestamp, round(coalesce(hi, lo) / 10, 6) AS temperature,
  round(coalesce(rain, 0) / 10, 6) AS precipitation, CAST(NULL AS DOUBLE) AS wind_speed,
  'noaa_ghcn' AS source FROM r LEFT JOIN orders ON o_orderkey = station_id"""

QUERIES = {
    "event_time": (q_event_time, TIME_SQL),
    "iso_week": (q_iso_week, ISO_SQL),
    "clean_numbers": (q_clean_numbers, CLEAN_SQL),
    "encode": (q_encode, ENCODE_SQL),
    "grid_latlon": (q_grid_latlon, GRID_SQL),
    "align_features": (q_align_features, ALIGN_SQL),
    "model_inputs": (q_model_inputs, INPUTS_SQL),
    "power_daily": (q_power_daily, POWER_SQL),
    "forecast_today": (q_forecast_today, FORECAST_SQL),
    "forecast_days": (q_forecast_days, DAYS_SQL),
    "station_rows": (q_station_rows, STATION_SQL),
}
