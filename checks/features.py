"""Weekly features, season tables, assembly and lookups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from checks.tables import (
    DAILY,
    EVENTS,
    READINGS,
    SCENES,
    WEATHER,
    daily_climate,
    load,
    readings,
    rounded,
    scenes,
    shown,
    ts_sql,
    weather,
    with_nan,
)
from fieldlens.functions.agronomy import expected_yield, scene_ndvi, scene_ndvi_tiles, soil_proxies
from fieldlens.operators.asof import (
    FeatureView,
    live_features,
    materialize,
    merge_snapshot,
    monthly_defaults,
    online_latest,
    pit_join,
)
from fieldlens.operators.assemble import (
    assemble_weekly,
    build_training_rows,
    climate_season,
    enrich,
    first_by_key,
    sar_features,
    union_all,
    union_relaxed,
    unknown_fields,
)
from fieldlens.operators.geo import latest_scene
from fieldlens.operators.weekly import (
    climate_weekly,
    fill_ndvi,
    latest_per_week,
    soil_weekly,
    weather_weekly,
)

SOIL_AGGS = """avg({t}) AS soil_temp_mean, min({t}) AS soil_temp_min, max({t}) AS soil_temp_max,
    stddev_samp({t}) AS soil_temp_std, avg(moisture) AS moisture_mean,
    min(moisture) AS moisture_min, max(moisture) AS moisture_max,
    stddev_samp(moisture) AS moisture_std, avg(ph) AS ph_mean, avg(nitrogen) AS nitrogen_mean,
    avg(phosphorus) AS phosphorus_mean, avg(potassium) AS potassium_mean"""
SOIL_COLS = [
    "soil_temp_mean", "soil_temp_min", "soil_temp_max", "soil_temp_std", "moisture_mean",
    "moisture_min", "moisture_max", "moisture_std", "ph_mean", "nitrogen_mean", "phosphorus_mean",
    "potassium_mean",
]
WEATHER_AGGS = """avg(temperature) AS air_temp_mean, sum(coalesce(precipitation, 0)) AS precip_total,
    avg(humidity) AS humidity_mean, avg(wind_speed) AS wind_speed_mean"""
WEATHER_COLS = ["air_temp_mean", "precip_total", "humidity_mean", "wind_speed_mean"]
WEEK = f"{ts_sql('week_start')} AS week_start"


def q_soil_weekly(spark, sf):
    return shown(soil_weekly(readings(spark, sf)))


def soil_sql(t="temperature"):
    return f"""WITH {READINGS}, w AS (
  SELECT field_id, week_start, {SOIL_AGGS.format(t=t)} FROM readings GROUP BY ALL)
SELECT field_id, {WEEK}, {rounded(*SOIL_COLS)} FROM w"""


def q_soil_weekly_masked(spark, sf):
    return shown(soil_weekly(readings(spark, sf), mask_faults=True))


MASKED = "CASE WHEN fault_mode NOT IN ('DROPOUT', 'BURST') THEN temperature END"


def q_weather_weekly(spark, sf):
    return shown(weather_weekly(weather(spark, sf)))


WEATHER_SQL = f"""WITH {WEATHER}, w AS (
  SELECT field_id, week_start, {WEATHER_AGGS} FROM weather GROUP BY ALL)
SELECT field_id, {WEEK}, {rounded(*WEATHER_COLS)} FROM w"""

SEGMENT_YIELD = {"BUILDING": 8000, "MACHINERY": 3500, "FURNITURE": 60000, "HOUSEHOLD": 6500}


def fields_of(spark, sf):
    """Customers as the field dimension."""
    return load(spark, sf, "customer").select(
        F.concat(F.lit("F"), "c_custkey").alias("field_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("crop_type"),
        F.col("c_acctbal").alias("area_ha"),
        "c_nationkey",
    )


FIELDS = """fields AS (
  SELECT 'F' || c_custkey AS field_id, c_name AS name, c_mktsegment AS crop_type,
    c_acctbal AS area_ha, c_nationkey FROM customer)"""


def q_climate_weekly_proxies(spark, sf):
    weekly = enrich(climate_weekly(with_nan(daily_climate(spark, sf))), fields_of(spark, sf))
    rows = expected_yield(soil_proxies(weekly), SEGMENT_YIELD)
    return shown(rows.drop("name", "area_ha", "c_nationkey"))


def clip_sql(x, lo, hi):
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, {lo}), {hi}) END"


CLIMATE_SQL = f"""WITH {DAILY}, {FIELDS}, w AS (
  SELECT field_id, date_trunc('week', date) AS week_start, avg(T2M_MAX) AS air_temp_mean,
    stddev_samp(T2M_MAX) AS air_temp_std, coalesce(sum(PRECTOTCORR), 0) AS precip_total,
    avg(RH2M) AS humidity_mean, avg(WS2M) AS wind_speed_mean
  FROM daily GROUP BY ALL), j AS (
  SELECT w.*, crop_type, CASE crop_type WHEN 'BUILDING' THEN 8000.0 WHEN 'MACHINERY' THEN 3500.0
    WHEN 'FURNITURE' THEN 60000.0 WHEN 'HOUSEHOLD' THEN 6500.0 END AS base
  FROM w JOIN fields USING (field_id)), e AS (
  SELECT *, {clip_sql('air_temp_mean - 10', -5, 15)} * (base * 0.005) AS warmth,
    {clip_sql('precip_total - 15', -10, 20)} * (base * 0.002) AS rain,
    {clip_sql('precip_total / 7', 0, 100)} AS moisture FROM j)
SELECT field_id, {WEEK}, {rounded('air_temp_mean', 'air_temp_std', 'precip_total', 'humidity_mean',
  'wind_speed_mean', 'air_temp_mean * 0.85 AS soil_temp_mean',
  'coalesce(air_temp_std, 0) * 0.85 AS soil_temp_std', 'moisture AS moisture_mean',
  'moisture * 0.1 AS moisture_std',
  clip_sql('base + warmth + rain', 'base * 0.4', 'base * 1.6') + ' AS expected_yield_kg_per_ha')},
  crop_type, 6.5::DOUBLE AS ph_mean, 180.0::DOUBLE AS nitrogen_mean,
  30.0::DOUBLE AS phosphorus_mean, 200.0::DOUBLE AS potassium_mean, 0.6::DOUBLE AS latest_ndvi,
  40.0::DOUBLE AS cloud_cover_pct, 0 AS ndvi_interpolated,
  1 AS ndvi_proxied FROM e"""


# --- wide tables ----------------------------------------------------------------------


def wide_orders(spark, sf, value):
    """Orders as a wide table: one row per (customer, priority), one column per month."""
    orders = load(spark, sf, "orders").withColumn("m", F.month("o_orderdate"))
    months = list(range(1, 13))
    wide = orders.groupBy(
        F.col("o_custkey").alias("grid_ID"), F.col("o_orderpriority").alias("row_tag")
    ).pivot("m", months).agg(value)
    names = {str(m): f"X2000.{m:02d}.15" for m in months}
    return wide.withColumnsRenamed(names)


def q_season_wide_mean(spark, sf):
    price = wide_orders(spark, sf, F.avg(F.col("o_totalprice") / F.pi()))
    count = wide_orders(spark, sf, F.count("o_orderkey").cast("double"))
    return shown(
        climate_season(
            {"temperature_2m_mean": price.drop("row_tag"), "precipitation_sum": count.drop("row_tag")}
        )
    )


SEASON_SQL = f"""WITH c AS (
  SELECT o_custkey AS grid_ID, o_orderpriority AS tag, month(o_orderdate) AS m,
    avg(o_totalprice / pi()) AS price, CAST(count(o_orderkey) AS DOUBLE) AS n FROM orders GROUP BY ALL),
  r AS (SELECT grid_ID, tag, avg(price) FILTER (m BETWEEN 4 AND 9) AS price,
    avg(n) FILTER (m BETWEEN 4 AND 9) AS n FROM c GROUP BY ALL)
SELECT grid_ID, {rounded('avg(price) AS temperature_2m_mean', 'avg(n) AS precipitation_sum')}
FROM r GROUP BY grid_ID"""


def q_sar_features(spark, sf):
    orders = load(spark, sf, "orders").withColumn("m", F.month("o_orderdate"))
    months = list(range(1, 13))
    wide = orders.groupBy(F.col("o_custkey").alias("ID")).pivot("m", months).agg(
        F.avg(F.col("o_totalprice") / F.pi()).alias("a"), F.max("o_totalprice").alias("b")
    )
    names = {f"{m}_a": f"X2000.{m:02d}" for m in months} | {
        f"{m}_b": f"X2000.{m:02d}.1" for m in months
    }
    return shown(sar_features(wide.withColumnsRenamed(names), 2000))


SAR_SQL = f"""WITH c AS (
  SELECT o_custkey AS ID, month(o_orderdate) AS m, avg(o_totalprice / pi()) AS a, max(o_totalprice) AS b
  FROM orders GROUP BY ALL)
SELECT ID, {rounded('avg(a) AS sar_ratio_mean', 'max(a) - min(a) AS sar_ratio_range',
  'avg(b) AS sar_ratio2_mean', 'max(b) - min(b) AS sar_ratio2_range')},
  count(a) AS sar_ratio_count, count(b) AS sar_ratio2_count FROM c GROUP BY ID"""


def q_first_attr_by_key(spark, sf):
    part = load(spark, sf, "part").withColumn("p_type", F.nullif("p_type", F.lit("ECONOMY")))
    return first_by_key(part, "p_brand", ["p_type", "p_size", "p_name"], "p_partkey")


FIRST_SQL = """SELECT p_brand,
  arg_min(p_type, p_partkey) FILTER (p_type <> 'ECONOMY') AS p_type,
  arg_min(p_size, p_partkey) AS p_size, arg_min(p_name, p_partkey) AS p_name
FROM part GROUP BY p_brand"""


def q_lookup_defaults(spark, sf):
    customer = load(spark, sf, "customer")
    supplier = load(spark, sf, "supplier")
    nation = load(spark, sf, "nation")
    yields = customer.select(
        F.col("c_custkey").alias("ID"),
        F.col("c_nationkey").alias("grid_ID"),
        F.col("c_mktsegment").alias("Crop"),
        (F.col("c_acctbal") * 10 + 400000).alias("east"),
        (F.col("c_nationkey") * 1000 + 100000).alias("north"),
        (F.col("c_acctbal") / 1000).alias("Yield"),
    )
    soil = nation.filter("n_regionkey <> 4").select(
        F.col("n_nationkey").alias("grid_ID"),
        F.col("n_regionkey").cast("string").alias("text"),
        F.when(F.col("n_regionkey") != 3, F.col("n_nationkey") / 100).alias("awc"),
    )
    rich = F.col("s_acctbal") > 5000
    climate = (
        supplier.groupBy(F.col("s_nationkey").alias("grid_ID"))
        .agg(
            F.avg("s_acctbal").alias("temperature_2m_mean"),
            F.avg(F.when(rich, F.col("s_acctbal"))).alias("precipitation_sum"),
            F.max("s_acctbal").alias("shortwave_radiation_sum"),
            F.min("s_acctbal").alias("et0_fao_evapotranspiration"),
        )
        .filter("temperature_2m_mean > 4000")
    )
    sar = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("ID")).agg(
        F.avg(F.col("o_totalprice") / F.pi()).alias("sar_ratio_mean")
    )
    codes = {"BUILDING": 0, "MACHINERY": 2, "HOUSEHOLD": 4}
    # every id stands twice on either side: rows stay as many as there are yields
    yields = yields.unionByName(yields)
    sar = sar.unionByName(sar.withColumn("sar_ratio_mean", F.col("sar_ratio_mean") + 1))
    return shown(build_training_rows(yields, sar, climate, soil, 2015, codes))


LOOKUP_SQL = f"""WITH soil AS (
  SELECT n_nationkey AS g, n_regionkey AS text,
    CASE WHEN n_regionkey <> 3 THEN n_nationkey / 100 END AS awc FROM nation WHERE n_regionkey <> 4),
  climate AS (SELECT s_nationkey AS g, avg(s_acctbal) AS t,
    avg(s_acctbal) FILTER (s_acctbal > 5000) AS p, max(s_acctbal) AS r, min(s_acctbal) AS e
    FROM supplier GROUP BY ALL HAVING avg(s_acctbal) > 4000),
  sar AS (SELECT o_custkey AS id, avg(o_totalprice / pi()) AS s FROM orders GROUP BY ALL),
  b AS (SELECT *, 52.5 + (c_nationkey * 1000) / 111320 / 1000 AS lat0
    FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer))
SELECT round(lat0, 5) AS lat,
  round(-1.5 + (c_acctbal * 10) / (111320 * cos(radians(lat0))) / 1000, 5) AS lon,
  50.0::DOUBLE AS area_ha,
  CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 4
    ELSE 3 END AS crop_type_encoded,
  coalesce(CAST(text AS INTEGER), 0) AS soil_type_encoded, 0 AS region_encoded,
  round(CASE WHEN climate.g IS NULL THEN 15.0 ELSE t END, 6) AS temperature_2m_mean,
  round(CASE WHEN climate.g IS NULL THEN 2.0 ELSE p END, 6) AS precipitation_sum,
  round(CASE WHEN climate.g IS NULL THEN 15.0 ELSE r END, 6) AS shortwave_radiation_sum,
  round(CASE WHEN climate.g IS NULL THEN 3.0 ELSE e END, 6) AS et0_fao_evapotranspiration,
  round(coalesce(awc, 0.35), 6) AS soil_moisture, round(coalesce(s / 1000, 0.5), 6) AS ndvi,
  26 AS week_of_year, 2015 AS year, round(c_acctbal / 1000 * 1000, 6) AS yield_kg_per_ha,
  CAST(c_custkey AS VARCHAR) AS field_id, '2015-06-22 00:00:00' AS week_start
FROM b LEFT JOIN soil ON soil.g = c_nationkey LEFT JOIN climate ON climate.g = c_nationkey
  LEFT JOIN sar ON sar.id = c_custkey"""


# --- vegetation ------------------------------------------------------------------------


def q_latest_per_week(spark, sf):
    return shown(latest_per_week(scenes(spark, sf)).drop("event_time"))


LATEST_SQL = f"""WITH {SCENES}
SELECT field_id, scene_id, timestamp, {rounded('ndvi', 'cloud_cover_pct')}, ndvi_interpolated,
  ndvi_proxied, {WEEK} FROM latest"""


def q_ndvi_gap_fill(spark, sf):
    return shown(fill_ndvi(latest_per_week(scenes(spark, sf))))


def q_ndvi_gap_fill_known(spark, sf):
    return shown(fill_ndvi(latest_per_week(scenes(spark, sf)), ignore_nulls=True))


def gap_sql(previous):
    return f"""WITH {SCENES}, f AS (SELECT *, {previous} AS prev FROM latest)
SELECT field_id, {WEEK}, {rounded('coalesce(ndvi, prev) AS latest_ndvi', 'cloud_cover_pct')},
  CASE WHEN ndvi IS NULL THEN TRUE ELSE ndvi_interpolated END AS ndvi_interpolated,
  coalesce(ndvi_proxied, FALSE) AS ndvi_proxied FROM f"""


LAG = "lag(ndvi) OVER (PARTITION BY field_id ORDER BY week_start)"
KNOWN = """last_value(ndvi IGNORE NULLS) OVER (PARTITION BY field_id ORDER BY week_start
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def pixels(spark, sf):
    return load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("scene_id"),
        "l_orderkey",
        (F.col("l_tax") * 100).alias("red"),
        (F.col("l_discount") * 100).alias("nir"),
    )


def q_scene_index(spark, sf):
    return scene_ndvi(pixels(spark, sf))


def q_scene_index_tiles(spark, sf):
    tiles = pixels(spark, sf).groupBy("scene_id", "l_orderkey").agg(
        F.collect_list(F.struct("red", "nir")).alias("px")
    )
    return scene_ndvi_tiles(
        tiles.select("scene_id", F.col("px.red").alias("red"), F.col("px.nir").alias("nir"))
    )


SCENE_SQL = """SELECT l_suppkey AS scene_id, round(avg((l_discount * 100 - l_tax * 100) /
  nullif(l_discount * 100 + l_tax * 100, 0)), 4) AS ndvi FROM lineitem GROUP BY l_suppkey"""


# --- assembly --------------------------------------------------------------------------


def labels_of(spark, sf):
    """Mean sign-up value per (field, week) as the label."""
    signups = load(spark, sf, "events").filter("event_type = 'signup'")
    return signups.groupBy(
        F.concat(F.lit("F"), "user_id").alias("field_id"),
        F.date_trunc("week", "ts").alias("week_start"),
    ).agg(F.avg("value").alias("yield_kg_per_ha"))


def event_weather(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    return load(spark, sf, "events").filter("event_type in ('purchase', 'view')").select(
        F.concat(F.lit("F"), "user_id").alias("field_id"),
        F.unix_millis("ts").alias("timestamp"),
        F.col("value").alias("temperature"),
        F.when(F.col("event_type") == "purchase", k).alias("precipitation"),
        k.alias("humidity"),
        (k / 4).alias("wind_speed"),
    )


def q_assemble_weekly(spark, sf):
    weekly = assemble_weekly(
        soil_weekly(readings(spark, sf)),
        weather_weekly(event_weather(spark, sf)),
        fill_ndvi(latest_per_week(scenes(spark, sf))),
        labels_of(spark, sf),
    )
    return shown(enrich(weekly, fields_of(spark, sf)).drop("c_nationkey"))


ASSEMBLE_SQL = f"""WITH {READINGS}, {SCENES.split('), ', 1)[1]}, {FIELDS}, soil AS (
  SELECT field_id, week_start, {SOIL_AGGS.format(t='temperature')} FROM readings GROUP BY ALL),
  ew AS (SELECT 'F' || user_id AS field_id, date_trunc('week', ts) AS week_start,
    value AS temperature, CASE WHEN event_type = 'purchase' THEN k END AS precipitation,
    k AS humidity, k / 4 AS wind_speed FROM ev WHERE event_type IN ('purchase', 'view')),
  weather AS (SELECT field_id, week_start, {WEATHER_AGGS} FROM ew GROUP BY ALL),
  veg AS (SELECT field_id, week_start, coalesce(ndvi, {LAG}) AS latest_ndvi, cloud_cover_pct,
    CASE WHEN ndvi IS NULL THEN TRUE ELSE ndvi_interpolated END AS ndvi_interpolated,
    coalesce(ndvi_proxied, FALSE) AS ndvi_proxied FROM latest),
  labels AS (SELECT 'F' || user_id AS field_id, date_trunc('week', ts) AS week_start,
    avg(value) AS yield_kg_per_ha FROM ev WHERE event_type = 'signup' GROUP BY ALL)
SELECT field_id, {WEEK}, {rounded(*SOIL_COLS, *WEATHER_COLS, 'latest_ndvi', 'cloud_cover_pct',
  'yield_kg_per_ha', 'area_ha')}, ndvi_interpolated, ndvi_proxied, name, crop_type
FROM soil LEFT JOIN weather USING (field_id, week_start) LEFT JOIN veg USING (field_id, week_start)
  LEFT JOIN labels USING (field_id, week_start) JOIN fields USING (field_id)"""


def q_unknown_fields(spark, sf):
    known = load(spark, sf, "supplier").select(
        F.concat(F.lit("F"), "s_suppkey").alias("field_id")
    )
    lost = unknown_fields(readings(spark, sf), known)
    return lost.groupBy("field_id").agg(F.count(F.lit(1)).alias("n"))


UNKNOWN_SQL = f"""WITH {READINGS} SELECT field_id, count(*) AS n FROM readings
WHERE field_id NOT IN (SELECT 'F' || s_suppkey FROM supplier) GROUP BY field_id"""


def q_union_parts(spark, sf):
    """Per-type frames put together again, one of them with a column of its own."""
    events = load(spark, sf, "events")
    kinds = ["click", "view", "purchase", "error"]
    same = union_all(
        [events.filter(F.col("event_type") == t).select("user_id", "value") for t in kinds]
    )
    signups = events.filter("event_type = 'signup'").select("user_id", F.col("value").alias("fee"))
    both = union_relaxed(same, signups)
    return shown(
        both.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.sum("fee").alias("fee")
        )
    )


UNION_SQL = f"""SELECT user_id, count(*) AS n, {rounded(
  "sum(value) FILTER (event_type <> 'signup') AS value",
  "sum(value) FILTER (event_type = 'signup') AS fee")} FROM events GROUP BY user_id"""


# --- as-of -----------------------------------------------------------------------------


def q_pit_join_ttl(spark, sf):
    entities = load(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("F"), "o_custkey").alias("field_id"),
        F.col("o_orderdate").alias("event_timestamp"),
    )
    lines = load(spark, sf, "lineitem")
    daily = lines.groupBy(
        F.concat(F.lit("F"), "l_suppkey").alias("field_id"), F.col("l_shipdate").alias("day")
    ).agg(F.max("l_quantity").alias("peak"))
    views = [
        FeatureView(
            "weather", weather_weekly(weather(spark, sf)), ["air_temp_mean", "precip_total"]
        ),
        FeatureView("peaks", daily, ["peak"], timedelta(days=3), ts="day"),
    ]
    return shown(pit_join(entities, views))


PIT_SQL = f"""WITH {WEATHER}, w AS (
  SELECT field_id, week_start, {WEATHER_AGGS} FROM weather GROUP BY ALL),
  d AS (SELECT 'F' || l_suppkey AS field_id, l_shipdate AS day, max(l_quantity) AS peak
    FROM lineitem GROUP BY ALL),
  e AS (SELECT o_orderkey, 'F' || o_custkey AS field_id, o_orderdate AS t FROM orders),
  a AS (SELECT e.*, w.week_start, w.air_temp_mean, w.precip_total FROM e ASOF LEFT JOIN w
    ON e.field_id = w.field_id AND e.t >= w.week_start),
  b AS (SELECT a.*, d.day, d.peak FROM a ASOF LEFT JOIN d
    ON a.field_id = d.field_id AND a.t >= d.day)
SELECT o_orderkey, field_id, {ts_sql('t')} AS event_timestamp,
  round(CASE WHEN week_start >= t - INTERVAL 56 DAY THEN air_temp_mean END, 6) AS air_temp_mean,
  round(CASE WHEN week_start >= t - INTERVAL 56 DAY THEN precip_total END, 6) AS precip_total,
  round(CASE WHEN day >= t - INTERVAL 3 DAY THEN peak END, 6) AS peak FROM b"""



def q_pit_join_dense(spark, sf):
    """A handful of keys with all rows: each event a little later, against the events of its type."""
    events = load(spark, sf, "events")
    values = events.groupBy("event_type", "ts").agg(F.max("value").alias("peak"))
    later = F.col("ts") + F.expr("INTERVAL 90 SECONDS")
    entities = events.select("event_id", "event_type", later.alias("event_timestamp"))
    view = FeatureView("values", values, ["peak"], timedelta(minutes=2), key="event_type", ts="ts")
    return shown(pit_join(entities, [view], key="event_type", bucket=timedelta(hours=6)))


PIT_DENSE_SQL = f"""WITH v AS (SELECT event_type, ts, max(value) AS peak FROM events GROUP BY ALL),
  e AS (SELECT event_id, event_type, ts + INTERVAL 90 SECOND AS t FROM events)
SELECT e.event_id, e.event_type, {ts_sql('e.t')} AS event_timestamp,
  round(CASE WHEN v.ts >= e.t - INTERVAL 2 MINUTE THEN peak END, 6) AS peak
FROM e ASOF LEFT JOIN v ON e.event_type = v.event_type AND e.t >= v.ts"""

AS_OF = datetime(2024, 1, 16, 0, 30)


def q_live_fallback(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    observed = load(spark, sf, "events").select(
        F.concat(F.lit("F"), "user_id").alias("field_id"),
        F.col("ts").alias("fetched_at"),
        F.col("value").alias("rainfall_today_mm"),
        k.alias("t2m_max_today"),
        "event_id",
    )
    found = live_features(
        fields_of(spark, sf).select("field_id", "crop_type"),
        observed,
        monthly_defaults(spark),
        AS_OF,
        ["rainfall_today_mm", "t2m_max_today"],
        tie=["event_id"],
    )
    return shown(found)


LIVE_SQL = f"""WITH {EVENTS}, {FIELDS}, o AS (
  SELECT 'F' || user_id AS field_id, value, k, ts, event_id,
    CASE WHEN ts >= TIMESTAMP '2024-01-15 23:30:00' AND ts >= TIMESTAMP '2024-01-16' THEN 1
      WHEN ts >= TIMESTAMP '2024-01-15 23:30:00' THEN 2
      WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' THEN 3 END AS tier
  FROM ev WHERE ts <= TIMESTAMP '2024-01-16 00:30:00'),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field_id
    ORDER BY tier, ts DESC, event_id DESC) AS rn FROM o WHERE tier IS NOT NULL) WHERE rn = 1)
SELECT field_id, crop_type,
  round(CASE WHEN tier IS NULL THEN 3.8 ELSE value END, 6) AS rainfall_today_mm,
  round(CASE WHEN tier IS NULL THEN 7.0 ELSE k END, 6) AS t2m_max_today,
  '2024-01-16' AS forecast_date,
  CASE tier WHEN 1 THEN 'fresh' WHEN 2 THEN 'cached' WHEN 3 THEN 'yesterday' ELSE 'default' END
    AS tier, coalesce(tier <> 1, TRUE) AS stale_features
FROM fields LEFT JOIN b USING (field_id)"""


def q_online_latest(spark, sf):
    return shown(online_latest(load(spark, sf, "events"), "user_id", "ts", ["event_id"]))


ONLINE_SQL = f"""SELECT event_id, {ts_sql('ts')} AS ts, user_id, event_type,
  round(value, 6) AS value, props FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""

HALF = datetime(2024, 1, 16)


def q_incremental_merge(spark, sf):
    events = load(spark, sf, "events")
    key, tie = ["user_id", "event_type"], ["event_id"]
    before = materialize(events, datetime(2024, 1, 1), HALF, key, "ts", tie)
    after = materialize(events, HALF, datetime(2024, 1, 25), key, "ts", tie)
    return shown(merge_snapshot(before, after, key, "ts", tie))


MERGE_SQL = f"""SELECT event_id, {ts_sql('ts')} AS ts, user_id, event_type,
  round(value, 6) AS value, props FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events
    WHERE ts <= TIMESTAMP '2024-01-25') WHERE rn = 1"""


def q_bbox_scene_latest(spark, sf):
    boxes = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("field_id"),
        (F.col("c_acctbal") / 1000).alias("lon_min"),
        (F.col("c_nationkey") * 0.4).alias("lat_min"),
    ).withColumns({"lon_max": F.col("lon_min") + 0.1, "lat_max": F.col("lat_min") + 0.1})
    catalogue = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("scene_id"),
        F.col("o_orderdate").alias("datetime"),
        (F.col("o_totalprice") / 5000).alias("cloud_cover"),
        F.floor(F.col("o_totalprice") / 50000).cast("double").alias("lon_min"),
        (F.dayofmonth("o_orderdate") * 0.3).alias("lat_min"),
    ).withColumns({"lon_max": F.col("lon_min") + 1.0, "lat_max": F.col("lat_min") + 1.0})
    return shown(latest_scene(boxes, catalogue, datetime(2001, 6, 30), 200))


BBOX_SQL = f"""WITH f AS (SELECT c_custkey AS field_id, c_acctbal / 1000 AS x,
    c_nationkey * CAST(0.4 AS DOUBLE) AS y FROM customer),
  s AS (SELECT o_orderkey AS scene_id, o_orderdate AS datetime, o_totalprice / 5000 AS cloud_cover,
    floor(o_totalprice / 50000) AS x, day(o_orderdate) * CAST(0.3 AS DOUBLE) AS y FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '2001-06-30' - INTERVAL 200 DAY AND TIMESTAMP '2001-06-30'
      AND o_totalprice / 5000 < 80),
  h AS (SELECT field_id, scene_id, datetime, cloud_cover, row_number() OVER (PARTITION BY field_id
    ORDER BY datetime DESC, scene_id DESC) AS rn FROM f JOIN s ON f.x <= s.x + CAST(1.0 AS DOUBLE)
    AND f.x + CAST(0.1 AS DOUBLE) >= s.x AND f.y <= s.y + CAST(1.0 AS DOUBLE)
    AND f.y + CAST(0.1 AS DOUBLE) >= s.y)
SELECT field_id, scene_id, {ts_sql('datetime')} AS datetime, round(cloud_cover, 6) AS cloud_cover
FROM h WHERE rn = 1"""

QUERIES = {
    "soil_weekly": (q_soil_weekly, soil_sql()),
    "soil_weekly_masked": (q_soil_weekly_masked, soil_sql(MASKED)),
    "weather_weekly": (q_weather_weekly, WEATHER_SQL),
    "climate_weekly_proxies": (q_climate_weekly_proxies, CLIMATE_SQL),
    "season_wide_mean": (q_season_wide_mean, SEASON_SQL),
    "sar_features": (q_sar_features, SAR_SQL),
    "first_attr_by_key": (q_first_attr_by_key, FIRST_SQL),
    "lookup_defaults": (q_lookup_defaults, LOOKUP_SQL),
    "latest_per_week": (q_latest_per_week, LATEST_SQL),
    "ndvi_gap_fill": (q_ndvi_gap_fill, gap_sql(LAG)),
    "ndvi_gap_fill_known": (q_ndvi_gap_fill_known, gap_sql(KNOWN)),
    "scene_index": (q_scene_index, SCENE_SQL),
    "scene_index_tiles": (q_scene_index_tiles, SCENE_SQL),
    "assemble_weekly": (q_assemble_weekly, ASSEMBLE_SQL),
    "unknown_fields": (q_unknown_fields, UNKNOWN_SQL),
    "union_parts": (q_union_parts, UNION_SQL),
    "pit_join_ttl": (q_pit_join_ttl, PIT_SQL),
    "pit_join_dense": (q_pit_join_dense, PIT_DENSE_SQL),
    "live_fallback": (q_live_fallback, LIVE_SQL),
    "online_latest": (q_online_latest, ONLINE_SQL),
    "incremental_merge": (q_incremental_merge, MERGE_SQL),
    "bbox_scene_latest": (q_bbox_scene_latest, BBOX_SQL),
}
