"""The given tables, and the views of them that stand in for field data.

Every view is written twice: as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions.scalars import round_doubles
from fieldlens.session import ensure_checkpoint_dir

DIGITS = 6


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table with its times as session-zone timestamps."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    times = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in times})


def shown(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Times and dates as text, doubles rounded: the form both engines are compared in."""
    text = {
        c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, t in df.dtypes if t == "timestamp"
    } | {c: F.date_format(c, "yyyy-MM-dd") for c, t in df.dtypes if t == "date"}
    return round_doubles(df.withColumns(text), digits)


def ts_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def day_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def rounded(*cols: str, digits: int = DIGITS) -> str:
    """`round(expr, digits) AS name` for each `expr AS name` or plain column."""
    out = []
    for col in cols:
        expr, _, name = col.rpartition(" AS ")
        out.append(f"round({expr or name}, {digits}) AS {name}")
    return ", ".join(out)


def with_nan(df: DataFrame) -> DataFrame:
    """Nulls in columns of doubles as NaN: operators must not tell the two apart."""
    nan = F.lit(float("nan"))
    return df.withColumns({c: F.coalesce(F.col(c), nan) for c, t in df.dtypes if t == "double"})


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, for queries that write tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/work-{uuid.uuid4().hex}"


def events_with_k(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the number in `props` as `k`."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    return load(spark, sf, "events").withColumn("k", k)


# --- events as soil readings -----------------------------------------------------------


def readings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    mode = (
        F.when(F.col("event_type") == "error", "DROPOUT")
        .when(F.col("event_type") == "signup", "DRIFT")
        .when(F.col("event_type") == "purchase", "BURST")
        .otherwise("NONE")
    )
    return events_with_k(spark, sf).select(
        F.concat(F.lit("F"), "user_id").alias("field_id"),
        F.concat(F.lit("D"), "user_id", F.lit("-"), "event_type").alias("device_id"),
        F.unix_millis("ts").alias("timestamp"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("temperature"),
        k.alias("moisture"),
        (k / 20 + 4).alias("ph"),
        (F.col("value") * 2).alias("nitrogen"),
        (k * 1.5).alias("phosphorus"),
        (F.col("value") + k).alias("potassium"),
        mode.alias("fault_mode"),
        "event_id",
        "ts",
    )


EVENTS = """ev AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events)"""

READINGS = f"""{EVENTS}, readings AS (
  SELECT 'F' || user_id AS field_id, 'D' || user_id || '-' || event_type AS device_id,
    epoch_us(ts) // 1000 AS timestamp,
    CASE WHEN event_type <> 'error' THEN value END AS temperature,
    k AS moisture, k / 20 + 4 AS ph, value * 2 AS nitrogen, k * 1.5 AS phosphorus,
    value + k AS potassium,
    CASE event_type WHEN 'error' THEN 'DROPOUT' WHEN 'signup' THEN 'DRIFT'
      WHEN 'purchase' THEN 'BURST' ELSE 'NONE' END AS fault_mode,
    event_id, ts, date_trunc('week', ts) AS week_start
  FROM ev)"""


# --- lineitem as weather events --------------------------------------------------------


def weather(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        F.concat(F.lit("ST"), "l_suppkey").alias("station_id"),
        F.concat(F.lit("F"), "l_suppkey").alias("field_id"),
        F.unix_millis("l_shipdate").alias("timestamp"),
        F.col("l_quantity").alias("temperature"),
        F.when(F.col("l_returnflag") != "R", F.col("l_tax") * 100).alias("precipitation"),
        (F.col("l_discount") * 100).alias("humidity"),
        (F.col("l_extendedprice") / 997).alias("wind_speed"),
        F.lit("driver").alias("source"),
    )


WEATHER = """weather AS (
  SELECT 'ST' || l_suppkey AS station_id, 'F' || l_suppkey AS field_id,
    epoch_us(l_shipdate) // 1000 AS timestamp, l_quantity AS temperature,
    CASE WHEN l_returnflag <> 'R' THEN l_tax * 100 END AS precipitation,
    l_discount * 100 AS humidity, l_extendedprice / 997 AS wind_speed,
    date_trunc('week', l_shipdate) AS week_start
  FROM lineitem)"""


# --- events as scenes ------------------------------------------------------------------


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return events_with_k(spark, sf).select(
        F.concat(F.lit("F"), "user_id").alias("field_id"),
        F.format_string("S%012d", "event_id").alias("scene_id"),
        F.unix_millis("ts").alias("timestamp"),
        F.when(F.col("event_type") != "error", (k - 50) / 50).alias("ndvi"),
        F.col("value").alias("cloud_cover_pct"),
        F.lit(False).alias("ndvi_interpolated"),
        F.when(F.col("event_type") != "view", F.col("event_type") == "signup").alias(
            "ndvi_proxied"
        ),
    )


SCENES = f"""{EVENTS}, scenes AS (
  SELECT 'F' || user_id AS field_id, 'S' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS scene_id,
    epoch_us(ts) // 1000 AS timestamp, CASE WHEN event_type <> 'error' THEN (k - 50) / 50 END AS ndvi,
    value AS cloud_cover_pct, FALSE AS ndvi_interpolated,
    CASE WHEN event_type <> 'view' THEN event_type = 'signup' END AS ndvi_proxied,
    date_trunc('week', ts) AS week_start
  FROM ev), latest AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY field_id, week_start ORDER BY timestamp DESC, scene_id DESC) AS rn
    FROM scenes) WHERE rn = 1)"""


# --- events as daily climate -----------------------------------------------------------


def daily_climate(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    calm = F.when(F.col("event_type") != "error", F.col("value"))
    return (
        events_with_k(spark, sf)
        .groupBy(
            F.concat(F.lit("F"), "user_id").alias("field_id"),
            F.date_trunc("day", "ts").alias("date"),
        )
        .agg(
            F.sum(F.when(F.col("event_type") == "purchase", k)).alias("PRECTOTCORR"),
            F.sum("value").alias("ALLSKY_SFC_SW_DWN"),
            F.max(calm).alias("T2M_MAX"),
            F.min(calm).alias("T2M_MIN"),
            F.avg(k).alias("RH2M"),
            F.count("value").cast("double").alias("WS2M"),
            F.max(k).alias("EVPTRNS"),
        )
    )


DAILY = f"""{EVENTS}, daily AS (
  SELECT 'F' || user_id AS field_id, date_trunc('day', ts) AS date,
    sum(CASE WHEN event_type = 'purchase' THEN k END) AS PRECTOTCORR,
    sum(value) AS ALLSKY_SFC_SW_DWN,
    max(CASE WHEN event_type <> 'error' THEN value END) AS T2M_MAX,
    min(CASE WHEN event_type <> 'error' THEN value END) AS T2M_MIN,
    avg(k) AS RH2M, CAST(count(value) AS DOUBLE) AS WS2M, max(k) AS EVPTRNS
  FROM ev GROUP BY ALL)"""


# --- lineitem with a rule-based prediction ---------------------------------------------


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Line prices as yields, predicted from quantity and list price."""
    part = load(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    lines = load(spark, sf, "lineitem")
    mean = F.col("l_quantity") * F.col("p_retailprice")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.col("p_brand").alias("crop_type"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("yield_kg_per_ha"),
        mean.alias("prediction"),
        (mean * (1 - F.col("l_discount") * 4)).alias("lower_bound"),
        (mean * (1 + F.col("l_tax") * 4 - 0.02)).alias("upper_bound"),
        "l_quantity",
        "p_size",
    )


PREDICTIONS = """pred AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, p_brand AS crop_type, l_shipdate AS ts,
    l_extendedprice AS y, l_quantity * p_retailprice AS p,
    l_quantity * p_retailprice * (1 - l_discount * 4) AS lo,
    l_quantity * p_retailprice * (1 + l_tax * 4 - 0.02) AS hi, l_quantity, p_size
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

METRICS = """count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
    CASE WHEN var_pop(y) = 0 THEN CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END
      ELSE 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END AS r2"""

METRIC_COLS = rounded("rmse", "mae", "r2")
