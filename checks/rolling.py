"""Trailing windows, degree days, rates, usage, histograms, freshness."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.tables import DAILY, daily_climate, load, predictions, PREDICTIONS, rounded, shown, ts_sql
from fieldlens.operators.asof import ndvi_delta
from fieldlens.operators.rolling import gdd, per_day, rate, rates, rolling_sum
from fieldlens.operators.telemetry import (
    LATENCY_BUCKETS,
    bucket_histogram,
    freshness,
    histogram_quantile,
    usage_counts,
    yield_summary,
)


def q_rolling_30d(spark, sf):
    """Thirty-day sums per supplier over daily quantities."""
    lines = load(spark, sf, "lineitem")
    daily = per_day(lines, {"l_quantity": "sum"}, "l_suppkey", "l_shipdate")
    return shown(rolling_sum(daily, "l_quantity", 30, "l_suppkey"))


ROLLING_SQL = """WITH d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date,
    sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)
SELECT l_suppkey, strftime(date, '%Y-%m-%d') AS date, round(l_quantity, 6) AS l_quantity,
  round(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY d.date
    RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW), 6) AS l_quantity_30d FROM d"""


def q_gdd(spark, sf):
    daily = daily_climate(spark, sf)
    sowing = daily.groupBy("field_id").agg(
        F.date_add(F.min("date").cast("date"), 3).alias("sowing_date")
    )
    rows = gdd(daily, sowing, 5.0)
    return shown(rows.select("field_id", "date", "gdd_accumulation"))


GDD_SQL = f"""WITH {DAILY}, s AS (SELECT field_id, CAST(min(date) AS DATE) + 3 AS sown
    FROM daily GROUP BY field_id),
  d AS (SELECT field_id, date, CASE WHEN T2M_MAX IS NOT NULL AND T2M_MIN IS NOT NULL
    THEN greatest((T2M_MAX + T2M_MIN) / 2 - 5, 0) END AS h
    FROM daily JOIN s USING (field_id) WHERE CAST(date AS DATE) >= sown)
SELECT field_id, {ts_sql('date')} AS date, round(coalesce(sum(h) OVER (PARTITION BY field_id
  ORDER BY d.date ROWS UNBOUNDED PRECEDING), 0), 6) AS gdd_accumulation FROM d"""


def q_delta_14d(spark, sf):
    daily = daily_climate(spark, sf).select("field_id", "date", F.col("RH2M").alias("ndvi"))
    return shown(ndvi_delta(daily, 14))


DELTA_SQL = f"""WITH {DAILY}, d AS (SELECT field_id, date, RH2M AS ndvi,
    date - INTERVAL 14 DAY AS back FROM daily),
  j AS (SELECT d.*, p.date AS seen, p.ndvi AS past FROM d ASOF LEFT JOIN d p
    ON d.field_id = p.field_id AND d.back >= p.date)
SELECT field_id, {ts_sql('date')} AS date, round(ndvi, 6) AS ndvi,
  round(CASE WHEN seen >= back - INTERVAL 14 DAY THEN ndvi - past END, 6) AS ndvi_14d_delta FROM j"""


def q_rate_1h(spark, sf):
    return shown(rate(load(spark, sf, "events"), "1 hour", "5 minutes", ["event_type"]))


def rate_sql(window_s, slide_s, keys="event_type, "):
    n = window_s // slide_s
    return f"""WITH s AS (SELECT {keys}epoch_us(ts) // {slide_s}000000 AS step FROM events),
  w AS (SELECT {keys}step + unnest(range(1, {n + 1})) AS e FROM s)
SELECT {keys}{ts_sql(f"make_timestamp(e * {slide_s}000000)")} AS window_end, count(*) AS increase,
  round(count(*) / {window_s}, 6) AS rate_per_second FROM w GROUP BY ALL"""


def q_rate_5m(spark, sf):
    return shown(rate(load(spark, sf, "events"), "5 minutes", "5 minutes", ["event_type"]))


def q_rate_7d(spark, sf):
    return shown(rate(load(spark, sf, "events"), "7 days", "6 hours", ["event_type"]))


WINDOWS = ["30 minutes", "1 hour", "24 hours", "7 days"]


def q_rates(spark, sf):
    """All windows of the dashboards from one count per half hour."""
    return shown(rates(load(spark, sf, "events"), WINDOWS, "30 minutes", ["event_type"]))


def rates_sql(slide_s, **windows):
    parts = [
        f"""SELECT event_type, '{name}' AS "window", {ts_sql(f"make_timestamp(e * {slide_s}000000)")} AS window_end,
  count(*) AS increase, round(count(*) / {n}, 6) AS rate_per_second
  FROM (SELECT event_type, step + unnest(range(1, {n // slide_s + 1})) AS e FROM s) GROUP BY event_type, e"""
        for name, n in windows.items()
    ]
    steps = f"WITH s AS (SELECT event_type, epoch_us(ts) // {slide_s}000000 AS step FROM events)"
    return f"{steps} {' UNION ALL '.join(parts)}"


RATES_SQL = rates_sql(1800, **{"30 minutes": 1800, "1 hour": 3600, "24 hours": 86400, "7 days": 604800})


def q_increase_24h(spark, sf):
    return shown(rate(load(spark, sf, "events"), "24 hours", "1 hour"))


def q_usage_counts(spark, sf):
    return shown(usage_counts(load(spark, sf, "events"), ["user_id", "event_type"]))


USAGE_SQL = f"""SELECT user_id, event_type, count(*) AS n, {ts_sql('max(ts)')} AS last_seen
FROM events GROUP BY user_id, event_type"""


def latencies(spark, sf):
    return load(spark, sf, "events").select("event_type", (F.col("value") / 97).alias("latency"))


def q_bucket_histogram(spark, sf):
    rows = bucket_histogram(latencies(spark, sf), "latency", LATENCY_BUCKETS, ["event_type"])
    bound = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    return rows.withColumn("le", bound)


EDGES = "(VALUES (0.05::DOUBLE), (0.1), (0.25), (0.5), (1.0), (2.5), (5.0), ('inf'::DOUBLE)) b(le)"
HIST = f"""h AS (SELECT event_type, le, count(*) FILTER (value / 97 <= le) AS count
    FROM events, {EDGES} GROUP BY ALL)"""
HISTOGRAM_SQL = f"""WITH {HIST} SELECT event_type,
  CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le, count FROM h"""


def q_p95(spark, sf):
    buckets = bucket_histogram(latencies(spark, sf), "latency", LATENCY_BUCKETS, ["event_type"])
    return shown(histogram_quantile(buckets, 0.95, ["event_type"]))


P95_SQL = f"""WITH {HIST}, x AS (SELECT *, coalesce(lag(le) OVER w, 0) AS a,
    coalesce(lag(count) OVER w, 0) AS b, max(count) OVER (PARTITION BY event_type) * 0.95::DOUBLE AS r
    FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le)),
  f AS (SELECT event_type, min(le) AS le FROM x WHERE count >= r GROUP BY event_type)
SELECT event_type, round(CASE WHEN isinf(le) THEN a ELSE a + (le - a) * (r - b) / (count - b) END, 6)
  AS quantile FROM x JOIN f USING (event_type, le)"""


def q_yield_summary(spark, sf):
    rows = predictions(spark, sf).withColumnRenamed("prediction", "predicted_yield_kg_per_ha")
    return shown(yield_summary(rows), 2)


YIELD_SQL = f"""WITH {PREDICTIONS} SELECT crop_type, count(p) AS count, round(sum(p), 2) AS sum
FROM pred GROUP BY crop_type"""


def q_freshness(spark, sf):
    now = datetime(2024, 1, 31, 0, 30)
    return shown(freshness(load(spark, sf, "events"), "ts", now, keys=["user_id"]))


FRESH_SQL = f"""WITH m AS (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id),
  a AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-31 00:30:00') - epoch_us(t)) / 3600000000 AS h FROM m)
SELECT user_id, {ts_sql('t')} AS newest, round(h, 6) AS age_hours, h < 25 AS fresh FROM a"""

QUERIES = {
    "rolling_30d": (q_rolling_30d, ROLLING_SQL),
    "gdd": (q_gdd, GDD_SQL),
    "delta_14d": (q_delta_14d, DELTA_SQL),
    "rate_1h": (q_rate_1h, rate_sql(3600, 300)),
    "rate_5m": (q_rate_5m, rate_sql(300, 300)),
    "rate_7d": (q_rate_7d, rate_sql(604800, 21600)),
    "rates": (q_rates, RATES_SQL),
    "increase_24h": (q_increase_24h, rate_sql(86400, 3600, "")),
    "usage_counts": (q_usage_counts, USAGE_SQL),
    "bucket_histogram": (q_bucket_histogram, HISTOGRAM_SQL),
    "p95": (q_p95, P95_SQL),
    "yield_summary": (q_yield_summary, YIELD_SQL),
    "freshness": (q_freshness, FRESH_SQL),
}
