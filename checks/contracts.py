"""Contracts, gates, dead letters, late and faulty rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.tables import (
    DAILY,
    EVENTS,
    READINGS,
    daily_climate,
    load,
    readings,
    rounded,
    shown,
    ts_sql,
    with_nan,
)
from fieldlens.operators.quality import (
    SENSOR_SUITE,
    Increasing,
    check_contract,
    climate_gate,
    dead_letter,
    gated,
    split_rows,
    strictly_increasing,
    validate,
    verdict,
)
from fieldlens.schemas import SOIL
from fieldlens.streaming.jobs import fault_rates, late_rows, split_burst

ORDERED_SUITE = [*SENSOR_SUITE, Increasing("timestamp", "event_id", ("device_id",))]
LIMITS = [
    ("temperature", 0, 50, 0.95),
    ("moisture", 0, 100, 0.95),
    ("ph", 4, 9, 0.98),
    ("nitrogen", 0, 500, 0.95),
    ("phosphorus", 0, 200, 0.95),
    ("potassium", 0, 600, 0.95),
]


def q_contract_report(spark, sf):
    return shown(validate(readings(spark, sf), ORDERED_SUITE))


def report_cte(keys: str = "") -> str:
    """Counts per check; `keys` is a column list ending in a comma."""
    parts = [
        f"""SELECT {keys}'not_null' AS "check", '{c}' AS "column", count(*) AS n_checked,
    count(*) - count({c}) AS n_bad, 1.0::DOUBLE AS mostly FROM readings GROUP BY ALL"""
        for c in ("field_id", "device_id", "timestamp")
    ] + [
        f"""SELECT {keys}'between', '{c}', count({c}),
    count(*) FILTER ({c} NOT BETWEEN {lo} AND {hi}), {m}::DOUBLE FROM readings GROUP BY ALL"""
        for c, lo, hi, m in LIMITS
    ] + [
        f"""SELECT {keys}'in_set', 'fault_mode', count(fault_mode), count(*) FILTER
    (fault_mode NOT IN ('NONE', 'DROPOUT', 'DRIFT', 'BURST')), 1.0::DOUBLE FROM readings GROUP BY ALL"""
    ]
    return " UNION ALL ".join(parts)


SHARE = "CASE WHEN n_checked = 0 THEN 1 ELSE (n_checked - n_bad) / n_checked END"
REPORT_SQL = f"""WITH {READINGS}, step AS (SELECT timestamp AS v, lag(timestamp) OVER (
    PARTITION BY device_id ORDER BY event_id, timestamp) AS prev FROM readings),
  r AS ({report_cte()} UNION ALL SELECT 'increasing', 'timestamp', count(prev),
    count(*) FILTER (v <= prev), 1.0::DOUBLE FROM step)
SELECT *, round({SHARE}, 6) AS share_ok, {SHARE} >= mostly AS success FROM r"""


def q_contract_verdict(spark, sf):
    """One verdict per fault mode."""
    report = validate(readings(spark, sf), SENSOR_SUITE, ["fault_mode"])
    return verdict(report, ["fault_mode"])


VERDICT_SQL = f"""WITH {READINGS}, r AS ({report_cte('fault_mode, ')})
SELECT fault_mode, bool_and({SHARE} >= mostly) AS valid,
  count(*) FILTER (NOT ({SHARE} >= mostly)) AS n_failed FROM r GROUP BY fault_mode"""


def q_strictly_increasing(spark, sf):
    """Values in event order per type; five keys, each cut into stretches of events."""
    return strictly_increasing(
        load(spark, sf, "events"), "value", "event_id", ["event_type"], width=1000
    )


INCREASING_SQL = """WITH s AS (SELECT event_type, value AS v, lag(value) OVER (
    PARTITION BY event_type ORDER BY event_id, value) AS prev FROM events)
SELECT event_type, count(prev) AS n_checked, count(*) FILTER (v <= prev) AS n_bad,
  count(*) FILTER (v <= prev) = 0 AS increasing FROM s GROUP BY event_type"""


def q_row_quarantine(spark, sf):
    good, bad = split_rows(readings(spark, sf), SENSOR_SUITE)
    tagged = good.withColumn("side", F.lit("accepted")).unionByName(
        bad.withColumn("side", F.lit("quarantined"))
    )
    return tagged.groupBy("side", "fault_mode").agg(F.count(F.lit(1)).alias("n"))


BAD = " OR ".join(f"coalesce({c} NOT BETWEEN {lo} AND {hi}, FALSE)" for c, lo, hi, _ in LIMITS)
QUARANTINE_SQL = f"""WITH {READINGS} SELECT CASE WHEN {BAD} THEN 'quarantined' ELSE 'accepted' END
  AS side, fault_mode, count(*) AS n FROM readings GROUP BY ALL"""


def q_climate_gate(spark, sf):
    return shown(climate_gate(with_nan(daily_climate(spark, sf))))


GATE = f"""{DAILY}, g AS (SELECT field_id, greatest(avg(CAST(PRECTOTCORR IS NULL AS INTEGER)),
    avg(CAST(T2M_MAX IS NULL AS INTEGER)), avg(CAST(T2M_MIN IS NULL AS INTEGER)),
    avg(CAST(RH2M IS NULL AS INTEGER))) AS r,
    bool_or(coalesce(T2M_MAX < -20 OR T2M_MAX > 50, FALSE)) AS hot,
    bool_or(coalesce(PRECTOTCORR < 0, FALSE)) AS wet FROM daily GROUP BY field_id)"""
GATE_SQL = f"""WITH {GATE} SELECT field_id, round(r, 6) AS max_null_rate,
  hot AS temperature_out_of_range, wet AS negative_rain, r <= 0.05 AND NOT hot AND NOT wet AS passed
FROM g"""


def q_gated_climate(spark, sf):
    """Daily rows of the suppliers whose quantities pass the gate."""
    daily = load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("field_id"),
        F.col("l_shipdate").alias("date"),
        F.col("l_quantity").alias("PRECTOTCORR"),
        F.when(F.col("l_quantity") < 50, F.col("l_quantity") + F.col("l_suppkey") / 50).alias(
            "T2M_MAX"
        ),
        F.col("l_tax").alias("T2M_MIN"),
        F.col("l_discount").alias("RH2M"),
    )
    return gated(daily).groupBy("field_id").agg(F.count(F.lit(1)).alias("n"))


GATED_SQL = """WITH d AS (SELECT l_suppkey AS field_id,
    CASE WHEN l_quantity < 50 THEN l_quantity + l_suppkey / 50 END AS t FROM lineitem)
SELECT field_id, count(*) AS n FROM d GROUP BY field_id
HAVING avg(CAST(t IS NULL AS INTEGER)) <= 0.05 AND NOT bool_or(coalesce(t > 50, FALSE))"""


def raw_messages(spark, sf):
    """Readings as topic messages: faulty ones cut short, buffered ones without a time."""
    rows = readings(spark, sf)
    names = [f.name for f in SOIL.fields]
    text = F.to_json(F.struct(*names))
    burst = F.to_json(F.struct("field_id", F.col("temperature").alias("buffered_value")))
    value = (
        F.when(F.col("fault_mode") == "DROPOUT", F.substring(text, 1, 20))
        .when(F.col("fault_mode") == "BURST", burst)
        .otherwise(text)
    )
    return rows.select(F.col("field_id").alias("key"), value.alias("value"), "ts")


def q_dead_letter(spark, sf):
    good, bad = dead_letter(
        raw_messages(spark, sf), SOIL, ["field_id", "device_id", "timestamp"], F.col("ts")
    )
    letters = bad.select("key", "error", "timestamp")
    accepted = good.select(F.col("field_id").alias("key"), F.lit("").alias("error"), "timestamp")
    return letters.unionByName(accepted)


DEAD_SQL = f"""WITH {READINGS} SELECT field_id AS key, CASE fault_mode
  WHEN 'DROPOUT' THEN 'malformed_json' WHEN 'BURST' THEN 'missing_device_id' ELSE '' END AS error,
  timestamp FROM readings"""


def q_split_burst(spark, sf):
    good, bad = split_burst(raw_messages(spark, sf), SOIL, F.col("ts"))
    tagged = good.select("field_id", F.lit("reading").alias("kind")).unionByName(
        bad.select(F.col("key").alias("field_id"), F.col("error").alias("kind"))
    )
    return tagged.groupBy("field_id", "kind").agg(F.count(F.lit(1)).alias("n"))


BURST_SQL = f"""WITH {READINGS} SELECT field_id, CASE fault_mode WHEN 'DROPOUT' THEN 'malformed_json'
  WHEN 'BURST' THEN 'missing_timestamp' ELSE 'reading' END AS kind, count(*) AS n
FROM readings GROUP BY ALL"""


def q_feature_contract(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    features = load(spark, sf, "events").select(
        F.col("value").alias("rainfall_today_mm"),
        F.when(F.col("event_type") != "error", k).alias("t2m_max_today"),
        F.when(F.col("event_type") == "view", k / 5).alias("et0_today"),
        ((k - 50) / 50).alias("ndvi_latest"),
        F.col("event_type").alias("rh2m_today_text"),
    )
    contract = [
        ("rainfall_today_mm", 0.0, 150.0, False),
        ("t2m_max_today", -20.0, 50.0, False),
        ("et0_today", 0.0, 20.0, True),
        ("ndvi_latest", -1.0, 1.0, True),
        ("gdd_accumulation", 0.0, 3000.0, False),
    ]
    return shown(check_contract(features, contract))


CONTRACT_SQL = f"""WITH {EVENTS}, f AS (SELECT value AS rain,
    CASE WHEN event_type <> 'error' THEN k END AS hot, CASE WHEN event_type = 'view' THEN k / 5 END
    AS et0, (k - 50) / 50 AS ndvi FROM ev),
  r AS (SELECT 'rainfall_today_mm' AS feature, FALSE AS nullable, 1 - count(rain) / count(*) AS rate,
      count(*) FILTER (rain NOT BETWEEN 0 AND 150) AS bad FROM f
    UNION ALL SELECT 't2m_max_today', FALSE, (count(*) - count(hot)) / count(*),
      count(*) FILTER (hot NOT BETWEEN -20 AND 50) FROM f
    UNION ALL SELECT 'et0_today', TRUE, (count(*) - count(et0)) / count(*),
      count(*) FILTER (et0 NOT BETWEEN 0 AND 20) FROM f
    UNION ALL SELECT 'ndvi_latest', TRUE, (count(*) - count(ndvi)) / count(*),
      count(*) FILTER (ndvi NOT BETWEEN -1 AND 1) FROM f
    UNION ALL SELECT 'gdd_accumulation', FALSE, NULL, NULL)
SELECT feature, rate IS NOT NULL AS present, rate IS NOT NULL AS type_ok, nullable,
  round(rate, 6) AS null_rate, bad AS n_out_of_range,
  rate IS NOT NULL AND (nullable OR rate <= 0.05) AND coalesce(bad, 0) = 0 AS success FROM r"""


def q_fault_rates(spark, sf):
    return shown(fault_rates(readings(spark, sf), "1 day", ["field_id"]))


FAULT_SQL = f"""WITH {READINGS} SELECT field_id, {ts_sql("date_trunc('day', ts)")} AS window_start,
  count(*) AS n, round(avg(CAST(fault_mode <> 'NONE' AS INTEGER)), 6) AS fault_rate
FROM readings GROUP BY field_id, date_trunc('day', ts)"""


def q_late_rows(spark, sf):
    """Line items received at the end of the week after the order: late beyond 60 days."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = load(spark, sf, "lineitem")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        "o_orderpriority", F.col("o_orderdate").alias("event_time"),
        F.col("l_shipdate").alias("received"),
    )
    on_time, late = late_rows(rows, "received", max_delay="60 days")
    both = on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.groupBy("o_orderpriority", "late").agg(F.count(F.lit(1)).alias("n"))


LATE_SQL = """SELECT o_orderpriority, l_shipdate > o_orderdate + INTERVAL 60 DAY AS late,
  count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""

QUERIES = {
    "contract_report": (q_contract_report, REPORT_SQL),
    "contract_verdict": (q_contract_verdict, VERDICT_SQL),
    "strictly_increasing": (q_strictly_increasing, INCREASING_SQL),
    "row_quarantine": (q_row_quarantine, QUARANTINE_SQL),
    "climate_gate": (q_climate_gate, GATE_SQL),
    "gated_climate": (q_gated_climate, GATED_SQL),
    "dead_letter": (q_dead_letter, DEAD_SQL),
    "split_burst": (q_split_burst, BURST_SQL),
    "feature_contract": (q_feature_contract, CONTRACT_SQL),
    "fault_rates": (q_fault_rates, FAULT_SQL),
    "late_rows": (q_late_rows, LATE_SQL),
}
