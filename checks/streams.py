"""Streams over the events file. Each result must equal the batch result."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from checks.contracts import BAD, ORDERED_SUITE, SHARE, raw_messages, report_cte
from checks.drift import FEATURES, LEVEL, LEVELS, LONG, MIDDLE, listed, psi_sql, wide_events
from checks.features import SOIL_AGGS, SOIL_COLS, WEEK
from checks.tables import READINGS, load, readings, rounded, scratch, shown, ts_sql
from fieldlens.operators.drift import psi_profile, to_long
from fieldlens.schemas import SOIL
from fieldlens.sources.tables import read_landing
from fieldlens.sources.topics import read_topic_files, to_topic_files
from fieldlens.streaming.buffers import buffer_table
from fieldlens.streaming.jobs import (
    contract_stream,
    contract_table,
    drift_stream,
    ingest_stream,
    landing,
    late_table,
    latest_stream,
    latest_table,
    run,
    settled_windows,
    soil_weekly_stream,
    split_late,
)

LIMIT = 600


def finished(query):
    """Wait for an availableNow query, but never for ever."""
    if not query.awaitTermination(LIMIT):
        query.stop()
        raise TimeoutError(query.name)


def staged(df, spark, n=3):
    """`df` written as `n` files, to be streamed one file per batch."""
    path = f"{scratch(spark)}/source"
    df.repartition(n).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def q_stream_weekly(spark, sf):
    stream = staged(readings(spark, sf), spark)
    root = scratch(spark)
    weekly = soil_weekly_stream(stream, "60 days")
    # complete mode: the table is replaced after every batch, its size is fields x weeks
    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/weekly")

    finished(run(weekly.writeStream.outputMode("complete").foreachBatch(keep), f"{root}/log"))
    return shown(spark.read.parquet(f"{root}/weekly"))


STREAM_WEEKLY_SQL = f"""WITH {READINGS}, w AS (
  SELECT field_id, week_start, {SOIL_AGGS.format(t='temperature')} FROM readings GROUP BY ALL)
SELECT field_id, {WEEK}, {rounded(*SOIL_COLS)} FROM w"""


def in_order(frames, spark):
    """The frames as files that are streamed one after the other."""
    path = f"{scratch(spark)}/source"
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def drift_values(spark, sf):
    wide = wide_events(spark, sf).withColumn("tie", F.col("event_id"))
    return to_long(wide, ["field_id", "ts", "tie"], FEATURES)


def profile_of(rows):
    return psi_profile(rows.filter(F.col("ts") < MIDDLE).select("feature", "value"))


def q_stream_drift(spark, sf):
    """Buffers of all columns after three micro-batches in no order of time."""
    rows = drift_values(spark, sf)
    root = scratch(spark)
    stream = staged(rows, spark)
    writer = drift_stream(stream, profile_of(rows), root, ttl=timedelta(days=7), delay="60 days")
    finished(run(writer, f"{root}/log"))
    return shown(buffer_table(spark, f"{root}/log"))


STREAM_DRIFT_SQL = f"""WITH {LONG}
SELECT field_id, feature, {ts_sql('ts')} AS ts, round(value, 6) AS value, event_id AS tie FROM (
  SELECT *, row_number() OVER (PARTITION BY field_id, feature ORDER BY ts DESC, event_id DESC) AS rn
  FROM long) WHERE rn <= 500"""

CUTS = ["2024-01-11", "2024-01-21"]


def q_stream_drift_levels(spark, sf):
    """Verdicts after each of three batches, which follow one another in time."""
    rows = drift_values(spark, sf)
    ts = F.col("ts")
    parts = [rows.filter(ts < CUTS[0]), rows.filter((ts >= CUTS[0]) & (ts < CUTS[1])), rows.filter(ts >= CUTS[1])]
    root = scratch(spark)
    writer = drift_stream(in_order(parts, spark), profile_of(rows), root, ttl=timedelta(days=7))
    finished(run(writer, f"{root}/log"))
    levels = spark.read.parquet(f"{root}/levels")
    # a batch without data may follow, to fire timers
    return shown(levels.filter("batch_id < 3").withColumn("psi_scores", listed("psi_scores")))


STREAM_LEVELS_SQL = f"""WITH {LONG}, cuts(batch_id, upto) AS (VALUES
    (0, TIMESTAMP '{CUTS[0]}'), (1, TIMESTAMP '{CUTS[1]}'), (2, TIMESTAMP '2100-01-01')),
  buf AS (SELECT * FROM (SELECT long.*, batch_id, row_number() OVER (PARTITION BY batch_id, field_id, feature
    ORDER BY ts DESC, event_id DESC) AS rn FROM long JOIN cuts ON ts < upto) WHERE rn <= 500),
  {psi_sql('buf', 'batch_id, field_id, feature')},
  f AS (SELECT batch_id, field_id, {LEVELS} FROM scored GROUP BY batch_id, field_id)
SELECT batch_id, field_id, {LEVEL} FROM f"""


def q_stream_late(spark, sf):
    """Every event once: in time, or late because the days before the last ones come last."""
    rows = load(spark, sf, "events").withColumnRenamed("ts", "event_time")
    ts = F.col("event_time")
    parts = [rows.filter(ts < CUTS[0]), rows.filter(ts >= CUTS[1]), rows.filter((ts >= CUTS[0]) & (ts < CUTS[1]))]
    root = scratch(spark)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/kept/batch_id={batch_id}")

    finished(run(split_late(in_order(parts, spark), root, keep, delay="14 days"), f"{root}/log"))
    kept = spark.read.parquet(f"{root}/kept").withColumn("late", F.lit(False))
    found = kept.unionByName(late_table(spark, root, rows.schema).withColumn("late", F.lit(True)), True)
    counted = found.groupBy("event_type", "late").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_time").alias("first"), F.max("event_time").alias("last")
    )
    return shown(counted)


STREAM_LATE_SQL = f"""WITH m AS (SELECT max(ts) - INTERVAL 14 DAY AS mark FROM events),
  e AS (SELECT event_type, ts, ts >= TIMESTAMP '{CUTS[0]}' AND ts < TIMESTAMP '{CUTS[1]}' AND ts < mark AS late
    FROM events, m)
SELECT event_type, late, count(*) AS n, {ts_sql('min(ts)')} AS "first", {ts_sql('max(ts)')} AS "last"
FROM e GROUP BY event_type, late"""


def q_stream_ingest(spark, sf):
    """Raw messages through the topic folder, the contract check and the landing zone."""
    root = scratch(spark)
    topic = "soil-sensors"
    half = F.col("moisture") / 2
    calm = readings(spark, sf).withColumns(
        {"temperature": half, "nitrogen": half * 4, "potassium": half * 8}
    )
    to_topic_files(
        calm.select(*[f.name for f in SOIL.fields]).repartition(3),
        "field_id",
        f"{root}/topic",
    )
    raw = read_topic_files(spark, f"{root}/topic", files_per_batch=1)
    finished(run(ingest_stream(raw, topic, root), f"{root}/log"))
    landed = read_landing(spark, f"{root}/landing/{topic}", SOIL)
    return landed.groupBy("field_id", "fault_mode").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
    )


INGEST_SQL = f"""WITH {READINGS} SELECT field_id, fault_mode, count(*) AS n,
  min(timestamp) AS first, max(timestamp) AS last FROM readings GROUP BY ALL"""


def q_stream_quarantine(spark, sf):
    """Broken messages, releases without a device, rows outside the limits and sound ones: each lands in one place."""
    root, topic = scratch(spark), "soil-sensors"
    raw_messages(spark, sf).select("key", "value").repartition(3, "key").write.json(f"{root}/topic")
    raw = read_topic_files(spark, f"{root}/topic", files_per_batch=1)
    writer = lambda: ingest_stream(raw, topic, root, by_row=True)
    finished(run(writer(), f"{root}/log"))
    # the same files from a new checkpoint add nothing
    finished(run(writer(), f"{root}/another-log"))
    count = F.count(F.lit(1)).alias("n")
    read = lambda kind: spark.read.option("recursiveFileLookup", True).parquet(f"{root}/{kind}/{topic}")
    landed = landing(spark, root, topic).read().groupBy(F.lit("accepted").alias("place"), "fault_mode").agg(count)
    aside = read("quarantine").groupBy(F.lit("quarantined").alias("place"), "fault_mode").agg(count)
    broken = read("dead-letter").groupBy(F.lit("dead letter").alias("place"), F.col("error").alias("fault_mode"))
    return landed.unionByName(aside).unionByName(broken.agg(count))


STREAM_QUARANTINE_SQL = f"""WITH {READINGS} SELECT CASE WHEN fault_mode IN ('DROPOUT', 'BURST') THEN 'dead letter'
    WHEN {BAD} THEN 'quarantined' ELSE 'accepted' END AS place,
  CASE fault_mode WHEN 'DROPOUT' THEN 'malformed_json' WHEN 'BURST' THEN 'missing_device_id' ELSE fault_mode END AS fault_mode,
  count(*) AS n FROM readings GROUP BY ALL"""


def q_contract_windows(spark, sf):
    """Reports per day from states that were merged batch by batch, in the order of arrival."""
    rows = readings(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    last = rows.agg(F.max("event_id")).first()[0]
    third = F.floor(F.col("event_id") * 3 / (last + 1))
    root, keys = scratch(spark), ["day", "device_id"]
    stream = in_order([rows.filter(third == k) for k in range(3)], spark)
    finished(run(contract_stream(stream, root, ORDERED_SUITE, keys, "day"), f"{root}/log"))
    table = contract_table(spark, root, rows, ORDERED_SUITE, keys, "day")
    return shown(settled_windows(table, ORDERED_SUITE, "day", "2024-01-29"))


DAY = "strftime(ts, '%Y-%m-%d') AS day, "
CONTRACT_WINDOWS_SQL = f"""WITH {READINGS}, step AS (SELECT {DAY}timestamp AS v, lag(timestamp) OVER (
    PARTITION BY device_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id, timestamp) AS prev FROM readings),
  r AS ({report_cte(DAY)} UNION ALL SELECT day, 'increasing', 'timestamp', count(prev),
    count(*) FILTER (v <= prev), 1.0::DOUBLE FROM step GROUP BY day)
SELECT *, round({SHARE}, 6) AS share_ok, {SHARE} >= mostly AS success FROM r WHERE day < '2024-01-29'"""


def q_stream_latest(spark, sf):
    rows = load(spark, sf, "events")
    root = scratch(spark)
    stream = staged(rows, spark)
    finished(run(latest_stream(stream, root, "user_id", "ts", ["event_id"]), f"{root}/log"))
    now = datetime(2024, 1, 30, 12)
    return shown(latest_table(spark, root, rows.schema, now, expires=timedelta(hours=24)))


STREAM_LATEST_SQL = f"""SELECT event_id, {ts_sql('ts')} AS ts, user_id, event_type,
  round(value, 6) AS value, props, ts < TIMESTAMP '2024-01-29 12:00:00' AS stale
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1"""

QUERIES = {
    "stream_weekly": (q_stream_weekly, STREAM_WEEKLY_SQL),
    "stream_drift": (q_stream_drift, STREAM_DRIFT_SQL),
    "stream_drift_levels": (q_stream_drift_levels, STREAM_LEVELS_SQL),
    "stream_late": (q_stream_late, STREAM_LATE_SQL),
    "stream_ingest": (q_stream_ingest, INGEST_SQL),
    "stream_quarantine": (q_stream_quarantine, STREAM_QUARANTINE_SQL),
    "contract_windows": (q_contract_windows, CONTRACT_WINDOWS_SQL),
    "stream_latest": (q_stream_latest, STREAM_LATEST_SQL),
}
