"""Streaming jobs. Each takes a streaming DataFrame and returns a writer or a started query."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from fieldlens.functions.scalars import event_time, moment
from fieldlens.operators.asof import merge_snapshot, online_latest
from fieldlens.operators.drift import (
    BUFFER_SIZE,
    BUFFER_TTL,
    drift_level,
    drift_scores,
)
from fieldlens.operators.quality import (
    REQUIRED,
    SUITES,
    contract_state,
    dead_letter,
    merged_states,
    parse_json,
    split_rows,
    state_report,
    unusable,
    usable,
    validate,
    verdict,
)
from fieldlens.operators.weekly import soil_statistics, weather_statistics
from fieldlens.schemas import TOPICS, struct
from fieldlens.sources.commits import CommittedTable, bucket
from fieldlens.sources.tables import land
from fieldlens.streaming.buffers import rolling_buffers

RETENTION = "7 days"  # topic retention: how late a row may be
WEEK_OFFSET = "4 days"  # epoch day 0 was a Thursday; weeks start on Monday


def run(writer: DataStreamWriter, checkpoint: str, interval: str | None = None):
    """Start a writer: everything there is now, or a batch every `interval`."""
    writer = writer.option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start()
    return writer.trigger(availableNow=True).start()


# --- ingestion -----------------------------------------------------------------------


def landing(spark, root: str, topic: str) -> CommittedTable:
    """The accepted rows of a topic by event date, with the time at which each arrived."""
    schema = T.StructType([*TOPICS[topic].fields, T.StructField("received", T.TimestampType())])
    return CommittedTable(spark, f"{root}/landing/{topic}", schema, F.to_date(event_time("timestamp")))


def route_batch(
    batch: DataFrame,
    batch_id: int,
    topic: str,
    root: str,
    at: Column,
    suite: Sequence | None = None,
    by_row: bool = False,
) -> bool:
    """Parse, check and store one batch of raw messages; returns whether it was accepted.

    Unusable messages go to the dead letters. A batch that fails its contract is quarantined whole; with `by_row` only
    the offending rows are. Messages are parsed once. The landing table's commit comes last and names the files that the
    batch has read, where the source tells: a batch that is repeated, and files that a new checkpoint brings again, add
    nothing twice.
    """
    suite = SUITES[topic] if suite is None else suite
    name, table = stream_name(batch), landing(batch.sparkSession, root, topic)
    sources = []
    if "source" in batch.columns:
        batch = table.fresh(batch, "source")
    parsed = parse_json(batch.withColumn("received", at), TOPICS[topic], REQUIRED[topic]).persist()
    try:
        if "source" in batch.columns:
            # the files of one batch
            sources = [r[0] for r in parsed.select("source").distinct().collect()]
        good = usable(parsed, TOPICS[topic], {"received": F.col("received")})
        report = validate(good, suite)
        valid = bool(verdict(report).first().valid)
        aside = f"stream={name}"
        land(unusable(parsed, F.col("received")), f"{root}/dead-letter/{topic}/{aside}", batch_id)
        land(report, f"{root}/reports/{topic}/{aside}", batch_id)
        accepted, rejected = (good, None) if valid else split_rows(good, suite) if by_row else (good.limit(0), good)
        if rejected is not None:
            land(rejected, f"{root}/quarantine/{topic}/{aside}", batch_id)
        table.append(accepted, name, batch_id, sources)
        return valid
    finally:
        parsed.unpersist()


def ingest_stream(
    raw: DataFrame,
    topic: str,
    root: str,
    suite: Sequence | None = None,
    by_row: bool = False,
    abort: bool = False,
    at: Column | None = None,
) -> DataStreamWriter:
    """Check and route every micro-batch of a topic. `abort` stops the stream on a bad batch."""
    received = F.current_timestamp() if at is None else at

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not route_batch(batch, batch_id, topic, root, received, suite, by_row) and abort:
            raise RuntimeError(f"batch {batch_id} of {topic} failed its contract")

    return raw.writeStream.foreachBatch(handle)


def split_burst(
    raw: DataFrame, schema: T.StructType, at: Column, required: Sequence[str] = ("timestamp",)
) -> tuple[DataFrame, DataFrame]:
    """Readings, and buffered releases that carry no time of their own (dead letters)."""
    return dead_letter(raw, schema, required, at)


def late_rows(
    rows: DataFrame, received: str, event: str = "event_time", max_delay: str = RETENTION
) -> tuple[DataFrame, DataFrame]:
    """(in time, late): rows that arrived more than `max_delay` after their event time."""
    in_time = F.col(received) <= F.col(event) + F.expr(f"INTERVAL {max_delay}")
    return rows.filter(in_time), rows.filter(~in_time)


# --- weekly features -----------------------------------------------------------------


def _weekly(stream: DataFrame, statistics: list[Column], delay: str) -> DataFrame:
    if "event_time" not in stream.columns:
        stream = stream.withColumn("event_time", event_time("timestamp"))
    weeks = F.window("event_time", "7 days", startTime=WEEK_OFFSET)
    return (
        stream.withWatermark("event_time", delay)
        .groupBy("field_id", weeks.alias("_week"))
        .agg(*statistics)
        .withColumn("week_start", F.col("_week.start"))
        .drop("_week")
    )


def soil_weekly_stream(
    stream: DataFrame, delay: str = RETENTION, mask_faults: bool = False
) -> DataFrame:
    return _weekly(stream, soil_statistics(mask_faults), delay)


def weather_weekly_stream(stream: DataFrame, delay: str = RETENTION) -> DataFrame:
    return _weekly(stream, weather_statistics(), delay)


def fault_rates(
    readings: DataFrame, window: str = "1 day", keys: Sequence[str] = ("device_id",)
) -> DataFrame:
    """Share of faulty readings per window and device; for tables and streams alike."""
    if "event_time" not in readings.columns:
        readings = readings.withColumn("event_time", event_time("timestamp"))
    if readings.isStreaming:
        readings = readings.withWatermark("event_time", RETENTION)
    faulty = F.col("fault_mode") != "NONE"
    return (
        readings.groupBy(*keys, F.window("event_time", window).alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(faulty.cast("int")).alias("fault_rate"))
        .withColumn("window_start", F.col("_w.start"))
        .drop("_w")
    )


# --- contracts across batches --------------------------------------------------------


def contract_table(spark, root: str, rows: DataFrame, suite: Sequence, keys: Sequence[str], window: str) -> CommittedTable:
    """The state of a contract per window and device; a window is a part of the table."""
    schema = contract_state(spark.createDataFrame([], rows.schema), suite, keys).schema
    return CommittedTable(spark, f"{root}/contract", schema, F.col(window))


def contract_stream(rows: DataFrame, root: str, suite: Sequence, keys: Sequence[str], window: str) -> DataStreamWriter:
    """Keep the state of a contract over the batches of a stream; `keys` are the window and the device.

    Verdicts of a window follow from all its rows, wherever batches end. A batch rewrites the windows it touches.
    """
    keys = list(dict.fromkeys([window, *keys]))
    table = contract_table(rows.sparkSession, root, rows, suite, keys, window)

    def handle(batch: DataFrame, batch_id: int) -> None:
        added = contract_state(batch, suite, keys).persist()
        try:
            table.merge(added, stream_name(batch), batch_id, lambda kept, new: merged_states(kept, new, suite, keys))
        finally:
            added.unpersist()

    return rows.writeStream.foreachBatch(handle)


def settled_windows(table: CommittedTable, suite: Sequence, window: str, before) -> DataFrame:
    """Reports of the windows that lie before a mark: no row of theirs is still expected."""
    parts = [p for p in table.manifest().parts if p < str(before)]
    return state_report(table.read(parts), suite, [window])


# --- late rows -----------------------------------------------------------------------


def split_late(
    rows: DataFrame,
    root: str,
    keep: Callable[[DataFrame, int], None],
    event: str = "event_time",
    delay: str = RETENTION,
) -> DataStreamWriter:
    """Give every batch's rows in time to `keep` and commit the late ones to `root`/late, so that none vanishes.

    A row is late if its event time lies more than `delay` before the newest one of all earlier batches: the stream's
    own watermark, which is committed with the rows. A repeated batch is split as it was the first time.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("batch_id", T.LongType())])
    late = CommittedTable(rows.sparkSession, f"{root}/late", schema, F.to_date(event))
    marks = CommittedTable(
        rows.sparkSession, f"{root}/watermark", struct("batch_id bigint, newest timestamp"), F.lit("all")
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        name = stream_name(batch)
        batch = batch.persist()
        try:
            seen = marks.read().filter(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
            mark = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {delay}")
            is_late = F.coalesce(F.col(event) < mark, F.lit(False))
            keep(batch.filter(~is_late), batch_id)
            late.append(batch.filter(is_late).withColumn("batch_id", F.lit(batch_id)), name, batch_id)
            newest = batch.agg(F.greatest(F.max(event), F.lit(seen).cast("timestamp")).alias("newest"))
            # the last marks suffice to repeat a batch
            marks.merge(
                newest.withColumn("batch_id", F.lit(batch_id)), name, batch_id,
                lambda kept, new: kept.filter(F.col("batch_id") >= batch_id - 2).unionByName(new),
            )
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(handle)


def late_table(spark, root: str, schema: T.StructType) -> DataFrame:
    schema = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return CommittedTable(spark, f"{root}/late", schema, F.lit("")).read()


# --- state ---------------------------------------------------------------------------


def stream_name(batch: DataFrame) -> str:
    """The id of the running query, which its checkpoint keeps: what a committed table knows a stream by."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"


def drift_stream(
    values: DataFrame,
    profile: DataFrame,
    root: str,
    size: int = BUFFER_SIZE,
    ttl: timedelta | None = BUFFER_TTL,
    delay: str = RETENTION,
) -> DataStreamWriter:
    """Rolling buffers per (field, feature) and a drift verdict per touched field and batch.

    `values` has field_id, feature, ts, value and a `tie` number that settles equal times. A batch reads the buffers of
    the fields it brings values for and no others; `root`/levels has a folder of verdicts per batch, which a repeated
    batch replaces.
    """

    def handle(buffers: DataFrame, batch_id: int) -> None:
        levels = drift_level(drift_scores(buffers, profile))
        levels.write.mode("overwrite").parquet(f"{root}/levels/batch_id={batch_id}")

    return rolling_buffers(values, size, ttl, delay).writeStream.outputMode("update").foreachBatch(handle)


# parts of a table of newest rows: what a batch touches is rewritten part by part
LATEST_PARTS = 64


def _latest(spark, root: str, schema: T.StructType, key: str, parts: int) -> CommittedTable:
    return CommittedTable(spark, f"{root}/latest", schema, bucket([key], parts))


def latest_stream(
    rows: DataFrame, root: str, key: str = "field_id", ts: str = "ts", tie: Sequence[str] = (),
    parts: int = LATEST_PARTS,
) -> DataStreamWriter:
    """Newest row per key, kept up to date batch by batch.

    A repeated batch, and a stream that starts anew from a new checkpoint, end in the same table.
    """
    table = _latest(rows.sparkSession, root, rows.schema, key, parts)

    def newer(kept: DataFrame, batch: DataFrame) -> DataFrame:
        return merge_snapshot(kept, batch, key, ts, tie)

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.merge(online_latest(batch, key, ts, tie), stream_name(batch), batch_id, newer)

    return rows.writeStream.foreachBatch(handle)


def latest_table(
    spark, root: str, schema: T.StructType, now: datetime, ts: str = "ts",
    expires: timedelta = timedelta(hours=1),
) -> DataFrame:
    """The kept rows with a flag for those older than `expires`."""
    # the parts of the manifest are read as they are
    kept = CommittedTable(spark, f"{root}/latest", schema, F.lit("")).read()
    return kept.withColumn("stale", F.col(ts) < moment(now - expires))
