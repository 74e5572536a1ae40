"""Rolling buffers of a field's values as keyed state of a stream.

The state store keeps the newest values of every feature of a field; a batch reads and writes the fields it brings
values for, whatever else is kept. A timer empties the buffer of a feature that has been silent for the time to live.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# times are microseconds, whatever the zone of the session
STATE = "feature string, us bigint, value double, tie bigint"
NAMES = ["feature", "us", "value", "tie"]
# rows that a task holds while it cuts a batch to the newest values
HELD_ROWS = 1_000_000


def newest_of_each(values: DataFrame, size: int) -> DataFrame:
    """Cut what a task has read to the newest `size` values per field and feature, before the shuffle.

    A key of any share of the batch then sends that many rows per task at most.
    """
    least = -(1 << 62)
    schema = "field_id string, feature string, us bigint, value double, tie bigint"
    kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64()]

    def rows(held: dict[tuple, list]) -> pa.RecordBatch:
        found = [(*key, us, value, None if tie == least else tie) for key, own in held.items() for us, tie, _, value in own]
        columns = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["field_id", *NAMES]
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        total, number = 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("field_id", *NAMES)]
            for field, feature, us, value, tie in zip(*columns, strict=True):
                own = held.setdefault((field, feature), [])
                # the number settles equal rows, so that values are not compared
                item = (us, least if tie is None else tie, number, value)
                number += 1
                if len(own) < size:
                    heapq.heappush(own, item)
                    total += 1
                else:
                    heapq.heappushpop(own, item)
            if total >= HELD_ROWS:
                yield rows(held)
                held.clear()
                total = 0
        if held:
            yield rows(held)

    times = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    read = values.filter("ts is not null").select(
        F.col("field_id").cast("string"), "feature", times, F.col("value").cast("double"), F.col("tie").cast("long")
    )
    return read.mapInArrow(cut, schema)


class RollingBuffers(StatefulProcessor):
    """Per field: the newest `size` values of each feature, without what lies before a pause longer than `ttl`.

    Returns the buffers of every field that a batch brings values for.
    """

    def __init__(self, size: int, ttl: timedelta | None):
        self.size = size
        self.ttl = None if ttl is None else ttl // timedelta(microseconds=1)

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", STATE)

    def _kept(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["feature", "us", "tie"], ascending=[True, False, False])
        by = rows.groupby("feature", sort=False)
        rows = rows[by.cumcount() < self.size]
        if self.ttl is not None:
            # the first pause that is too long, from the newest value on, ends the buffer
            pause = rows.groupby("feature", sort=False)["us"].shift(1) - rows["us"]
            ended = (pause > self.ttl).groupby(rows["feature"]).cummax()
            rows = rows[~ended]
        return rows

    def _store(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            self.rows.clear()
            return
        found = zip(*(rows[c].tolist() for c in NAMES), strict=True)
        self.rows.put([(f, us, v, None if pd.isna(i) else int(i)) for f, us, v, i in found])

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in self.rows.get()], columns=NAMES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [self._held(), *(r[NAMES] for r in rows)]
        kept = self._kept(pd.concat([p for p in parts if len(p)], ignore_index=True))
        self._store(kept)
        if self.ttl is not None:
            for newest in kept.groupby("feature")["us"].max().tolist():
                self.handle.registerTimer((newest + self.ttl) // 1000 + 1)
        yield kept.assign(field_id=key[0])[["field_id", *NAMES]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if len(held):
            # a timer of a value that newer ones have followed changes nothing
            limit = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.ttl
            newest = held.groupby("feature")["us"].transform("max")
            self._store(held[newest > limit])
        yield from ()

    def close(self) -> None:
        pass


def rolling_buffers(values: DataFrame, size: int, ttl: timedelta | None, delay: str) -> DataFrame:
    """Buffers of the touched fields after every batch of a stream of (field_id, feature, ts, value, tie).

    Values that come later than `delay` after newer ones do not enter; see `late_rows` for where they go. A hot field
    sends `size` values per feature and task.
    """
    values.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    cut = newest_of_each(values, size).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay)
    found = cut.groupBy("field_id").transformWithStateInPandas(
        RollingBuffers(size, ttl), f"field_id string, {STATE}", "Update", "EventTime"
    )
    return found.select("field_id", "feature", F.timestamp_micros("us").alias("ts"), "value", "tie")


def buffer_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The buffers that a stream keeps, read from its state."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "rows").load()
    rows = rows.select(F.col("key.field_id").alias("field_id"), "list_element.*")
    return rows.select("field_id", "feature", F.timestamp_micros("us").alias("ts"), "value", "tie")
