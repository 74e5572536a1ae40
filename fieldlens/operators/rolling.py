"""Trailing sums, growing degree days, rates.

The per-field windows run on rows already reduced to one per (field, day), so a window holds as
many rows as the calendar has days, however many readings a field sends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_day(
    df: DataFrame, cols: dict[str, str], key: str = "field_id", ts: str = "ts"
) -> DataFrame:
    """One row per (key, date); `cols` maps a column to sum, avg, min or max."""
    aggregates = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    return df.groupBy(key, F.to_date(ts).alias("date")).agg(
        *[aggregates[how](c).alias(c) for c, how in cols.items()]
    )


def rolling_sum(
    daily: DataFrame, col: str, days: int = 30, key: str = "field_id", date: str = "date",
    out: str | None = None,
) -> DataFrame:
    """Sum over the row's day and the `days - 1` calendar days before it."""
    trailing = (
        Window.partitionBy(key)
        .orderBy(F.unix_date(F.col(date).cast("date")))
        .rangeBetween(-(days - 1), 0)
    )
    return daily.withColumn(out or f"{col}_{days}d", F.sum(col).over(trailing))


def gdd(
    daily: DataFrame,
    sowing: DataFrame,
    base: float = 5.0,
    key: str = "field_id",
    date: str = "date",
    tmax: str = "T2M_MAX",
    tmin: str = "T2M_MIN",
) -> DataFrame:
    """Growing degree days accumulated since each field's `sowing_date`; days before are dropped."""
    since = daily.join(sowing.select(key, "sowing_date"), key).filter(
        F.col(date).cast("date") >= F.col("sowing_date").cast("date")
    )
    heat = F.greatest((F.col(tmax) + F.col(tmin)) / 2 - base, F.lit(0.0))
    season = Window.partitionBy(key).orderBy(date).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    warmth = F.when(F.col(tmax).isNotNull() & F.col(tmin).isNotNull(), heat)
    return since.withColumn(
        "gdd_accumulation", F.coalesce(F.sum(warmth).over(season), F.lit(0.0))
    )


def _seconds(span: str) -> int:
    amount, unit = span.split()
    size = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(amount) * size


def rates(
    log: DataFrame, windows: Sequence[str], slide: str, keys: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """For each of the trailing `windows` the events up to every `slide`, and their rate per second.

    Rows are counted once, per pane of length `slide`. A pane enters a window when it ends and leaves it when it is too
    old: two changes, whatever the window's length, whose running sum is the count. Only the results are spelt out. A
    key has no more panes than the calendar, so its running sum is short. Windows without events have no row.
    """
    step = _seconds(slide)
    pane = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (step * 1_000_000)).cast("long")
    panes = log.filter(F.col(ts).isNotNull()).groupBy(*keys, pane.alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    changes = []
    for w in windows:
        if _seconds(w) % step:
            raise ValueError(f"{w} is no multiple of {slide}")
        length = _seconds(w) // step
        changes += [
            F.struct(F.lit(w).alias("window"), (F.col("_at") + 1).alias("_at"), F.col("_n").alias("_n")),
            F.struct(F.lit(w).alias("window"), (F.col("_at") + 1 + length).alias("_at"), (-F.col("_n")).alias("_n")),
        ]
    changed = panes.select(*keys, F.inline(F.array(*changes)))
    changed = changed.groupBy(*keys, "window", "_at").agg(F.sum("_n").alias("_n"))
    along = Window.partitionBy(*keys, "window").orderBy("_at")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = changed.withColumns({"increase": F.sum("_n").over(upto), "_next": F.lead("_at").over(along)})
    ends = found.filter("increase > 0").withColumn("_end", F.explode(F.sequence("_at", F.col("_next") - 1)))
    length = F.lit(None).cast("int")
    for w in windows:
        length = F.when(F.col("window") == w, F.lit(_seconds(w))).otherwise(length)
    return ends.select(
        *keys,
        "window",
        F.timestamp_micros(F.col("_end") * step * 1_000_000).alias("window_end"),
        "increase",
        (F.col("increase") / length).alias("rate_per_second"),
    )


def rate(
    log: DataFrame, window: str, slide: str, keys: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """`rates` of one window."""
    return rates(log, [window], slide, keys, ts).drop("window")
