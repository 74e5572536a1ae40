"""Point-in-time joins: the newest feature row at or before an event, within a time to live."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.functions.scalars import as_column, moment
from fieldlens.schemas import MONTHLY_DEFAULT_COLS, MONTHLY_DEFAULTS

TTL = timedelta(weeks=8)


@dataclass
class FeatureView:
    """A feature table with its entity key, event time and time to live."""

    name: str
    df: DataFrame
    cols: Sequence[str]
    ttl: timedelta = TTL
    key: str = "field_id"
    ts: str = "week_start"
    rename: dict[str, str] = field(default_factory=dict)

    def output(self, col: str) -> str:
        return self.rename.get(col, col)


def _micros(span: timedelta) -> int:
    return int(span.total_seconds() * 1_000_000)


def _time(col: Column | str) -> Column:
    return F.unix_micros(as_column(col).cast("timestamp"))


def _changes(views: Sequence[FeatureView], width: int) -> DataFrame:
    """Rows of all views by key and time, with the newest row of every view that reaches a bucket.

    Columns: _key, _bucket, _from, _order, v0, v1, … Each bucket of `width` microseconds is
    self-contained: the state that reaches into it is carried in as an extra row (_order 0), so no
    task ever sorts more than one bucket of one key.
    """
    names = [f"v{i}" for i in range(len(views))]
    parts = []
    for i, view in enumerate(views):
        at = _time(view.ts)
        row = F.struct(at.alias("t"), *[F.col(c) for c in view.cols])
        parts.append(
            view.df.filter(F.col(view.key).isNotNull() & F.col(view.ts).isNotNull()).select(
                F.col(view.key).alias("_key"), at.alias("_from"), row.alias(names[i])
            )
        )
    changes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # one row per (key, time); several rows of one view at the same time: the greatest is kept
    # (`_from` is never null here; saying so spares one of the two readers below a null filter that
    # would set its plan apart, and lets both read the same shuffle)
    bucket = F.coalesce(F.floor(F.col("_from") / width), F.lit(0)).alias("_bucket")
    changes = changes.groupBy("_key", bucket, "_from").agg(*[F.max(v).alias(v) for v in names])

    # newest row of each view per bucket, then per key over buckets (one row per bucket)
    closing = changes.groupBy("_key", "_bucket").agg(*[F.max(v).alias(v) for v in names])
    buckets = Window.partitionBy("_key").orderBy("_bucket")
    so_far = buckets.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closing = closing.select(
        "_key",
        "_bucket",
        F.lead("_bucket").over(buckets).alias("_next"),
        *[F.last(v, ignorenulls=True).over(so_far).alias(v) for v in names],
    )
    expiry = F.greatest(
        *[F.col(f"{v}.t") + _micros(view.ttl) for v, view in zip(names, views)],
        F.lit(-(2**62)),
    )
    final = F.least(
        F.coalesce(F.col("_next"), F.floor(expiry / width)), F.floor(expiry / width)
    )
    carried = closing.withColumn("_until", final).filter(F.col("_until") > F.col("_bucket"))
    carried = carried.select(
        "_key",
        F.explode(F.sequence(F.col("_bucket") + 1, F.col("_until"))).alias("_bucket"),
        *names,
    ).withColumn("_from", F.col("_bucket") * width)

    return changes.withColumn("_order", F.lit(1)).unionByName(
        carried.withColumn("_order", F.lit(0))
    )


def pit_join(
    entities: DataFrame,
    views: Sequence[FeatureView],
    key: str = "field_id",
    ts: str = "event_timestamp",
    bucket: timedelta | None = None,
) -> DataFrame:
    """Left join every view as of each entity row; a match older than the view's TTL is null.

    Entities and the rows of all views are sorted together within (key, time bucket), and each
    entity takes the newest row of every view before it: one pass, linear in the rows of a bucket.
    A dense key spreads over its buckets; `bucket` makes them narrower. Entities without a key or
    time match nothing and are dealt out by a hash of the row. Both ends of the TTL window are
    inclusive.
    """
    width = _micros(bucket or max(view.ttl for view in views))
    names = [f"v{i}" for i in range(len(views))]
    changes = _changes(views, width)
    at = _time(ts)
    usable = F.col(key).isNotNull() & at.isNotNull()
    left = entities.select(
        F.when(usable, F.col(key)).alias("_key"),
        F.when(usable, F.floor(at / width)).otherwise(F.xxhash64(*entities.columns)).alias("_bucket"),
        at.alias("_from"),
        F.lit(2).alias("_order"),
        F.struct(*entities.columns).alias("_row"),
    )
    rows = left.unionByName(changes, allowMissingColumns=True)
    inside = Window.partitionBy("_key", "_bucket").orderBy("_from", "_order")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = [F.last(v, ignorenulls=True).over(upto).alias(v) for v in names]
    matched = rows.select("_from", "_order", "_row", *seen).filter("_order = 2")
    outputs = []
    for v, view in zip(names, views, strict=True):
        fresh = F.col(f"{v}.t") >= F.col("_from") - _micros(view.ttl)
        outputs += [F.when(fresh, F.col(f"{v}.{c}")).alias(view.output(c)) for c in view.cols]
    return matched.select(*[F.col("_row")[c].alias(c) for c in entities.columns], *outputs)


def online_latest(
    view: DataFrame, key: str | Sequence[str] = "field_id", ts: str = "week_start",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Newest row per key. The rank limit is applied before and after the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    newest = Window.partitionBy(*keys).orderBy(
        F.col(ts).desc_nulls_last(), *[F.col(c).desc() for c in tie]
    )
    return (
        view.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
    )


def materialize(
    view: DataFrame,
    start: datetime,
    end: datetime,
    key: str = "field_id",
    ts: str = "week_start",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Newest row per key with event time in [start, end]; the range filter reaches the scan."""
    ranged = view.filter((F.col(ts) >= moment(start)) & (F.col(ts) <= moment(end)))
    return online_latest(ranged, key, ts, tie)


def merge_snapshot(
    previous: DataFrame, changes: DataFrame, key: str = "field_id", ts: str = "week_start",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Snapshot after an incremental load: the newer row of each key wins."""
    merged = previous.unionByName(changes, allowMissingColumns=True)
    return online_latest(merged, key, ts, tie)


def monthly_defaults(spark: SparkSession) -> DataFrame:
    """The twelve fixed default rows."""
    names = ", ".join(f"{c} double" for c in MONTHLY_DEFAULT_COLS)
    return spark.createDataFrame(MONTHLY_DEFAULTS, f"month int, {names}")


def live_features(
    fields: DataFrame,
    observations: DataFrame,
    defaults: DataFrame,
    as_of: datetime,
    cols: Sequence[str] = tuple(MONTHLY_DEFAULT_COLS),
    key: str = "field_id",
    ts: str = "fetched_at",
    fresh_for: timedelta = timedelta(hours=1),
    tie: Sequence[str] = (),
) -> DataFrame:
    """Live weather per field at `as_of`, falling back in order.

    fresh: today's reading no older than `fresh_for`; cached: such a reading from before midnight;
    yesterday: newest reading of the day before; default: the month's row. All but fresh are stale.
    Only two days of observations are read.
    """
    today = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    yesterday = today - timedelta(days=1)
    oldest = min(yesterday, as_of - fresh_for)
    recent = observations.filter(
        (F.col(ts) >= moment(oldest)) & (F.col(ts) <= moment(as_of))
    )
    within = F.col(ts) >= moment(as_of - fresh_for)
    tier = (
        F.when(within & (F.col(ts) >= moment(today)), 1)
        .when(within, 2)
        .when((F.col(ts) >= moment(yesterday)) & (F.col(ts) < moment(today)), 3)
    )
    best = Window.partitionBy(key).orderBy(
        "_tier", F.col(ts).desc(), *[F.col(c).desc() for c in tie]
    )
    chosen = (
        recent.withColumn("_tier", tier)
        .filter("_tier is not null")
        .withColumn("_rank", F.row_number().over(best))
        .filter("_rank = 1")
        .select(key, "_tier", F.struct(*cols).alias("_seen"))
    )
    # the month is fixed by `as_of`, so the defaults are one row
    month = defaults.filter(F.col("month") == as_of.month).select(
        F.lit(as_of.month).alias("_month"), F.struct(*cols).alias("_usual")
    )
    label = (
        F.when(F.col("_tier") == 1, "fresh")
        .when(F.col("_tier") == 2, "cached")
        .when(F.col("_tier") == 3, "yesterday")
        .otherwise("default")
    )
    return (
        fields.join(chosen, key, "left")
        .withColumn("_month", F.lit(as_of.month))
        .join(F.broadcast(month), "_month", "left")
        .select(
            *[F.col(c) for c in fields.columns],
            *[
                F.when(F.col("_tier").isNotNull(), F.col(f"_seen.{c}"))
                .otherwise(F.col(f"_usual.{c}"))
                .alias(c)
                for c in cols
            ],
            F.lit(as_of.date().isoformat()).alias("forecast_date"),
            label.alias("tier"),
            (label != "fresh").alias("stale_features"),
        )
    )


def ndvi_delta(
    daily: DataFrame,
    days: int = 14,
    col: str = "ndvi",
    key: str = "field_id",
    ts: str = "date",
    max_age: timedelta = timedelta(days=14),
) -> DataFrame:
    """Change against the newest value at or before `days` earlier (looked up as of that time).

    Takes one row per (field, day).
    """
    view = FeatureView(
        "past", daily.filter(F.col(col).isNotNull()), [col], max_age, key, ts, {col: "_past"}
    )
    moved = daily.withColumn("_then", F.col(ts).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    joined = pit_join(moved, [view], key, "_then")
    return joined.withColumn(f"{col}_{days}d_delta", F.col(col) - F.col("_past")).drop(
        "_past", "_then"
    )
