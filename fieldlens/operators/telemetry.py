"""Usage, histograms and freshness over the prediction and event logs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions.scalars import moment

# fixed values: histogram bounds
LATENCY_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
WIDTH_BUCKETS = [50.0, 100.0, 200.0, 400.0, 800.0, 1600.0]
MAX_AGE = timedelta(hours=25)


def usage_counts(log: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Events per label set and when the last one happened."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_seen"))


def bucket_histogram(
    df: DataFrame, col: str, edges: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Cumulative counts per upper bound `le`, the last bound being infinity."""
    names = [f"_le{i}" for i in range(len(edges) + 1)]
    counted = df.groupBy(*keys).agg(
        *[F.count_if(F.col(col) <= e).alias(n) for n, e in zip(names, edges)],
        F.count(col).alias(names[-1]),
    )
    pairs = [
        F.struct(F.lit(float(e)).alias("le"), F.col(n).alias("count"))
        for n, e in zip(names, [*edges, float("inf")])
    ]
    return counted.select(*keys, F.inline(F.array(*pairs)))


def yield_summary(
    log: DataFrame, keys: Sequence[str] = ("crop_type",), col: str = "predicted_yield_kg_per_ha"
) -> DataFrame:
    return log.groupBy(*keys).agg(F.count(col).alias("count"), F.sum(col).alias("sum"))


def histogram_quantile(buckets: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """Quantile from cumulative buckets, interpolated inside the bucket that holds it.

    A quantile beyond the last finite bound gives that bound. The window holds one row per bound.
    """
    tag = F.lit(1).alias("_all")
    parts = [*keys, "_all"]
    order = Window.partitionBy(*parts).orderBy("le")
    rows = buckets.select(*keys, tag, "le", "count").select(
        *parts,
        "le",
        "count",
        F.coalesce(F.lag("le").over(order), F.lit(0.0)).alias("_from"),
        F.coalesce(F.lag("count").over(order), F.lit(0)).alias("_before"),
        F.max("count").over(Window.partitionBy(*parts)).alias("_total"),
    )
    rank = F.col("_total") * q
    inside = F.try_divide(rank - F.col("_before"), F.col("count") - F.col("_before"))
    value = F.when(F.col("le") == float("inf"), F.col("_from")).otherwise(
        F.col("_from") + (F.col("le") - F.col("_from")) * F.coalesce(inside, F.lit(0.0))
    )
    reached = (F.col("_total") > 0) & (F.col("count") >= rank)
    return (
        rows.withColumn("_value", F.when(reached, value))
        .groupBy(*parts)
        .agg(F.min_by("_value", F.when(reached, F.col("le"))).alias("quantile"))
        .drop("_all")
    )


def freshness(
    df: DataFrame, ts: str, now: datetime, max_age: timedelta = MAX_AGE, keys: Sequence[str] = ()
) -> DataFrame:
    """Newest time, its age in hours, and whether that is recent enough."""
    newest = df.groupBy(*keys).agg(F.max(F.col(ts).cast("timestamp")).alias("newest"))
    age = (F.unix_micros(moment(now)) - F.unix_micros("newest")) / 3_600_000_000
    return newest.withColumn("age_hours", age).withColumn(
        "fresh", F.coalesce(F.col("age_hours") < max_age.total_seconds() / 3600, F.lit(False))
    )
