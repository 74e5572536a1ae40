"""Top rows and ordered reports. Limits here are the feature, not a shortcut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(df: DataFrame, n: int = 100, order: Sequence[str] = ()) -> DataFrame:
    """First `n` rows in the stated order: a per-task top-n, then one merge."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def newest(df: DataFrame, ts: str, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in tie]).limit(1)


def ranked_importance(importance: DataFrame) -> DataFrame:
    """(feature, importance), most important first."""
    return importance.orderBy(F.col("importance").desc(), "feature")


def top_contributions(
    df: DataFrame, features: Sequence[str], k: int | None = None, out: str = "top"
) -> DataFrame:
    """Array of (feature, contribution) per row by absolute size, cut at `k` if given.

    The features of one row are sorted inside the row; nothing is shuffled.
    """
    entries = F.array(
        *[
            F.struct(
                F.abs(F.col(c)).alias("size"), F.lit(c).alias("feature"),
                F.col(c).alias("contribution"),
            )
            for c in features
        ]
    )
    ordered = F.transform(
        F.sort_array(entries, asc=False), lambda e: F.struct(e["feature"], e["contribution"])
    )
    return df.withColumn(out, F.slice(ordered, 1, k) if k else ordered)
