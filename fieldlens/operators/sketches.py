"""Reference profiles that grow: a quantile sketch per feature and week, kept and merged.

A sketch has a few thousand bytes, whatever it has seen, and sketches merge. So a reference of many weeks is extended
by reading the new week only; the exact profile beside it has to read all values again. With K = 400 the rank of a
quantile is off by 1 % of the values at most, with high probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.session import cut_lineage

K = 400
# shares at which ranks are read off a sketch
GRID = 1000


def sketches(values: DataFrame, keys: Sequence[str] = ("feature",), value: str = "value", k: int = K) -> DataFrame:
    """(keys, n_values, sketch): one row per group. Null and NaN are left out. Spark merges sketches before the shuffle."""
    x = F.col(value).cast("double")
    known = values.filter(x.isNotNull() & ~F.isnan(x))
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_values"), F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch")
    )


def weekly_sketches(
    values: DataFrame, ts: str = "ts", keys: Sequence[str] = ("feature",), value: str = "value", k: int = K
) -> DataFrame:
    """Sketches per week, for a table that is written by week; a week that comes again replaces itself."""
    week = F.date_trunc("week", F.col(ts)).cast("date")
    return sketches(values.withColumn("week_start", week), [*keys, "week_start"], value, k)


def merged_sketches(stored: DataFrame, keys: Sequence[str] = ("feature",), k: int = K) -> DataFrame:
    """One sketch per group from those of its weeks."""
    return stored.groupBy(*keys).agg(
        F.sum("n_values").alias("n_values"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")
    )


def profile_of_sketches(merged: DataFrame, keys: Sequence[str] = ("feature",), n_bins: int = 10) -> DataFrame:
    """A reference profile like that of `psi_profile`, from sketches: edges, and counts between them.

    Equal edges are one; a bin's count is the difference of its edges' ranks, the last one closed.
    """
    shares = lambda n: F.array(*[F.lit(i / n) for i in range(n + 1)])
    edges = F.array_distinct(F.kll_sketch_get_quantile_double("sketch", shares(n_bins)))
    # ranks of the edges: how many of a fine grid's quantiles lie below them
    found = merged.withColumns({"edges": edges, "_grid": F.kll_sketch_get_quantile_double("sketch", shares(GRID))})
    rank = lambda low: F.size(F.filter("_grid", low)) / (GRID + 1)
    found = found.withColumns(
        {
            "_below": F.transform("edges", lambda e: rank(lambda q: q < e)),
            "_upto": F.transform("edges", lambda e: rank(lambda q: q <= e)),
        }
    )
    n = F.size("edges")
    counts = F.transform(
        F.sequence(F.lit(0), n - 2),
        lambda i: F.round(
            (F.when(i == n - 2, F.get("_upto", i + 1)).otherwise(F.get("_below", i + 1)) - F.get("_below", i)) * F.col("n_values")
        ).cast("long"),
    )
    counts = F.when(n > 1, counts).otherwise(F.array().cast("array<bigint>"))
    return cut_lineage(
        found.select(*keys, F.col("n_values").alias("n_reference"), "edges", counts.alias("reference_counts"))
    )
