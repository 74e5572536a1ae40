"""Running sums and exact quantiles over large groups.

A plain window would put a whole group in one task. Here each group is cut into value ranges at
approximate quantiles, summed per range, and the range offsets are added back: the cut points
decide only how even the ranges are, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.session import small_side


def number_array(numbers: Sequence[float]) -> Column:
    """A constant array, built as one expression."""
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in numbers)})")


def snap_to_cuts(
    df: DataFrame, keys: Sequence[str], value: str, cells: int, max_groups: int = 100_000
) -> DataFrame:
    """Replace each value by the upper end of its cell, with `cells` approximate-quantile cells
    per group. One pass finds the cells; their table is broadcast if its size allows."""
    probs = number_array([i / cells for i in range(1, cells + 1)])
    cuts = small_side(
        df.groupBy(*keys).agg(
            F.percentile_approx(value, probs, F.lit(cells * 10)).alias("_cuts")
        ),
        max_groups,
    )
    ranged = _with_range(df.join(cuts, list(keys)), "_cuts", value, cells)
    return ranged.withColumn(value, F.get("_cuts", F.col("_range"))).drop("_cuts", "_range")


def _with_range(df: DataFrame, cuts: str, order: str, ranges: int) -> DataFrame:
    """Adds `_range`, the number of cuts below the value, by halving: log2(ranges) comparisons.

    Each step is a plain column, so the search stays in generated code.
    """
    df, step = df.withColumn("_range", F.lit(0)), ranges // 2
    while step:
        cut = F.get(cuts, F.col("_range") + (step - 1))
        df = df.withColumn(
            "_range", F.col("_range") + F.when(cut < F.col(order), step).otherwise(0)
        )
        step //= 2
    return df


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, str],
    ranges: int = 64,
    needed: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """Inclusive running sums of `sums` (output -> input column) by `order` within `keys`.

    `df` must hold one row per (keys, order) with a double `order`; the summed columns are counts.
    Adds `<output>_total`, the sum over the whole group, and `_center`, a value near the middle.

    `ranges` is a power of two. `needed(before, after, total)` of the first sum limits the result to the ranges that matter;
    the rows of all other ranges are dropped before they are sorted.
    """
    keys, first = list(keys), next(iter(sums))
    probs = number_array([i / ranges for i in range(1, ranges)])
    # counts are never negative: naming all of them here only keeps this branch's columns equal to
    # the other's, so that both read one and the same shuffle
    same_columns = reduce(lambda a, b: a & b, [F.col(src) >= 0 for src in sums.values()])
    cuts = df.filter(same_columns).groupBy(*keys).agg(
        F.percentile_approx(order, probs, F.lit(ranges * 50)).alias("_cuts")
    )
    ranged = _with_range(df.filter(same_columns).join(cuts, keys), "_cuts", order, ranges).select(
        *df.columns, "_range", F.get("_cuts", F.lit(ranges // 2 - 1)).alias("_center")
    )

    by_range = Window.partitionBy(*keys).orderBy("_range")
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "_range").agg(
        *[F.sum(src).alias(f"_sum_{out}") for out, src in sums.items()]
    )
    offsets = totals.select(
        *keys,
        "_range",
        f"_sum_{first}",
        *[
            F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_before_{out}")
            for out in sums
        ],
        *[F.sum(f"_sum_{out}").over(whole).alias(f"{out}_total") for out in sums],
    )
    if needed is not None:
        start = F.col(f"_before_{first}")
        after = start + F.col(f"_sum_{first}")
        offsets = offsets.filter(needed(start, after, F.col(f"{first}_total")))
    inside = (
        Window.partitionBy(*keys, "_range")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = ranged.join(offsets.drop(f"_sum_{first}"), [*keys, "_range"])
    result = joined.withColumns(
        {
            out: F.sum(src).over(inside) + F.col(f"_before_{out}")
            for out, src in sums.items()
        }
    )
    return result.drop("_range", *[f"_before_{out}" for out in sums])


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per distinct non-missing value: combined before the shuffle."""
    x = F.col(value).cast("double")
    kept = df.select(*keys, x.alias("value")).filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    return kept.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def interpolate(lower: Column, upper: Column, share: Column) -> Column:
    return lower + (upper - lower) * share


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    ranges: int = 64,
) -> DataFrame:
    """Linear-interpolated quantiles per group.

    Returns the group size `n_values`, the array `quantiles`, and the array `below`: how many
    values are smaller than each quantile.
    """
    keys = list(keys)
    shares = number_array(probs)

    def ranks(total: Column) -> Column:
        """0-based ranks on both sides of every quantile's position."""
        sides = F.transform(
            shares,
            lambda p: F.array(F.floor((total - 1) * p), F.ceil((total - 1) * p)),
        )
        return F.array_distinct(F.flatten(sides))

    def holds_a_rank(start: Column, after: Column, total: Column) -> Column:
        return F.exists(ranks(total), lambda r: (start <= r) & (r < after))

    counts = value_counts(df, keys, value)
    ranked = running_sums(counts, keys, "value", {"upto": "n"}, ranges, holds_a_rank)
    # at most two rows per quantile and group are left
    picked = (
        ranked.withColumn("start", F.col("upto") - F.col("n"))
        .filter(holds_a_rank(F.col("start"), F.col("upto"), F.col("upto_total")))
        .groupBy(*keys)
        .agg(
            F.max("upto_total").alias("n_values"),
            F.collect_list(F.struct("start", "upto", "value")).alias("_picked"),
        )
    )

    def holder(rank: Column) -> Column:
        found = F.filter("_picked", lambda s: (s["start"] <= rank) & (rank < s["upto"]))
        return F.get(found, F.lit(0))

    places = F.transform(shares, lambda p: (F.col("n_values") - 1) * p)
    sides = F.transform(
        places,
        lambda h: F.struct(
            (h - F.floor(h)).alias("part"),
            holder(F.floor(h)).alias("low"),
            holder(F.ceil(h))["value"].alias("high"),
        ),
    )
    edges = F.transform(
        sides,
        lambda s: F.struct(
            interpolate(s["low"]["value"], s["high"], s["part"]).alias("edge"), s["low"].alias("low")
        ),
    )
    below = F.transform(
        "_edges",
        lambda e: F.when(e["edge"] > e["low"]["value"], e["low"]["upto"]).otherwise(
            e["low"]["start"]
        ),
    )
    return picked.withColumn("_edges", edges).select(
        *keys, "n_values", F.col("_edges.edge").alias("quantiles"), below.alias("below")
    )
