"""Column drift and performance drift between a reference and a current table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.operators.prefix import running_sums, snap_to_cuts

# fixed values: drift limits
MAX_DISTANCE = 0.1
MIN_P_VALUE = 0.05
DRIFTED_SHARE = 0.5


def _tagged(
    ref: DataFrame, cur: DataFrame, columns: Sequence[str], kind: str, cells: int | None = None
) -> DataFrame:
    """Counts of both sides per (column, distinct value or cell)."""

    def side(df: DataFrame, is_ref: int) -> DataFrame:
        cells = df.select(*[F.col(c).cast(kind).alias(c) for c in columns])
        long = cells.unpivot([], list(columns), "column", "value").filter("value is not null")
        if kind == "double":
            long = long.filter(~F.isnan("value"))
        return long.withColumn("_ref", F.lit(is_ref)).withColumn("_cur", F.lit(1 - is_ref))

    both = side(ref, 1).unionByName(side(cur, 0))
    if cells:
        both = snap_to_cuts(both, ["column"], "value", cells)
    return both.groupBy("column", "value").agg(
        F.sum("_ref").alias("n_ref"), F.sum("_cur").alias("n_cur")
    )


METHODS = ("wasserstein", "ks_p_value")


def numeric_drift(
    ref: DataFrame, cur: DataFrame, columns: Sequence[str], cells: int | None = None,
    method: str = "wasserstein",
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and normed Wasserstein distance per column.

    `drifted` goes by `method`, whatever the number of rows: the distance, or the p-value of the KS test.

    Both come exactly from the running counts over distinct values, which are summed range by
    range, so a column of any size is spread over many tasks. With `cells` (a power of two, such
    as 1024) the counts are taken on that many quantile cells instead: approximate, but no more
    than `cells` rows per column and task are shuffled.
    """
    counts = _tagged(ref, cur, columns, "double", cells).filter(
        (F.col("n_ref") > 0) | (F.col("n_cur") > 0)
    )
    cdf = running_sums(counts, ["column"], "value", {"r": "n_ref", "c": "n_cur"})
    n_ref, n_cur = F.col("r_total"), F.col("c_total")
    gap = F.abs(F.try_divide(F.col("r"), n_ref) - F.try_divide(F.col("c"), n_cur))
    cdf = cdf.withColumn("gap", gap)
    # area between the curves, by parts over values: sum of value * (gap before - gap after)
    # needs only the gap just before each value
    r_before = F.try_divide(F.col("r") - F.col("n_ref"), n_ref)
    c_before = F.try_divide(F.col("c") - F.col("n_cur"), n_cur)
    area = F.sum(F.col("value") * (F.abs(r_before - c_before) - F.col("gap")))
    # spread around the middle cut: the mean is never further from the median than one deviation,
    # so nothing cancels
    off, weight = F.col("value") - F.col("_center"), F.col("n_ref")
    found = cdf.groupBy("column").agg(
        F.max("r_total").alias("n_ref"),
        F.max("c_total").alias("n_cur"),
        F.max("gap").alias("ks"),
        area.alias("_area"),
        F.try_divide(F.sum(off * weight), F.sum(weight)).alias("_m1"),
        F.try_divide(F.sum(off * off * weight), F.sum(weight)).alias("_m2"),
    )
    spread = F.sqrt(F.greatest(F.col("_m2") - F.col("_m1") * F.col("_m1"), F.lit(0.0)))
    n = F.col("n_ref") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur"))
    lam = F.sqrt(n) * F.col("ks")
    # Kolmogorov tail series; its terms vanish quickly
    tail = sum(
        (F.exp(-2.0 * k * k * lam * lam) * (1.0 if k % 2 else -1.0) for k in range(1, 21)),
        F.lit(0.0),
    )
    p = F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(2 * tail, F.lit(0.0)), F.lit(1.0)))
    norm = F.greatest(spread, F.lit(0.001))
    return (
        found.withColumn("p_value", p)
        .withColumn("wasserstein", F.col("_area") / norm)
        .withColumn("drifted", _drifted(method))
        .select("column", "n_ref", "n_cur", "ks", "p_value", "wasserstein", "drifted")
    )


def _drifted(method: str) -> Column:
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    return F.col("p_value") < MIN_P_VALUE if method == "ks_p_value" else F.col("wasserstein") >= MAX_DISTANCE


def category_drift(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Jensen-Shannon distance and chi-square statistic per category column."""
    counts = _tagged(ref, cur, columns, "string")
    totals = counts.groupBy("column").agg(
        F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur")
    )
    shares = counts.join(totals, "column")
    p = F.try_divide(F.col("n_ref"), F.col("t_ref"))
    q = F.try_divide(F.col("n_cur"), F.col("t_cur"))
    m = (p + q) / 2

    def part(x):
        return F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)

    expected = p * F.col("t_cur")
    chi = F.when(F.col("n_ref") > 0, F.pow(F.col("n_cur") - expected, 2) / expected)
    return (
        shares.groupBy("column")
        .agg(
            F.max("t_ref").alias("n_ref"),
            F.max("t_cur").alias("n_cur"),
            F.sqrt(F.greatest(F.sum(part(p) + part(q)) / 2, F.lit(0.0))).alias("jensen_shannon"),
            F.sum(chi).alias("chi_square"),
            F.count(F.lit(1)).alias("n_categories"),
        )
        .withColumn("drifted", F.col("jensen_shannon") >= MAX_DISTANCE)
    )


def column_drift(
    ref: DataFrame, cur: DataFrame, numeric: Sequence[str], categories: Sequence[str] = (),
    cells: int | None = None, method: str = "wasserstein",
) -> DataFrame:
    """One row per column: method, score, drifted, and the share of drifted columns overall."""
    parts = []
    if numeric:
        score = "p_value" if method == "ks_p_value" else "wasserstein"
        parts.append(
            numeric_drift(ref, cur, numeric, cells, method).select(
                "column",
                F.lit(method).alias("method"),
                F.col(score).alias("score"),
                "drifted",
            )
        )
    if categories:
        parts.append(
            category_drift(ref, cur, categories).select(
                "column",
                F.lit("jensen_shannon").alias("method"),
                F.col("jensen_shannon").alias("score"),
                "drifted",
            )
        )
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # one row per column of the table
    share = F.avg(F.col("drifted").cast("int")).over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("drifted_share", share).withColumn(
        "dataset_drift", F.col("drifted_share") >= DRIFTED_SHARE
    )


def performance_drift(ref: DataFrame, cur: DataFrame, y: str, p: str) -> DataFrame:
    """Error metrics of both tables side by side."""

    def errors(df: DataFrame, side: str) -> DataFrame:
        truth, guess = F.col(y).cast("double"), F.col(p).cast("double")
        return df.select(
            F.lit(side).alias("side"), truth.alias("t"), (guess - truth).alias("miss")
        )

    both = errors(ref, "reference").unionByName(errors(cur, "current"))
    squared = F.sum(F.col("miss") * F.col("miss"))
    total = F.var_pop(F.when(F.col("miss").isNotNull(), F.col("t"))) * F.count("miss")
    return both.groupBy("side").agg(
        F.count("miss").alias("n"),
        F.avg("miss").alias("mean_error"),
        F.avg(F.abs("miss")).alias("mae"),
        F.avg(F.abs(F.try_divide(F.col("miss"), F.col("t")))).alias("mape"),
        F.sqrt(F.avg(F.col("miss") * F.col("miss"))).alias("rmse"),
        F.when(total == 0, F.when(squared == 0, 1.0).otherwise(0.0))
        .otherwise(1 - squared / total)
        .alias("r2"),
    )
