"""Population stability, drift verdicts and retraining decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.operators.prefix import exact_quantiles
from fieldlens.session import small_side

# fixed values: thresholds
PSI_AMBER = 0.25
PSI_RED = 0.50
MIN_CURRENT = 30
MIN_REFERENCE = 10
EMPTY_SHARE = 1e-4
BUFFER_SIZE = 500
BUFFER_TTL = timedelta(days=7)
RETRAIN_PSI = 0.2
RETRAIN_FEATURE_SHARE = 0.30
RETRAIN_RMSE_LOSS = 0.10


def to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per (ids, feature, value); missing values are dropped."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features])
    long = wide.unpivot(list(ids), list(features), "feature", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def reference_long(daily: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Reference sample per live feature from the daily climate table (feature -> column)."""
    renamed = daily.select(*[F.col(col).alias(name) for name, col in mapping.items()])
    return to_long(renamed, [], list(mapping))


def psi_edges(
    reference: DataFrame,
    keys: Sequence[str] = ("feature",),
    value: str = "value",
    n_bins: int = 10,
    approximate: bool = False,
) -> DataFrame:
    """Quantile edges per key, duplicates removed. `approximate` trades exactness for one pass.

    The exact form also returns `below`, the number of reference values smaller than each edge.
    """
    probs = [i / n_bins for i in range(n_bins + 1)]
    if approximate:
        x = F.col(value).cast("double")
        edges = (
            reference.filter(x.isNotNull() & ~F.isnan(x))
            .groupBy(*keys)
            .agg(
                F.count(F.lit(1)).alias("n_values"),
                F.percentile_approx(x, F.array(*[F.lit(p) for p in probs]), F.lit(10000)).alias(
                    "edges"
                ),
            )
        )
        return edges.withColumn("edges", F.array_distinct("edges"))
    found = exact_quantiles(reference, keys, value, probs)
    pairs = F.array_distinct(
        F.zip_with("quantiles", "below", lambda q, b: F.struct(q.alias("edge"), b.alias("below")))
    )
    return found.withColumn("_pairs", pairs).select(
        *keys, "n_values", F.col("_pairs.edge").alias("edges"), F.col("_pairs.below").alias("below")
    )


def bin_index(value: Column, edges: Column, n_bins: int) -> Column:
    """Histogram bin: half-open, the last one closed; null outside the edges.

    Written as comparisons against single edges, so it stays in generated code.
    """
    position = F.lit(-1)
    for i in range(n_bins + 1):
        position = position + F.when(value >= F.get(edges, F.lit(i)), 1).otherwise(0)
    last = F.size(edges) - 1
    upper = F.get(edges, last)
    return (
        F.when((position < 0) | (value > upper), F.lit(None).cast("int"))
        .when(value == upper, F.when(last > 0, last - 1))
        .otherwise(position)
    )


def bin_counts(
    df: DataFrame, edges: DataFrame, keys: Sequence[str], value: str = "value",
    edge_keys: Sequence[str] = ("feature",), n_bins: int = 10, how: str = "inner",
) -> DataFrame:
    """Counts per bin as the array `bins`; `n_current` counts the values outside as well."""
    x = F.col(value).cast("double")
    kept = df.filter(x.isNotNull() & ~F.isnan(x))
    binned = kept.join(edges.select(*edge_keys, "edges"), list(edge_keys), how).withColumn(
        "_bin", bin_index(x, F.col("edges"), n_bins)
    )
    return binned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_current"),
        F.array(*[F.count_if(F.col("_bin") == i) for i in range(n_bins)]).alias("bins"),
    )


def psi_profile(
    reference: DataFrame,
    keys: Sequence[str] = ("feature",),
    value: str = "value",
    n_bins: int = 10,
    approximate: bool = False,
) -> DataFrame:
    """Edges and bin counts of the reference: one short row per key.

    Computed now, and kept in the checkpoint folder, because it is used over and over; it can also
    be stored as a table. The exact form takes its counts from the running counts that located the
    edges, so the reference is read once.
    """
    edges = psi_edges(reference, keys, value, n_bins, approximate)
    if approximate:
        edges = small_side(edges)
        counts = bin_counts(reference, edges, keys, value, keys, n_bins)
        edges = edges.join(counts, list(keys)).withColumnRenamed("bins", "reference_counts")
    else:
        # bin i holds below[i + 1] - below[i] values; the last one also those equal to its end
        ends = F.when(F.size("below") > 1, F.slice("below", 2, F.size("below") - 2)).otherwise(
            F.array().cast("array<bigint>")
        )
        closed = F.concat(ends, F.array("n_values"))
        starts = F.slice("below", 1, F.greatest(F.size("below") - 1, F.lit(1)))
        edges = edges.withColumn(
            "reference_counts", F.zip_with(closed, starts, lambda end, start: end - start)
        )
    return small_side(
        edges.select(*keys, "edges", F.col("n_values").alias("n_reference"), "reference_counts")
    )


def _share(count: Column, n: Column) -> Column:
    share = F.try_divide(count.cast("double"), n.cast("double"))
    return F.when(share == 0, F.lit(EMPTY_SHARE)).otherwise(share)


def psi(
    profile: DataFrame,
    current: DataFrame,
    keys: Sequence[str] = ("feature",),
    value: str = "value",
    profile_keys: Sequence[str] = ("feature",),
    n_bins: int = 10,
    min_current: int = MIN_CURRENT,
    how: str = "inner",
) -> DataFrame:
    """PSI of the current values per `keys` against the reference profile.

    0.0 when either side is too small. Current values are reduced to bin counts before the
    shuffle, so the group size does not matter. With `how="left"` groups without a reference stay
    and have a null PSI.
    """
    counts = bin_counts(current, profile, keys, value, profile_keys, n_bins, how)
    joined = counts.join(profile, list(profile_keys), how)
    # a few numbers per group from here on; bins beyond the last edge pair up with nothing
    used = F.slice("reference_counts", 1, F.size("edges") - 1)
    terms = F.zip_with(
        F.transform("bins", lambda c: _share(c, F.col("n_current"))),
        F.transform(used, lambda r: _share(r, F.col("n_reference"))),
        lambda cur, ref: F.coalesce((cur - ref) * F.ln(cur / ref), F.lit(0.0)),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda acc, term: acc + term)
    enough = (F.col("n_reference") >= MIN_REFERENCE) & (F.col("n_current") >= min_current)
    score = F.when(F.col("n_reference").isNotNull(), F.when(enough, total).otherwise(F.lit(0.0)))
    return joined.select(*keys, "n_reference", "n_current", score.alias("psi"))


def rolling_buffer(
    values: DataFrame,
    size: int = BUFFER_SIZE,
    keys: Sequence[str] = ("field_id", "feature"),
    ts: str = "ts",
    tie: Sequence[str] = (),
    ttl: timedelta | None = None,
) -> DataFrame:
    """Newest `size` values per key. Spark applies the rank limit before the shuffle as well.

    With `ttl`, a pause longer than that empties a buffer: only the values after the last such
    pause are kept. The result does not depend on how the values arrived in batches.
    """
    newest = Window.partitionBy(*keys).orderBy(
        F.col(ts).desc(), *[F.col(c).desc() for c in tie]
    )
    kept = values.withColumn("_rank", F.row_number().over(newest)).filter(
        F.col("_rank") <= size
    )
    if ttl is None:
        return kept.drop("_rank")
    # at most `size` rows per key from here on; rank 1 is the newest value
    older = F.lead(F.unix_micros(F.col(ts).cast("timestamp"))).over(newest)
    pause = F.unix_micros(F.col(ts).cast("timestamp")) - older
    limit = int(ttl.total_seconds() * 1_000_000)
    paused = kept.withColumn("_pause", F.when(pause > limit, F.col("_rank")))
    restart = F.min("_pause").over(Window.partitionBy(*keys))
    return (
        paused.withColumn("_restart", restart)
        .filter(F.col("_restart").isNull() | (F.col("_rank") <= F.col("_restart")))
        .drop("_rank", "_pause", "_restart")
    )


def drift_scores(
    buffer: DataFrame, profile: DataFrame, field: str = "field_id", n_bins: int = 10
) -> DataFrame:
    """PSI per (field, feature), 4 decimals.

    A feature with fewer than 30 values scores 0.0; one with enough values but no reference is
    left out.
    """
    keys = [field, "feature"]
    scored = psi(profile, buffer, keys, n_bins=n_bins, how="left")
    score = F.when(F.col("n_current") < MIN_CURRENT, F.lit(0.0)).otherwise(F.round("psi", 4))
    return scored.select(
        *keys, F.col("n_current").alias("n_buffer"), score.alias("psi")
    ).filter("psi is not null")


def drift_level(
    scores: DataFrame, field: str = "field_id", amber: float = PSI_AMBER, red: float = PSI_RED
) -> DataFrame:
    """Verdict per field from its worst feature. The score map has one entry per feature."""
    worst = F.col("max_psi")
    return (
        scores.groupBy(field)
        .agg(
            F.round(F.max("psi"), 4).alias("max_psi"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "psi")))).alias(
                "psi_scores"
            ),
        )
        .select(
            field,
            "max_psi",
            (worst > red).alias("drift_warning"),
            F.when(worst > red, "red").when(worst > amber, "amber").otherwise("green").alias(
                "drift_level"
            ),
            "psi_scores",
        )
    )


def retrain_from_psi(
    scores: DataFrame,
    keys: Sequence[str] = (),
    threshold: float = RETRAIN_PSI,
    max_share: float = RETRAIN_FEATURE_SHARE,
) -> DataFrame:
    """Retrain when the share of features above the threshold is too high; no rows, no retrain."""
    counted = scores.groupBy(*keys).agg(
        F.count_if(F.col("psi") > threshold).alias("breached_feature_count"),
        F.count(F.lit(1)).alias("total_feature_count"),
    )
    share = F.try_divide(F.col("breached_feature_count"), F.col("total_feature_count"))
    return counted.withColumn("breach_ratio", share).withColumn(
        "retrain", F.coalesce(F.col("breach_ratio") > max_share, F.lit(False))
    )


def retrain_from_rmse(
    metrics: DataFrame,
    current: str = "current_rmse",
    reference: str = "reference_rmse",
    max_loss: float = RETRAIN_RMSE_LOSS,
) -> DataFrame:
    """Retrain when RMSE got relatively worse than allowed; a zero reference never triggers."""
    loss = F.try_divide(F.col(current) - F.col(reference), F.col(reference))
    return metrics.withColumn("degradation_ratio", loss).withColumn(
        "retrain", F.coalesce(F.col("degradation_ratio") > max_loss, F.lit(False))
    )


def seasonal_rmse(current: DataFrame, reference: DataFrame, season: str = "season") -> DataFrame:
    """Pair the RMSE of each season with that of the same season in the reference."""
    return current.select(season, F.col("rmse").alias("current_rmse")).join(
        reference.select(season, F.col("rmse").alias("reference_rmse")), season
    )


def classify_drift(
    df: DataFrame,
    rolling: str = "rolling_psi_breach",
    season: str = "season_psi_breach",
    rmse: str = "season_rmse_breach",
) -> DataFrame:
    label = (
        F.when(F.col(rmse), "genuine_degradation")
        .when(F.col(season), "seasonal_abnormality")
        .when(F.col(rolling), "short_term_shift_or_expected_seasonality")
        .otherwise("stable")
    )
    return df.withColumn("drift_class", label)
