from datetime import timedelta

import numpy as np
import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from fieldlens.operators.drift import (
    classify_drift,
    drift_level,
    drift_scores,
    psi,
    psi_edges,
    psi_profile,
    reference_long,
    retrain_from_psi,
    retrain_from_rmse,
    rolling_buffer,
)
from fieldlens.operators.prefix import exact_quantiles, running_sums
from fieldlens.operators.drift import bin_counts
from fieldlens.operators.reports import category_drift, column_drift, numeric_drift, performance_drift

PROBS = [i / 10 for i in range(11)]


def twin_psi(ref, cur, n_bins=10):
    """Independent numpy version."""
    ref, cur = ref[~np.isnan(ref)], cur[~np.isnan(cur)]
    if len(ref) < 10 or len(cur) < 30:
        return 0.0
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, n_bins + 1)))
    shares = []
    for sample in (ref, cur):
        share = np.histogram(sample, edges)[0] / len(sample)
        shares.append(np.where(share == 0, 1e-4, share))
    return float(((shares[1] - shares[0]) * np.log(shares[1] / shares[0])).sum())


def long(spark, **samples):
    data = [(k, None if v is None else float(v)) for k, vs in samples.items() for v in vs]
    return spark.createDataFrame(data, "feature string, value double")


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    samples = {
        "normal": rng.normal(10, 2, 700),
        "coarse": rng.integers(0, 4, 500),
        "heavy": np.exp(rng.normal(0, 6, 400)),
        "one": [3.0],
        "two": [1.0, 2.0],
    }
    got = exact_quantiles(long(spark, **samples), ["feature"], "value", PROBS, ranges=8).collect()
    assert len(got) == len(samples)
    for r in got:
        want = np.quantile(np.asarray(samples[r.feature], dtype=float), PROBS)
        assert r.n_values == len(samples[r.feature])
        assert np.allclose(r.quantiles, want, rtol=1e-12)


def test_reference_is_read_once(spark, tmp_path):
    path = str(tmp_path / "ref")
    long(spark, a=range(300), b=range(50)).write.parquet(path)
    edges = psi_edges(spark.read.parquet(path))
    edges.collect()
    final = plan(edges).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


def test_running_sums_any_number_of_ranges(spark):
    df = spark.range(200).select(
        F.lit("k").alias("k"), (F.col("id") * F.col("id")).cast("double").alias("v"),
        F.col("id").alias("n"),
    )
    for ranges in (2, 8, 64):
        got = running_sums(df, ["k"], "v", {"s": "n"}, ranges).orderBy("v").collect()
        assert [r.s for r in got] == list(np.cumsum(range(200)))
        assert {r.s_total for r in got} == {19900}


@pytest.mark.parametrize(
    "ref, cur, want",
    [
        (range(500), range(500), 0.0),
        (range(500), range(1000, 1500), 6.9008475),
        (range(500), range(50, 550), 0.6900848),
        ([5.0] * 50, range(100), 0.0),
        (range(500), range(29), 0.0),
        (range(3), range(100), 0.0),
    ],
)
def test_psi_golden(spark, ref, cur, want):
    profile = psi_profile(long(spark, a=ref))
    assert psi(profile, long(spark, a=cur)).first().psi == pytest.approx(want, abs=1e-7)


def test_psi_matches_numpy(spark):
    rng = np.random.default_rng(11)
    ref = {"a": rng.normal(15, 3, 500), "b": rng.exponential(5, 300), "c": rng.integers(0, 3, 400)}
    cur = {"a": rng.normal(15.5, 3.1, 100), "b": rng.exponential(9, 200), "c": rng.integers(0, 5, 90)}
    cur["a"][:5] = np.nan
    scored = psi(psi_profile(long(spark, **ref)), long(spark, **cur))
    for r in scored.collect():
        want = twin_psi(np.asarray(ref[r.feature], float), np.asarray(cur[r.feature], float))
        assert r.psi == pytest.approx(want, abs=1e-12)
        assert r.psi >= -0.01


def test_psi_separates_shifted(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(10, 2, 500)
    far = rng.normal(50, 1, 500)
    profile = psi_profile(long(spark, a=base))
    assert psi(profile, long(spark, a=base)).first().psi < 0.05
    assert psi(profile, long(spark, a=far)).first().psi > 0.5


def test_profile_counts_equal_a_recount(spark):
    rng = np.random.default_rng(3)
    ref = long(spark, a=rng.normal(0, 1, 333), b=rng.integers(0, 5, 200), c=[1.0] * 12, d=[1.0, 2.0])
    profile = psi_profile(ref)
    recount = {r.feature: r for r in bin_counts(ref, profile, ["feature"]).collect()}
    for r in profile.collect():
        bins = len(r.edges) - 1
        assert r.n_reference == recount[r.feature].n_current
        assert list(r.reference_counts[:bins]) == recount[r.feature].bins[:bins]
        if bins:
            assert sum(r.reference_counts[:bins]) == r.n_reference


def test_constant_reference_has_one_edge(spark):
    assert psi_edges(long(spark, a=[2.0] * 20)).first().edges == [2.0]
    rough = psi_edges(long(spark, a=range(100)), approximate=True).first()
    assert rough.edges[0] == 0.0 and rough.edges[-1] == 99.0


def test_current_side_is_not_shuffled_by_value(spark):
    profile = psi_profile(long(spark, a=range(50)))
    text = plan(psi(profile, long(spark, a=range(100))))
    assert "SortMergeJoin" not in text.split("Exchange hashpartitioning")[-1]
    assert "BroadcastHashJoin" in text and "Python" not in text


def buffer_rows(spark, n, field="f", feature="rainfall_today_mm", shift=0.0):
    return spark.range(n).select(
        F.lit(field).alias("field_id"), F.lit(feature).alias("feature"),
        F.timestamp_seconds("id").alias("ts"), (F.col("id") + shift).cast("double").alias("value"),
        F.col("id").alias("tie"),
    )


def test_buffer_keeps_newest(spark):
    kept = rolling_buffer(buffer_rows(spark, 550))
    assert kept.count() == 500
    assert kept.agg(F.min("value")).first()[0] == 50.0
    many = buffer_rows(spark, 5000).withColumn("field_id", F.col("tie").cast("string"))
    assert plan(rolling_buffer(many)).count("WindowGroupLimit") == 2


def test_buffer_restarts_after_pause(frame):
    df = frame(
        "field_id string, feature string, ts timestamp, value double",
        ("f", "x", "2024-01-01", 1.0), ("f", "x", "2024-01-08", 2.0),
        ("f", "x", "2024-01-15 00:00:01", 3.0), ("f", "x", "2024-01-16", 4.0),
        ("g", "x", "2024-01-01", 5.0),
    )
    kept = rolling_buffer(df, ttl=timedelta(days=7))
    assert rows(kept.select("value"), "value") == [(3.0,), (4.0,), (5.0,)]


def test_scores_and_levels(spark):
    profile = psi_profile(long(spark, rainfall_today_mm=range(500)))
    buffer = (
        buffer_rows(spark, 29, "young", shift=9000)
        .unionByName(buffer_rows(spark, 500, "same"))
        .unionByName(buffer_rows(spark, 500, "far", shift=1000))
        .unionByName(buffer_rows(spark, 40, "lone", "ndvi_latest"))
        .unionByName(buffer_rows(spark, 10, "lone", "gdd_accumulation"))
        .unionByName(buffer_rows(spark, 500, "mixed", shift=48))
    )
    scores = drift_scores(buffer, profile)
    got = {r.field_id: r for r in drift_level(scores).collect()}
    assert got["young"].drift_level == "green" and got["young"].psi_scores == {"rainfall_today_mm": 0.0}
    assert got["same"].max_psi == 0.0 and not got["same"].drift_warning
    assert got["far"].drift_level == "red" and got["far"].drift_warning
    assert got["far"].max_psi == round(6.9008475, 4)
    # enough values but no reference: left out; too few: scored 0
    assert got["lone"].psi_scores == {"gdd_accumulation": 0.0}
    assert got["mixed"].drift_level == "amber"


def test_retrain_rules(frame):
    df = frame("feature string, psi double", ("a", 0.2), ("b", 0.21), ("c", 0.0), ("d", 0.5))
    got = retrain_from_psi(df).first()
    assert (got.breached_feature_count, got.total_feature_count, got.retrain) == (2, 4, True)
    empty = retrain_from_psi(df.filter("false")).first()
    assert (empty.total_feature_count, empty.retrain) == (0, False)
    pairs = frame("current_rmse double, reference_rmse double", (111.0, 100.0), (110.0, 100.0), (5.0, 0.0))
    assert [r.retrain for r in retrain_from_rmse(pairs).collect()] == [True, False, False]


def test_classes(frame):
    df = frame(
        "i int, rolling_psi_breach boolean, season_psi_breach boolean, season_rmse_breach boolean",
        (1, True, True, True), (2, True, True, False), (3, True, False, False), (4, False, False, False),
    )
    assert [r.drift_class for r in classify_drift(df).orderBy("i").collect()] == [
        "genuine_degradation", "seasonal_abnormality", "short_term_shift_or_expected_seasonality",
        "stable",
    ]


def test_reference_long(frame):
    df = frame("T2M_MAX double, PRECTOTCORR double", (1.0, None), (2.0, 3.0))
    got = reference_long(df, {"t2m_max_today": "T2M_MAX", "rainfall_today_mm": "PRECTOTCORR"})
    assert rows(got, "feature", "value") == [
        ("rainfall_today_mm", 3.0), ("t2m_max_today", 1.0), ("t2m_max_today", 2.0),
    ]


def test_numeric_drift_matches_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 400).round(1), rng.normal(0.4, 1, 300).round(1)
    ref = spark.createDataFrame([(float(v),) for v in a], "x double")
    cur = spark.createDataFrame([(float(v),) for v in b], "x double")
    got = numeric_drift(ref, cur, ["x"]).first()
    grid = np.unique(np.concatenate([a, b]))
    f, g = ((np.searchsorted(np.sort(s), grid, "right") / len(s)) for s in (a, b))
    assert got.ks == pytest.approx(np.abs(f - g).max())
    area = (np.abs(f - g)[:-1] * np.diff(grid)).sum()
    assert got.wasserstein == pytest.approx(area / a.std())
    assert got.p_value < 0.01 and got.drifted
    same = numeric_drift(ref, ref, ["x"]).first()
    assert same.ks == 0.0 and same.p_value == 1.0 and not same.drifted


def test_numeric_drift_on_cells_is_close(spark):
    rng = np.random.default_rng(6)
    ref = spark.createDataFrame([(float(v),) for v in rng.normal(0, 1, 3000)], "x double")
    cur = spark.createDataFrame([(float(v),) for v in rng.normal(0.3, 1, 2000)], "x double")
    exact, rough = numeric_drift(ref, cur, ["x"]).first(), numeric_drift(ref, cur, ["x"], 128).first()
    assert (rough.n_ref, rough.n_cur) == (3000, 2000)
    assert rough.ks == pytest.approx(exact.ks, abs=0.01) and rough.ks <= exact.ks + 1e-12
    assert rough.wasserstein == pytest.approx(exact.wasserstein, abs=0.03)


def test_category_and_dataset_drift(frame):
    ref = frame("c string, x double", *[("a", 1.0)] * 5, *[("b", 2.0)] * 5)
    cur = frame("c string, x double", *[("a", 1.0)] * 5, *[("z", 2.0)] * 5)
    got = category_drift(ref, cur, ["c"]).first()
    assert got.n_categories == 3 and got.jensen_shannon == pytest.approx(np.sqrt(np.log(2) / 2))
    table = {r.column: r for r in column_drift(ref, cur, ["x"], ["c"]).collect()}
    assert table["c"].drifted and not table["x"].drifted
    assert table["c"].drifted_share == 0.5 and table["c"].dataset_drift


def test_performance_drift(frame):
    ref = frame("y double, p double", (1.0, 2.0), (2.0, 3.0), (3.0, 4.0))
    got = {r.side: r for r in performance_drift(ref, ref.withColumn("p", F.col("y")), "y", "p").collect()}
    assert got["reference"].mean_error == 1.0 and got["reference"].r2 == pytest.approx(-0.5)
    assert got["current"].rmse == 0.0 and got["current"].r2 == 1.0


@pytest.mark.parametrize("n", [999, 1000, 1001])
def test_the_drift_rule_does_not_depend_on_size(spark, n):
    # a shift that the test's p-value sees and the distance limit does not
    ref = spark.range(n).select((F.col("id") / n).alias("x"))
    cur = spark.range(40 * n).select((F.col("id") / (40 * n) + 0.025).alias("x"))
    by_distance = numeric_drift(ref, cur, ["x"]).first()
    by_test = numeric_drift(ref, cur, ["x"], method="ks_p_value").first()
    assert by_distance.wasserstein == pytest.approx(by_test.wasserstein)
    assert by_distance.drifted == (by_distance.wasserstein >= 0.1)
    assert by_test.drifted == (by_test.p_value < 0.05)
    with pytest.raises(ValueError):
        numeric_drift(ref, cur, ["x"], method="other")
