import numpy as np
from pyspark.sql import functions as F

from fieldlens.operators.drift import psi_profile
from fieldlens.operators.sketches import merged_sketches, profile_of_sketches, sketches, weekly_sketches

N = 60_000


def values(spark):
    return spark.range(N, numPartitions=5).selectExpr(
        "if(id % 3 = 0, 'a', 'b') feature", "pow(hash(id) / 2147483648D, 3) * 100 value",
        "timestamp_seconds(1704067200 + id * 30) ts")


def test_ranks_are_near_and_weeks_add_up(spark):
    df = values(spark)
    weeks = weekly_sketches(df).persist()
    assert weeks.select("week_start").distinct().count() > 2
    profile = {r.feature: r for r in profile_of_sketches(merged_sketches(weeks)).collect()}
    rows = {f: np.sort([r.value for r in df.filter(F.col("feature") == f).collect()]) for f in "ab"}
    for f, sample in rows.items():
        assert profile[f].n_reference == len(sample)
        ranks = np.searchsorted(sample, profile[f].edges, side="right") / len(sample)
        assert np.abs(ranks - np.linspace(0, 1, 11)).max() < 0.01
        assert abs(sum(profile[f].reference_counts) - len(sample)) <= 0.02 * len(sample)
    # the weeks but the last, and the last one added to what is stored
    last = weeks.agg(F.max("week_start")).first()[0]
    older, new = weeks.filter(F.col("week_start") < last), weeks.filter(F.col("week_start") == last)
    grown = merged_sketches(merged_sketches(older).unionByName(new.drop("week_start")))
    assert {r.feature: r.n_values for r in grown.collect()} == {f: len(x) for f, x in rows.items()}


def test_few_values_and_constants(spark):
    rows = [("c", 7.0)] * 40 + [("n", None), ("n", float("nan"))] + [("t", 1.0), ("t", 1.0), ("t", 2.0)]
    df = spark.createDataFrame(rows, "feature string, value double")
    got = {r.feature: r for r in profile_of_sketches(sketches(df)).collect()}
    assert set(got) == {"c", "t"}
    assert (got["c"].edges, got["c"].n_reference, got["c"].reference_counts) == ([7.0], 40, [])
    exact = {r.feature: r for r in psi_profile(df).collect()}
    assert got["t"].edges[-1] == exact["t"].edges[-1] == 2.0 and sum(got["t"].reference_counts) == 3
    assert profile_of_sketches(sketches(df.limit(0))).collect() == []
