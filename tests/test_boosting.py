import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.plans import boosting
from fieldlens.plans.boosting import Settings

WHOLE = Settings(max_depth=3, n_estimators=12, learning_rate=0.3, subsample=1.0, colsample=1.0, bins=16)


def sample(spark, n, seed=1, parts=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, (n, 3)).round(2)
    x[::50, 2] = np.nan
    y = 100 * x[:, 0] + 30 * (x[:, 1] > 0.4) + rng.normal(0, 5 + 20 * x[:, 0])
    rows = [(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "x array<double>, y double").repartition(parts), x, y


def scored(model, df):
    from pyspark.ml.functions import array_to_vector

    return model.transform(df.withColumn("features", array_to_vector("x")))


def plain(x, y, s, edges):
    """The same trees, grown one row set at a time; predictions for the rows learned from."""
    bins = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
    out = np.full(len(y), y.mean())

    def grow(rows, depth):
        g = out[rows] - y[rows]
        value = -s.learning_rate * g.sum() / (len(rows) + s.penalty)
        best = (0.0, None)
        for f in range(len(bins)) if depth else ():
            for cut in range(s.bins):
                left = bins[f, rows] <= cut
                n = left.sum()
                if min(n, len(rows) - n) >= s.min_child:
                    a, b = g[left].sum(), g[~left].sum()
                    gain = a * a / (n + s.penalty) + b * b / (len(rows) - n + s.penalty) - g.sum() ** 2 / (len(rows) + s.penalty)
                    if gain > best[0] * (1 + 1e-9) + 1e-9:
                        best = (gain, (rows[left], rows[~left]))
        if best[1] is None:
            return [(rows, value)]
        return [leaf for side in best[1] for leaf in grow(side, depth - 1)]

    for _ in range(s.n_estimators):
        for rows, value in grow(np.arange(len(y)), s.max_depth):
            out[rows] += value
    return out


def test_trees_are_those_of_a_plain_fit(spark):
    df, x, y = sample(spark, 600)
    model = boosting.fit(df, [None], WHOLE)[0]
    got = {(tuple(np.nan_to_num(r.x, nan=-1)), r.y): r.prediction for r in scored(model, df).collect()}
    want = plain(x, y, WHOLE, boosting._edges(df, 3, WHOLE.bins))
    mine = np.array([got[(tuple(np.nan_to_num(a, nan=-1)), b)] for a, b in zip(x, y, strict=True)])
    assert np.abs(mine - want).max() < 1e-6


def test_quantiles_cover_what_they_say(spark):
    s = Settings(max_depth=3, n_estimators=60)
    low, high = boosting.fit(sample(spark, 6000)[0], [0.1, 0.9], s)
    test = sample(spark, 4000, 2)[0]
    below = scored(low, test).agg(F.avg((F.col("y") <= F.col("prediction")).cast("double"))).first()[0]
    above = scored(high, test).agg(F.avg((F.col("y") > F.col("prediction")).cast("double"))).first()[0]
    assert abs(below - 0.1) < 0.025 and abs(above - 0.1) < 0.025


def test_importance_and_partitions(spark):
    s = Settings(max_depth=4, n_estimators=5)
    model = boosting.fit(sample(spark, 2000)[0], [None], s)[0]
    found = model.featureImportances.toArray()
    assert abs(found.sum() - 1) < 1e-9 and found.argmax() == 0
    assert "Python" not in scored(model, sample(spark, 10)[0])._jdf.queryExecution().executedPlan().toString()


def test_many_partitions_are_added_up_in_tasks(spark, monkeypatch):
    df = sample(spark, 500, parts=6)[0]
    s = Settings(max_depth=2, n_estimators=2, subsample=1.0)
    direct = boosting.fit(df, [None], s)[0]
    monkeypatch.setattr(boosting, "DIRECT", 2)
    through = boosting.fit(df, [None], s)[0]
    assert direct.toDebugString.split("\n")[1:] == through.toDebugString.split("\n")[1:]


def test_little_to_learn_from(spark):
    with pytest.raises(ValueError):
        boosting.fit(spark.createDataFrame([], "x array<double>, y double"), [None])
    one = spark.createDataFrame([([1.0, None], 7.0)], "x array<double>, y double")
    for model in boosting.fit(one, [None, 0.5], Settings(n_estimators=3)):
        assert scored(model, spark.createDataFrame([([1.0, 2.0],)], "x array<double>")).first().prediction == pytest.approx(7.0)


def test_a_tree_of_six_levels_takes_three_jobs(spark):
    df = sample(spark, 900)[0]
    sc = spark.sparkContext

    def jobs(n, quantiles):
        group = f"boosting-{n}-{len(quantiles)}"
        sc.setJobGroup(group, group)
        try:
            boosting.fit(df, quantiles, Settings(max_depth=6, n_estimators=n, min_child=1))
        finally:
            sc.setJobGroup("", "")
        return len(sc.statusTracker().getJobIdsForGroup(group))

    assert jobs(7, [None]) - jobs(3, [None]) <= 4 * 3
    # the leaves of quantiles take one more
    assert jobs(7, [None, 0.1, 0.9]) - jobs(3, [None, 0.1, 0.9]) <= 4 * 4


@pytest.mark.parametrize("setting", ["AHEAD_BYTES", "AHEAD_ROWS", "ROUNDS_ROWS"])
def test_trees_do_not_depend_on_how_jobs_are_cut(spark, monkeypatch, setting):
    df = sample(spark, 700)[0]
    s = Settings(max_depth=5, n_estimators=6, min_child=3, bins=16)
    quantiles = [None, 0.2]
    some = [m.toDebugString.split("\n")[1:] for m in boosting.fit(df, quantiles, s)]
    monkeypatch.setattr(boosting, setting, 0)
    other = [m.toDebugString.split("\n")[1:] for m in boosting.fit(df, quantiles, s)]
    for a, b in zip(some, other, strict=True):
        assert [x for x in a if "Predict" not in x] == [x for x in b if "Predict" not in x]
        values = [[float(x.split()[-1]) for x in m if "Predict" in x] for m in (a, b)]
        assert np.abs(np.subtract(*values)).max() < 1e-9


def test_of_features_that_split_alike_the_first_is_taken(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (800, 2)).round(2)
    y = 100 * x[:, 0] + 30 * (x[:, 1] > 0.4) + rng.normal(0, 5, 800)
    rows = [([float(a), 3.0, float(b), float(3 * a)], float(v)) for (a, b), v in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "x array<double>, y double").repartition(3)
    model = boosting.fit(df, [None], Settings(max_depth=4, n_estimators=10, colsample=1.0))[0]
    found = model.featureImportances.toArray()
    assert found[1] == found[3] == 0 and found[0] > found[2] > 0


def test_trees_of_many_nodes(spark):
    df, x, y = sample(spark, 1200)
    s = Settings(max_depth=9, n_estimators=2, learning_rate=0.5, subsample=1.0, colsample=1.0, min_child=1, bins=16)
    model = boosting.fit(df, [None], s)[0]
    got = {(tuple(np.nan_to_num(r.x, nan=-1)), r.y): r.prediction for r in scored(model, df).collect()}
    want = plain(x, y, s, boosting._edges(df, 3, s.bins))
    mine = np.array([got[(tuple(np.nan_to_num(a, nan=-1)), b)] for a, b in zip(x, y, strict=True)])
    assert np.abs(mine - want).max() < 1e-6
