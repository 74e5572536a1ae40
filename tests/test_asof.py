import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from fieldlens.operators.asof import (
    FeatureView,
    live_features,
    materialize,
    merge_snapshot,
    monthly_defaults,
    ndvi_delta,
    online_latest,
    pit_join,
)
from fieldlens.operators.geo import latest_scene


def test_ttl_ends_are_inclusive(frame):
    view = frame("field_id string, week_start timestamp, x double", ("f", "2024-01-01", 1.0))
    entities = frame(
        "i int, field_id string, event_timestamp timestamp",
        (0, "f", "2023-12-31 23:59:59"), (1, "f", "2024-01-01"), (2, "f", "2024-02-26"),
        (3, "f", "2024-02-26 00:00:00.000001"), (4, "g", "2024-01-05"), (5, None, "2024-01-05"),
        (6, "f", None), (7, "f", "2024-01-20"), (7, "f", "2024-01-20"),
    )
    got = pit_join(entities, [FeatureView("v", view, ["x"])]).orderBy("i").collect()
    assert [r.x for r in got] == [None, 1.0, 1.0, None, None, None, None, 1.0, 1.0]


def test_newest_row_wins_even_with_null_value(frame):
    view = frame(
        "field_id string, week_start timestamp, x double",
        ("f", "2024-01-01", 1.0), ("f", "2024-01-08", None),
    )
    entities = frame("field_id string, event_timestamp timestamp", ("f", "2024-01-09"))
    assert pit_join(entities, [FeatureView("v", view, ["x"])]).first().x is None


@pytest.mark.parametrize("bucket", [None, timedelta(days=1), timedelta(days=500)])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_merge_asof(spark, seed, bucket):
    rng = random.Random(seed)
    origin = pd.Timestamp("1969-06-01") if seed == 2 else pd.Timestamp("2024-01-01")

    def table(n, name):
        # one key holds most rows
        keys = [rng.choice(["hot", "hot", "hot", "a", "b"]) for _ in range(n)]
        at = [origin + pd.Timedelta(minutes=rng.randrange(60 * 24 * 400)) for _ in range(n)]
        df = pd.DataFrame({"field_id": keys, "t": at, name: [float(i) for i in range(n)]})
        return df.drop_duplicates(["field_id", "t"]).sort_values("t")

    left, one, two = table(300, "i"), table(120, "x"), table(40, "y")
    want = left
    for right, ttl, col in ((one, 20, "x"), (two, 90, "y")):
        want = pd.merge_asof(want, right, on="t", by="field_id", tolerance=pd.Timedelta(days=ttl))
    entities = spark.createDataFrame(left).withColumnRenamed("t", "event_timestamp")
    views = [
        FeatureView("one", spark.createDataFrame(one), ["x"], timedelta(days=20), ts="t"),
        FeatureView("two", spark.createDataFrame(two), ["y"], timedelta(days=90), ts="t"),
    ]
    got = pit_join(entities, views, bucket=bucket).toPandas().sort_values("i")
    want = want.sort_values("i")
    for col in ("x", "y"):
        assert got[col].fillna(-1).tolist() == want[col].fillna(-1).tolist()


def test_entities_are_shuffled_once(spark, frame):
    view = frame("field_id string, week_start timestamp, x double", ("f", "2024-01-01", 1.0))
    entities = spark.range(10).select(
        F.col("id").cast("string").alias("field_id"),
        F.timestamp_seconds("id").alias("event_timestamp"),
    )
    views = [FeatureView("a", view, ["x"]), FeatureView("b", view, ["x"], rename={"x": "y"})]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(pit_join(entities, views))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # entities and views are sorted together: one window over all, no join
    assert text.count("Join") == 0 and text.count("_order") > 0
    assert "BroadcastNestedLoop" not in text and "Cartesian" not in text


def test_views_are_read_once(spark, tmp_path):
    path = str(tmp_path / "view")
    spark.range(2000).select(
        (F.col("id") % 50).cast("string").alias("field_id"),
        F.timestamp_seconds(F.col("id") * 86400).alias("week_start"),
        F.col("id").cast("double").alias("x"),
    ).write.parquet(path)
    entities = spark.range(500).select(
        (F.col("id") % 50).cast("string").alias("field_id"),
        F.timestamp_seconds(F.col("id") * 90000).alias("event_timestamp"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = pit_join(entities, [FeatureView("v", spark.read.parquet(path), ["x"])])
        joined.collect()
        final = plan(joined).split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def test_latest_materialize_merge(frame):
    df = frame(
        "field_id string, week_start timestamp, x int",
        ("a", "2024-01-01", 1), ("a", "2024-01-08", 2), ("a", "2024-01-15", 3), ("b", "2024-01-01", 4),
    )
    assert rows(online_latest(df).select("field_id", "x"), "field_id") == [("a", 3), ("b", 4)]
    ranged = materialize(df, datetime(2024, 1, 2), datetime(2024, 1, 8))
    assert rows(ranged.select("field_id", "x")) == [("a", 2)]
    merged = merge_snapshot(df.filter("x = 3"), ranged.unionByName(df.filter("x = 4")))
    assert rows(merged.select("field_id", "x"), "field_id") == [("a", 3), ("b", 4)]


def test_live_fallback_tiers(spark, frame):
    fields = frame("field_id string", ("fresh",), ("cached",), ("old",), ("older",), ("none",))
    seen = frame(
        "field_id string, fetched_at timestamp, rainfall_today_mm double",
        ("fresh", "2024-07-02 00:10:00", 1.0), ("fresh", "2024-07-01 23:50:00", 9.0),
        ("cached", "2024-07-01 23:50:00", 2.0), ("old", "2024-07-01 08:00:00", 3.0),
        ("old", "2024-07-02 00:31:00", 9.0), ("older", "2024-06-30 23:00:00", 4.0),
    )
    got = live_features(
        fields, seen, monthly_defaults(spark), datetime(2024, 7, 2, 0, 30), ["rainfall_today_mm"]
    )
    assert rows(got.select("field_id", "rainfall_today_mm", "tier", "stale_features"), "field_id") == [
        ("cached", 2.0, "cached", True), ("fresh", 1.0, "fresh", False),
        ("none", 2.7, "default", True), ("old", 3.0, "yesterday", True),
        ("older", 2.7, "default", True),
    ]


def test_ndvi_delta(frame):
    df = frame(
        "field_id string, date timestamp, ndvi double",
        ("f", "2024-01-01", 0.25), ("f", "2024-01-03", None), ("f", "2024-01-16", 0.75),
        ("f", "2024-03-01", 0.5),
    )
    got = ndvi_delta(df).orderBy("date").collect()
    assert [r.ndvi_14d_delta for r in got] == [None, None, 0.5, None]


def test_latest_scene_equals_brute_force(spark):
    rng = random.Random(3)
    fields = [(i, x := rng.uniform(-3, 3), y := rng.uniform(50, 55), x + 0.1, y + 0.1) for i in range(40)]
    scenes = []
    for i in range(300):
        x, y, size = rng.choice([-3.0, -1.5, 0.25, 1.0]), rng.choice([50.0, 52.3, 53.0]), rng.choice([0.2, 1.0, 2.5])
        scenes.append((f"s{i:03d}", datetime(2024, 5, 1) + timedelta(days=rng.randrange(30)),
                       rng.uniform(0, 100), x, y, x + size, y + size))
    box = "lon_min double, lat_min double, lon_max double, lat_max double"
    got = latest_scene(
        spark.createDataFrame(fields, f"field_id int, {box}"),
        spark.createDataFrame(scenes, f"scene_id string, datetime timestamp, cloud_cover double, {box}"),
        datetime(2024, 5, 31),
    ).collect()
    want = {}
    for f, x0, y0, x1, y1 in fields:
        hits = [
            (t, s) for s, t, c, a0, b0, a1, b1 in scenes
            if datetime(2024, 5, 17) <= t <= datetime(2024, 5, 31) and c < 80
            and x0 <= a1 and x1 >= a0 and y0 <= b1 and y1 >= b0
        ]
        if hits:
            want[f] = max(hits)[1]
    assert {r.field_id: r.scene_id for r in got} == want and want
