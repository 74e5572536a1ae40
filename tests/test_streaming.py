import random
import time
from datetime import datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from fieldlens.operators.drift import drift_level, drift_scores, psi_profile, rolling_buffer
from fieldlens.operators.weekly import soil_weekly, weather_weekly
from fieldlens.schemas import SOIL, WEATHER, struct
from fieldlens.sources.topics import read_topic_files, to_topic_files
from fieldlens.streaming import jobs
from fieldlens.sources.commits import CommittedTable, Conflict, bucket
from fieldlens.streaming.buffers import buffer_table, newest_of_each

T0 = 1_704_067_200_000


def readings(spark, n=400, bad=False):
    rng = random.Random(4)
    return spark.createDataFrame(
        [(f"f{rng.randrange(5)}", "d", T0 + rng.randrange(40 * 86_400_000), 99.0 if bad else rng.uniform(5, 40),
          30.0, 6.5, 80.0, 30.0, 120.0, rng.choice(["NONE", "NONE", "DRIFT"])) for _ in range(n)], SOIL)


def done(query):
    assert query.awaitTermination(120)


def streamed(spark, df, path, files):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collected(spark, stream, root, mode="complete"):
    query = stream.writeStream.outputMode(mode).foreachBatch(
        lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/out"))
    done(jobs.run(query, f"{root}/log"))
    return spark.read.parquet(f"{root}/out")


def close(a, b, keys):
    a, b = (df.select(sorted(df.columns)).orderBy(*keys).toPandas() for df in (a, b))
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == float:
            assert a[c].sub(b[c]).abs().fillna(0).max() < 1e-9 and (a[c].isna() == b[c].isna()).all()
        else:
            assert a[c].tolist() == b[c].tolist()


@pytest.mark.parametrize("files", [1, 4])
def test_weekly_stream_equals_batch(spark, tmp_path, files):
    df = readings(spark)
    stream = streamed(spark, df, str(tmp_path / "in"), files)
    got = collected(spark, jobs.soil_weekly_stream(stream, "60 days"), str(tmp_path))
    close(got, soil_weekly(df), ["field_id", "week_start"])


def test_weather_stream_equals_batch(spark, tmp_path):
    df = readings(spark).select(
        F.lit("s").alias("station_id"), "field_id", "timestamp", "temperature",
        F.when(F.col("temperature") > 10, F.col("moisture")).alias("precipitation"),
        F.col("moisture").alias("humidity"), F.col("ph").alias("wind_speed"), F.lit("x").alias("source"))
    df = spark.createDataFrame(df.collect(), WEATHER)
    stream = streamed(spark, df, str(tmp_path / "in"), 3)
    got = collected(spark, jobs.weather_weekly_stream(stream, "60 days"), str(tmp_path))
    close(got, weather_weekly(df), ["field_id", "week_start"])


def test_fault_rates_on_both(spark, tmp_path):
    df = readings(spark)
    stream = streamed(spark, df, str(tmp_path / "in"), 2)
    got = collected(spark, jobs.fault_rates(stream, "1 day", ["field_id"]), str(tmp_path))
    close(got, jobs.fault_rates(df, "1 day", ["field_id"]), ["field_id", "window_start"])


def topic(spark, path, good, bad):
    """One file of good readings with two unusable messages, then one of bad readings."""
    to_topic_files(good.coalesce(1), "field_id", path)
    odd = spark.createDataFrame([("f", '{"field_id":"f","buffered_value":1}'), ("f", "junk")], "key string, value string")
    odd.coalesce(1).write.mode("append").json(path)
    to_topic_files(bad.coalesce(1), "field_id", path)


def test_ingest_routes_batches(spark, tmp_path):
    path, root = str(tmp_path / "topic"), str(tmp_path)
    topic(spark, path, readings(spark, 50), readings(spark, 40, bad=True))
    raw = read_topic_files(spark, path, files_per_batch=1)
    done(jobs.run(jobs.ingest_stream(raw, "soil-sensors", root), f"{root}/log"))
    read = lambda kind: spark.read.option("recursiveFileLookup", True).parquet(f"{root}/{kind}/soil-sensors")
    assert read("landing").count() == 50
    assert read("quarantine").count() == 40
    assert rows(read("dead-letter").select("error"), "error") == [("malformed_json",), ("missing_device_id",)]
    assert read("reports").filter("not success").select("column").distinct().collect()[0][0] == "temperature"


def test_ingest_by_row_and_abort(spark, tmp_path):
    path, root = str(tmp_path / "topic"), str(tmp_path)
    mixed = readings(spark, 30).unionByName(readings(spark, 20, bad=True))
    to_topic_files(mixed.coalesce(1), "field_id", path)
    raw = read_topic_files(spark, path)
    done(jobs.run(jobs.ingest_stream(raw, "soil-sensors", root, by_row=True), f"{root}/log"))
    read = lambda kind: spark.read.option("recursiveFileLookup", True).parquet(f"{root}/{kind}/soil-sensors")
    assert (read("landing").count(), read("quarantine").count()) == (30, 20)
    stopped = jobs.run(jobs.ingest_stream(read_topic_files(spark, path), "soil-sensors", f"{root}/b", abort=True), f"{root}/log2")
    with pytest.raises(Exception, match="failed its contract"):
        stopped.awaitTermination(120)


VALUES = struct("field_id string, feature string, ts timestamp, value double, tie bigint")


def values(spark, n=900):
    rng = random.Random(8)
    return spark.createDataFrame(
        [(rng.choice(["hot", "hot", "cold"]), "rainfall_today_mm", datetime(2024, 1, 1) + timedelta(minutes=7 * i),
          rng.uniform(0, 9), i) for i in range(n)], VALUES)


@pytest.mark.parametrize("files", [1, 3])
def test_drift_stream_equals_batch(spark, tmp_path, files):
    df, root = values(spark), str(tmp_path)
    profile = psi_profile(df.select("feature", "value"))
    stream = streamed(spark, df, f"{root}/in", files)
    done(jobs.run(jobs.drift_stream(stream, profile, root, size=100), f"{root}/log"))
    want = rolling_buffer(df, 100, tie=["tie"], ttl=timedelta(days=7))
    got = buffer_table(spark, f"{root}/log").select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    levels = spark.read.parquet(f"{root}/levels")
    last = levels.filter(F.col("batch_id") == files - 1).drop("batch_id")
    expected = drift_level(drift_scores(want, profile))
    assert rows(last.select("field_id", "max_psi", "drift_level"), "field_id") == rows(
        expected.select("field_id", "max_psi", "drift_level"), "field_id")


def in_order(spark, frames, path):
    """A stream of one file after the other."""
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_silent_buffers_expire_and_late_values_stay_out(spark, tmp_path):
    root, day = str(tmp_path), lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    frames = [
        spark.createDataFrame(r, VALUES)
        for r in (
            [("quiet", "a", day(0), 1.0, 1), ("busy", "a", day(0), 1.0, 2), ("busy", "b", day(0), 7.0, 3)],
            [("busy", "a", day(4), 2.0, 4)],
            [("busy", "a", day(8), 3.0, 5), ("busy", "b", day(1), 8.0, 6)],
            [("busy", "a", day(9), 4.0, 7)],
        )
    ]
    profile = psi_profile(frames[0].select("feature", "value"))
    stream = in_order(spark, frames, f"{root}/in")
    writer = jobs.drift_stream(stream, profile, root, ttl=timedelta(days=5), delay="1 day")
    done(jobs.run(writer, f"{root}/log"))
    got = sorted((r.field_id, r.feature, r.tie) for r in buffer_table(spark, f"{root}/log").collect())
    # the quiet field and the feature that fell silent are gone; the value of day 1 came after day 4 and is late
    assert got == [("busy", "a", k) for k in (2, 4, 5, 7)]
    touched = spark.read.parquet(f"{root}/levels").groupBy("batch_id").agg(F.collect_set("field_id").alias("f")).collect()
    assert {r.batch_id: set(r.f) for r in touched} == {0: {"quiet", "busy"}, 1: {"busy"}, 2: {"busy"}, 3: {"busy"}}


def test_a_hot_key_sends_few_rows(spark):
    df = spark.range(5000).selectExpr(
        "if(id % 10 = 0, 'cold', 'hot') field_id", "'a' feature", "timestamp_seconds(id % 700) ts", "double(id) value",
        "if(id % 7 = 0, null, id) tie").repartition(3)
    found = newest_of_each(df, 20).withColumn("ts", F.timestamp_micros("us"))
    assert found.count() <= 3 * 2 * 20
    want = rolling_buffer(df, 20, tie=["tie"]).groupBy("field_id").agg(F.min("ts"), F.max("ts"), F.count("*"))
    got = rolling_buffer(found, 20, tie=["tie"]).groupBy("field_id").agg(F.min("ts"), F.max("ts"), F.count("*"))
    assert rows(got, "field_id") == rows(want, "field_id")


def test_latest_stream(spark, tmp_path):
    df, root = values(spark, 50), str(tmp_path)
    stream = streamed(spark, df, f"{root}/in", 3)
    done(jobs.run(jobs.latest_stream(stream, root, tie=["tie"]), f"{root}/log"))
    got = jobs.latest_table(spark, root, VALUES, datetime(2024, 1, 1, 6, 30)).collect()
    want = {r.field_id: r.t for r in df.groupBy("field_id").agg(F.max("tie").alias("t")).collect()}
    assert {r.field_id: r.tie for r in got} == want
    assert all(r.stale == (r.ts < datetime(2024, 1, 1, 5, 30)) for r in got)


def test_latest_survives_repeats_and_a_new_checkpoint(spark, tmp_path):
    df, root = values(spark, 60), str(tmp_path)
    stream = streamed(spark, df, f"{root}/in", 3)
    run = lambda log: done(jobs.run(jobs.latest_stream(stream, root, tie=["tie"], parts=4), f"{root}/{log}"))
    read = lambda: sorted(map(tuple, jobs.latest_table(spark, root, VALUES, datetime(2024, 1, 1)).collect()))
    run("log")
    first = read()
    run("log")
    run("another")
    assert read() == first and len(first) == 2


def test_repeated_batch_changes_nothing(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path), struct("x bigint"), bucket(["x"], 3))
    assert table.read().count() == 0 and table.manifest().version == -1
    for batch, new in ((0, True), (1, True), (1, False), (2, True)):
        row = spark.createDataFrame([(batch,)], "x bigint")
        assert table.append(row, "s", batch) == new
    assert rows(table.read(), "x") == [(0,), (1,), (2,)]
    assert rows(table.read(version=0), "x") == [(0,)]


def test_a_merge_rewrites_the_parts_it_touches(spark, tmp_path, monkeypatch):
    table = CommittedTable(spark, str(tmp_path), struct("x bigint, n bigint"), F.col("x") % 4)
    add = lambda kept, new: kept.unionByName(new).groupBy("x").agg(F.sum("n").alias("n"))
    table.merge(spark.range(8).selectExpr("id x", "1L n"), "s", 0, add)
    before = table.manifest().parts
    table.merge(spark.createDataFrame([(1, 5), (5, 5), (21, 5)], "x bigint, n bigint"), "s", 1, add)
    after = table.manifest().parts
    assert {p for p in after if after[p] != before[p]} == {"1"}
    assert rows(table.read(["1"]), "x") == [(1, 6), (5, 6), (21, 5)]
    # a job that dies before its manifest leaves the table as it was, and comes again
    monkeypatch.setattr(table, "_commit", lambda new: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.merge(spark.createDataFrame([(1, 100)], "x bigint, n bigint"), "s", 2, add)
    monkeypatch.undo()
    assert table.read().agg(F.sum("n")).first()[0] == 23
    assert table.merge(spark.createDataFrame([(1, 100)], "x bigint, n bigint"), "s", 2, add)
    assert table.read().agg(F.sum("n")).first()[0] == 123
    # two writers of one version
    stale = table.manifest(1)
    with pytest.raises(Conflict):
        table._commit(stale)


def test_late_rows_are_kept_aside(spark, tmp_path):
    root, day = str(tmp_path), lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    frames = [
        spark.createDataFrame(r, "x int, event_time timestamp")
        for r in ([(1, day(0)), (2, day(20))], [(3, day(12)), (4, day(13)), (5, day(25)), (6, None)], [(7, day(17)), (8, day(18))])
    ]
    stream = in_order(spark, frames, f"{root}/in")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/kept/batch_id={batch_id}")

    done(jobs.run(jobs.split_late(stream, root, keep), f"{root}/log"))
    assert rows(spark.read.parquet(f"{root}/kept").select("x"), "x") == [(1,), (2,), (4,), (5,), (6,), (8,)]
    assert rows(jobs.late_table(spark, root, frames[0].schema).select("x", "batch_id"), "x") == [(3, 1), (7, 2)]


def test_late_rows_and_bursts(frame):
    df = frame("event_time timestamp, received timestamp", ("2024-01-01", "2024-01-08"), ("2024-01-01", "2024-01-08 00:00:01"))
    on_time, late = jobs.late_rows(df, "received")
    assert (on_time.count(), late.count()) == (1, 1)
    raw = frame("key string, value string", ("a", '{"field_id":"a","buffered_value":1.5}'), ("a", '{"field_id":"a","timestamp":3}'))
    good, bad = jobs.split_burst(raw, SOIL, F.timestamp_millis(F.lit(9)))
    assert (good.first().timestamp, bad.first().error, bad.first().timestamp) == (3, "missing_timestamp", 9)
