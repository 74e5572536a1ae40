from types import SimpleNamespace

import pytest

from pyspark.sql import functions as F

from fieldlens.session import ensure_checkpoint_dir, is_local, small_side


def fake(master, named=None, current=None):
    held = {"folder": current}
    context = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: held["folder"],
        setCheckpointDir=lambda folder: held.update(folder=folder),
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))


def test_a_cluster_without_a_shared_folder_raises():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        assert not is_local(master)
        with pytest.raises(ValueError):
            ensure_checkpoint_dir(fake(master))


def test_the_named_folder_is_used():
    assert ensure_checkpoint_dir(fake("yarn", named="hdfs:///shared")) == "hdfs:///shared"
    assert ensure_checkpoint_dir(fake("yarn", current="hdfs:///set")) == "hdfs:///set"


def test_a_local_master_gets_a_folder_of_its_own():
    assert is_local("local") and is_local("local[8]") and is_local("local[*]")
    assert "fieldlens-checkpoint-" in ensure_checkpoint_dir(fake("local[2]"))


def test_wide_tables_are_not_broadcast(spark):
    narrow = small_side(spark.range(1000))
    wide = small_side(spark.range(1000).withColumn("x", F.sequence(F.lit(0), F.lit(500))), max_bytes=100_000)
    many = small_side(spark.range(1000), max_rows=999)
    hinted = [df._jdf.queryExecution().analyzed().toString().startswith("ResolvedHint") for df in (narrow, wide, many)]
    assert hinted == [True, False, False]
    assert small_side(spark.range(0)).count() == 0
