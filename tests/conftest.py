import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("fieldlens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows and a DDL schema to a DataFrame; text in timestamp columns is parsed."""

    def build(ddl, *rows):
        times = [p.split()[0] for p in ddl.split(",") if p.split()[1] == "timestamp"]
        text = ",".join(
            f"{p.split()[0]} string" if p.split()[0] in times else p for p in ddl.split(",")
        )
        df = spark.createDataFrame(list(rows), text)
        for c in times:
            df = df.withColumn(c, df[c].cast("timestamp"))
        return df

    return build
