"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on. Cluster sizing (executors, memory, shuffle partitions) is
# left to the cluster; AQE coalesces shuffle partitions and splits skewed join partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # call-site capture costs milliseconds per column expression while a plan is built
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "fieldlens", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir, or one set on the context.

    Where neither is set, a local master gets a temporary folder that goes when the process ends. A cluster raises:
    its executors would each write to a disk that the others do not see.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if not current:
            context.setCheckpointDir(named)
    elif not current:
        if not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fieldlens-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and continue from the written files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# what a broadcast may hold, about
BROADCAST_BYTES = 64 << 20


def measured(df: DataFrame, max_rows: int | None = None) -> tuple[int, float]:
    """Rows, counted up to one more than `max_rows`, and about their bytes: the mean of every 64th row as JSON."""
    rows = df if max_rows is None else df.limit(max_rows + 1)
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    text = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    n, mean = rows.agg(F.count(F.lit(1)), F.avg(F.when(F.col("_row") % 64 == 0, text))).first()
    return n, n * (mean or 0.0)


def small_side(df: DataFrame, max_rows: int = 100_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Checkpoint a derived lookup table and broadcast it only if it proves small, in rows and in bytes.

    Both are read off the written table; a larger table is returned without a hint, so the join falls back to a shuffle
    join with AQE skew handling.
    """
    kept = cut_lineage(df)
    rows, size = measured(kept, max_rows)
    return F.broadcast(kept) if rows <= max_rows and size <= max_bytes else kept
