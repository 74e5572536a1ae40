"""Event topics: JSON text with the entity id as key.

Kafka needs its connector on the cluster; a folder of JSON-lines files serves where there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

RAW = "key string, value string"


def read_topic(spark: SparkSession, topic: str, servers: str, starting: str = "earliest"):
    """Raw (key, value, received) stream of a topic."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .load()
        .select(
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
            F.col("timestamp").alias("received"),
        )
    )


def read_topic_files(
    spark: SparkSession, path: str, stream: bool = True, files_per_batch: int | None = None
) -> DataFrame:
    """The same from a folder of JSON lines {"key": …, "value": "…"}, with the file of each as `source`."""
    reader = (spark.readStream if stream else spark.read).schema(RAW)
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).select("key", "value", F.col("_metadata.file_path").alias("source"))


def to_messages(df: DataFrame, key: str) -> DataFrame:
    """Rows as topic messages."""
    return df.select(
        F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")
    )


def to_topic(df: DataFrame, key: str, topic: str, servers: str) -> DataStreamWriter | None:
    """Send rows to a topic: written at once for a table, a stream writer for a stream."""
    messages = to_messages(df, key)
    target = {"kafka.bootstrap.servers": servers, "topic": topic}
    if df.isStreaming:
        return messages.writeStream.format("kafka").options(**target)
    messages.write.format("kafka").options(**target).save()
    return None


def to_topic_files(df: DataFrame, key: str, path: str, mode: str = "append") -> None:
    to_messages(df, key).write.mode(mode).json(path)
