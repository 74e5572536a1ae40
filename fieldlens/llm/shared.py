"""What several operators need: sizes checked before a broadcast, and shared folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.session import BROADCAST_BYTES, cut_lineage, ensure_checkpoint_dir, measured

# rows of a few numbers each: some tens of megabytes
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, weigh: Column | None = None) -> DataFrame:
    """Cut the lineage of a narrow table and hint a broadcast if it has at most `rows` rows and 64 MB, about.

    With arrays in it, `weigh` is the number of rows that a row counts for. A larger table is returned without the
    hint, so that the join shuffles both sides.
    """
    kept = cut_lineage(df)
    size = kept.agg(F.sum(F.lit(1) if weigh is None else 1 + weigh)).first()[0] or 0
    if size > rows or measured(kept)[1] > BROADCAST_BYTES:
        return kept
    return F.broadcast(kept)


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: for wide results that are read more than once."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the shared one that the cluster names in spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def fold(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


# rows of documents that go to Python at once: some megabytes of text
ARROW_ROWS = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: batches of fewer of them keep JVM and workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; the number of buckets follows it, so that each bucket stays small."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add `pos`, from 0, in the order of the columns within each `key`, and `n`, the rows of the key.

    Rows are dealt in ranges and numbered there; the rows of a key in earlier ranges are added. So a key may hold any
    share of the rows. Nulls come first; rows equal in all columns are numbered anyhow.
    """
    # ties are dealt over ranges as well; rows are written first, since ranges are found by a pass of their own
    spread = stored(rows).withColumn("_tie", F.monotonically_increasing_id())
    spread = spread.repartitionByRange("key", *order, "_tie").sortWithinPartitions("key", *order).drop("_tie")
    # the number of the partition above the row's place in it
    kept = stored(spread.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33).alias("_part")
    found = kept.groupBy("key", part).agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
    # one row for each key in each partition it reaches: a key has no more rows here than there are partitions
    earlier = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns(
        {
            "_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
            "n": F.sum("_rows").over(Window.partitionBy("key")),
        }
    )
    joined = kept.withColumn("_part", part).join(broadcast_if_small(found), ["key", "_part"])
    return joined.withColumn("pos", F.col("_before") + F.col("_row") - F.col("_first")).drop(
        "_part", "_row", "_rows", "_first", "_before"
    )
