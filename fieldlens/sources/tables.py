"""Files in and out: landing zone, feature tables, dimensions, logs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.operators.assemble import drop_unnamed
from fieldlens.schemas import DAILY_CLIMATE, FIELDS, PREDICTION_LOG, RUN_METRICS


def read_landing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All files of one landing topic as a single scan."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Replace a table, or with `partition_by` only the partitions that occur in `df`."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def land(df: DataFrame, path: str, batch_id: int) -> None:
    """Add one accepted batch. A repeated batch replaces itself, so a retry adds nothing twice."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_daily(
    daily: DataFrame, path: str, partition_by: Sequence[str] = ("field_id", "year")
) -> None:
    """Daily climate by field and year.

    Rows of one (field, year) are brought together before writing: a day has one row, so that is
    at most 366 rows, and each partition gets one file. With very many fields use `("year",)`:
    each year is then written as files sorted by field, whose statistics still prune by field.
    """
    rows = daily.withColumn("year", F.year("date"))
    if "field_id" in partition_by:
        rows = rows.repartition("field_id", "year")
    else:
        rows = rows.repartitionByRange("year", "field_id").sortWithinPartitions("year", "field_id")
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """All fields and years; filters on field_id and year prune directories."""
    schema = T.StructType([*DAILY_CLIMATE.fields, T.StructField("year", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIELDS).option("header", True).csv(path)


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_wide_csv(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """A table whose date columns are named by its header; all cells are text until used.

    `Unnamed` index columns are dropped; `year` is added as `Year`.
    """
    columns = _header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = drop_unnamed(spark.read.schema(schema).option("header", True).csv(path))
    return df.withColumn("Year", F.lit(year)) if year is not None else df


def year_of(path: str) -> int | None:
    """The last year that a path names, as a folder or within a name."""
    found = re.findall(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", path)
    return int(found[-1]) if found else None


def read_wide_years(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Wide tables of several years as one. Each has its own date columns, and its year as `Year`, from its path.

    A column that a year's table does not have is null in its rows.
    """
    tables = [read_wide_csv(spark, p, year_of(p)) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def append_predictions(df: DataFrame, path: str) -> None:
    """Add predictions to the JSON-lines log."""
    columns = [f.name for f in PREDICTION_LOG.fields]
    (
        df.select(*columns)
        .write.mode("append")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .json(path)
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The prediction log; times are ISO-8601 text with an offset."""
    as_text = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name == "ts" else f.dataType)
            for f in PREDICTION_LOG.fields
        ]
    )
    raw = spark.read.schema(as_text).json(path)
    return raw.withColumn("ts", F.try_to_timestamp("ts"))


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str, merge: bool = True) -> DataFrame:
    """Metric history; columns added by later writers are filled with null for earlier rows."""
    return spark.read.option("mergeSchema", merge).parquet(path)


def empty_metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RUN_METRICS)
