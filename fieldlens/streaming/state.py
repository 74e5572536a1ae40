"""State tables for micro-batch streams: two alternating slots.

Batch n reads slot (n-1) % 2 and replaces slot n % 2. A batch that is repeated after a failure
finds its input slot untouched and simply writes its own slot again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SlotTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _slot(self, batch_id: int) -> str:
        return f"{self.path}/slot={batch_id % 2}"

    def _read(self, slot: str) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("_batch", T.LongType())])
        try:
            return self.spark.read.schema(stored).parquet(slot)
        except AnalysisException:
            return self.spark.createDataFrame([], stored)

    def before(self, batch_id: int) -> DataFrame:
        """State as the previous batch left it."""
        found = self._read(self._slot(batch_id - 1)).filter(F.col("_batch") < batch_id)
        return found.drop("_batch")

    def replace(self, batch_id: int, df: DataFrame) -> DataFrame:
        """Store the state after this batch and return it as stored."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        df.select(*columns, F.lit(batch_id).cast("long").alias("_batch")).write.mode(
            "overwrite"
        ).parquet(self._slot(batch_id))
        return self._read(self._slot(batch_id)).drop("_batch")

    def current(self) -> DataFrame:
        """State after the newest batch."""
        slots = self._read(f"{self.path}/slot=0").unionByName(self._read(f"{self.path}/slot=1"))
        newest = slots.agg(F.max("_batch")).scalar()
        return slots.filter(F.col("_batch") == newest).drop("_batch")
