"""Tables that change by commits.

Data files never change. A commit writes new folders first and then one manifest, which appears under its final name or
not at all; readers follow the newest manifest. So a job that dies in between leaves the table as it was, and the
folders it wrote are never read. A manifest names, for every part of the table, the folders that hold it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Manifest:
    """A version of a table: folders by part, and the last batch that each stream has committed."""

    version: int = -1
    parts: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    sources: list[str] = field(default_factory=list)


class CommittedTable:
    """A table of parts: buckets of keys that a merge rewrites, or days that an append adds to.

    `part` gives the part of a row as text. One writer at a time is expected; a second one gets a Conflict.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, part: Column):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part.cast("string")
        self.schema = T.StructType([f for f in schema.fields if f.name != PART])
        self._jvm = spark.sparkContext._jvm
        self._log = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log")
        self._fs = self._log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions ------------------------------------------------------------------------

    def versions(self) -> list[int]:
        if not self._fs.exists(self._log):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if version is None:
            version = known[-1] if known else -1
        if version < 0:
            return Manifest()
        row = self.spark.read.text(f"{self.path}/_log/{version:012d}.json", wholetext=True).first()
        return Manifest(**json.loads(row.value))

    def _commit(self, new: Manifest) -> None:
        hadoop = self._jvm.org.apache.hadoop.fs
        name = f"{self.path}/_log/{new.version:012d}.json"
        draft = hadoop.Path(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        context = hadoop.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.NONE
        try:
            # fails if the name is taken
            context.rename(draft, hadoop.Path(name), options)
        except Exception as error:
            self._fs.delete(draft, False)
            if new.version in self.versions():
                raise Conflict(name) from error
            raise

    # --- reading -------------------------------------------------------------------------

    def read(self, parts: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless one is named, or of some of its parts only."""
        return self._rows(self.manifest(version), parts)

    def _rows(self, manifest: Manifest, parts: Sequence[str] | None = None) -> DataFrame:
        wanted = manifest.parts if parts is None else {p: manifest.parts.get(p, []) for p in parts}
        folders = sorted({f for own in wanted.values() for f in own})
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    # --- writing -------------------------------------------------------------------------

    def done(self, stream: str, batch_id: int) -> bool:
        return self.manifest().batches.get(stream, -1) >= batch_id

    def fresh(self, batch: DataFrame, source: str) -> DataFrame:
        """Rows of files that no commit has taken in yet; a stream that starts again from nothing adds nothing twice."""
        if not self.versions():
            return batch
        taken = self.spark.read.schema("sources array<string>, version int").json(f"{self.path}/_log")
        taken = taken.select(F.explode("sources").alias(source))
        return batch.join(taken, source, "left_anti")

    def _write(self, df: DataFrame) -> dict[str, list[str]]:
        """Write rows to a new folder and return its folders by part."""
        folder = f"data/{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows = df.select(*columns).withColumn(PART, self.part)
        # one part may be far larger than the others: AQE splits it over tasks
        rows.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        home = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        found = {}
        for status in self._fs.listStatus(home):
            name = status.getPath().getName()
            if name.startswith(f"{PART}="):
                part = name.removeprefix(f"{PART}=")
                found[part] = [f"{folder}/{name}"]
        return found

    def append(self, df: DataFrame, stream: str, batch_id: int, sources: Sequence[str] = ()) -> bool:
        """Add a batch; returns whether it was new. A batch that has been committed adds nothing."""
        before = self.manifest()
        if before.batches.get(stream, -1) >= batch_id:
            return False
        parts = {p: list(own) for p, own in before.parts.items()}
        for part, own in self._write(df).items():
            parts.setdefault(part, []).extend(own)
        self._commit(Manifest(before.version + 1, parts, before.batches | {stream: batch_id}, list(sources)))
        return True

    def merge(
        self, batch: DataFrame, stream: str, batch_id: int,
        merged: Callable[[DataFrame, DataFrame], DataFrame], sources: Sequence[str] = (),
    ) -> bool:
        """Replace the parts that the batch touches by `merged(rows of these parts, batch)`.

        Other parts keep their folders, so a commit costs what its parts hold, not what the table holds.
        """
        before = self.manifest()
        if before.batches.get(stream, -1) >= batch_id:
            return False
        # there are no more of them than parts
        touched = [r[0] for r in batch.select(self.part.alias(PART)).distinct().collect()]
        rows = merged(self._rows(before, touched), batch) if touched else None
        parts = {p: own for p, own in before.parts.items() if p not in touched}
        if rows is not None:
            parts |= self._write(rows)
        self._commit(Manifest(before.version + 1, parts, before.batches | {stream: batch_id}, list(sources)))
        return True


def bucket(keys: Sequence[str], buckets: int) -> Column:
    """The part of a row by a hash of its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))

