"""Reversible line deduplication: sharded cuckoo filters over exact reference-count tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import tokens
from fieldlens.llm.shared import documents, shared_folder
from fieldlens.session import cut_lineage

MIN_KEY_CHARS = 10
# keys of a shard's first filter block; a shard is what one task holds at a time
SHARD_KEYS = 100_000
SLOTS = 4
LOAD = 0.85


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four slots; each key has two possible buckets.

    Holds one fingerprint per key inserted, so a key that was inserted can be deleted again. A key never inserted is
    found with a chance of about 8 / 2**16.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @property
    def room(self) -> int:
        return int(self.table.size * LOAD) - int(np.count_nonzero(self.table))

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (tokens.mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        halves = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        mark = (halves[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        bucket = (halves[:, 0] & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, bucket, self._other(bucket, mark)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        mark, one, two = self._places(keys)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def insert(self, keys: list[bytes], rounds: int = 1000) -> bool:
        """Insert all keys, or none and say so."""
        mark, bucket, _ = self._places(keys)
        table, rng = self.table.copy(), np.random.default_rng(len(keys))
        for tried in range(rounds):
            if not len(mark):
                break
            order = np.argsort(bucket, kind="stable")
            mark, bucket = mark[order], bucket[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            # the rank-th free slot of the bucket, if there is one
            free = np.cumsum(table[bucket] == 0, axis=1)
            fits = free[:, -1] > rank
            slot = (free[fits] == rank[fits, None] + 1).argmax(axis=1)
            table[bucket[fits], slot] = mark[fits]
            mark, bucket, rank = mark[~fits], bucket[~fits], rank[~fits]
            if tried and len(mark):
                # one newcomer of each full bucket takes the place of a fingerprint there
                _, head = np.unique(bucket, return_index=True)
                slot = rng.integers(0, SLOTS, len(head))
                out = table[bucket[head], slot].copy()
                table[bucket[head], slot] = mark[head]
                mark[head] = out
            bucket = self._other(bucket, mark)
        if len(mark):
            return False
        self.table = table
        return True

    def delete(self, keys: list[bytes]) -> None:
        """Delete keys that were inserted."""
        mark, one, two = self._places(keys)
        pending = np.arange(len(keys))
        while len(pending):
            # equal fingerprints of equal buckets are taken one at a time
            pair = np.minimum(one, two)[pending] * (1 << 16) + mark[pending]
            _, head = np.unique(pair, return_index=True)
            now = pending[head]
            for bucket in (one, two):
                hit = self.table[bucket[now]] == mark[now, None]
                found = hit.any(axis=1)
                self.table[bucket[now[found]], hit[found].argmax(axis=1)] = 0
                now = now[~found]
            if len(now):
                raise ValueError("a key to delete was never inserted")
            pending = np.delete(pending, head)


def line_keys(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """doc_id, text_id, pos and key of every line whose key has at least `min_chars` code points.

    A key is the line without ASCII white space at both ends and with A-Z lower-cased, as a digest of 16 bytes. Rows
    without an id have no lines here.
    """
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_id"), "text")

    def extract(batches):
        for batch in batches:
            for piece in tokens.pieces(batch):
                at, pos, keys = [], [], []
                for i, text in enumerate(piece.column("text")):
                    for p, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                        line = line.strip(b" \t\n\x0b\x0c\r")
                        if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode()) >= min_chars):
                            at.append(i)
                            pos.append(p)
                            # bytes.lower() changes A-Z only
                            keys.append(hashlib.blake2b(line.lower(), digest_size=16).digest())
                taken = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").take(taken),
                        piece.column("text_id").take(taken),
                        pa.array(pos, pa.int32()),
                        pa.array(keys, pa.binary()),
                    ],
                    ["doc_id", "text_id", "pos", "key"],
                )

    return texts.mapInArrow(extract, f"doc_id {kind}, text_id long, pos int, key binary")


@dataclass
class LineIndex:
    """Which documents hold which lines, kept as three tables that every change writes anew as a version.

    postings  key, doc_id: a row per document and key
    refs      key, n_docs, first_doc, block: the exact reference counts
    filters   shard, block, data: cuckoo filters of the keys in refs

    A key belongs to a shard by its hash. When documents come in, only keys that a filter may know are looked up in
    refs; the others are new for certain. When documents go, the counts of their keys fall, the smallest remaining
    document takes over, and a key that nobody holds any more leaves its filter. Insert and delete undo each other.
    """

    spark: SparkSession
    folder: str
    shards: int
    kind: str = "bigint"
    version: int = 0

    def table(self, name: str) -> DataFrame:
        if self.version:
            return self.spark.read.parquet(f"{self.folder}/v{self.version:05d}/{name}")
        schema = {
            "postings": f"key binary, doc_id {self.kind}",
            "refs": f"key binary, n_docs bigint, first_doc {self.kind}, block int",
            "filters": "shard int, block int, data binary",
        }[name]
        return self.spark.createDataFrame([], schema)

    def _write(self, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/v{self.version + 1:05d}/{name}")
        self.version += 1

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _per_shard(self, keys: DataFrame, function, schema: str) -> DataFrame:
        """`function(keys, filters)` on Arrow tables for every shard; keys are distinct, so shards are even."""
        keys = keys.withColumn("shard", self._shard())
        return keys.groupBy("shard").cogroup(self.table("filters").groupBy("shard")).applyInArrow(function, schema)

    def insert(self, lines: DataFrame) -> None:
        """Add the lines (doc_id, key) of documents that the index does not hold."""
        postings = cut_lineage(lines.select("key", "doc_id").distinct())
        counts = postings.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))

        def probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
            names = keys.column("key").to_pylist()
            known = np.zeros(len(names), bool)
            for data in filters.column("data").to_pylist() if names else []:
                known |= CuckooFilter(np.frombuffer(data, np.uint16).reshape(-1, SLOTS)).contains(names)
            return keys.select(["key", "n_docs", "first_doc"]).append_column("maybe", pa.array(known))

        shape = f"key binary, n_docs bigint, first_doc {self.kind}"
        counts = cut_lineage(self._per_shard(counts, probe, f"{shape}, maybe boolean"))
        refs = self.table("refs")
        maybe = counts.filter("maybe").drop("maybe")
        more = maybe.select("key", F.col("n_docs").alias("more"), F.col("first_doc").alias("other"))
        # a key that only seems known finds no row here and counts as new
        known = cut_lineage(refs.join(more, "key"))
        fresh = counts.filter("not maybe").drop("maybe").unionByName(maybe.join(known, "key", "left_anti"))

        def add(keys: pa.Table, filters: pa.Table) -> pa.Table:
            names = keys.column("key").to_pylist()
            rows = sorted(zip(filters.column("block").to_pylist(), filters.column("data").to_pylist(), strict=True))
            shard = (keys if names else filters).column("shard")[0].as_py()
            blocks = dict(rows)
            last = max(blocks, default=-1)
            if names:
                place = None
                if blocks:
                    open_block = CuckooFilter(np.frombuffer(blocks[last], np.uint16).reshape(-1, SLOTS).copy())
                    if open_block.room >= len(names) and open_block.insert(names):
                        place = open_block
                size = max(len(names), SHARD_KEYS // 8)
                while place is None:
                    place = CuckooFilter.for_keys(size)
                    if place.insert(names):
                        last += 1
                    else:
                        place, size = None, 2 * size
                blocks[last] = place.table.tobytes()
            out = [{"shard": shard, "block": b, "data": d} for b, d in blocks.items()]
            out += [{**row, "block": last} for row in keys.select(["key", "n_docs", "first_doc"]).to_pylist()]
            return pa.Table.from_pylist(out, schema=arrow)

        arrow = pa.schema(
            [("key", pa.binary()), ("n_docs", pa.int64()), ("first_doc", keys_type(counts)), ("shard", pa.int32()),
             ("block", pa.int32()), ("data", pa.binary())]
        )
        added = cut_lineage(self._per_shard(fresh, add, f"{shape}, shard int, block int, data binary"))
        grown = known.select(
            "key",
            (F.col("n_docs") + F.col("more")).alias("n_docs"),
            F.least("first_doc", "other").alias("first_doc"),
            "block",
        )
        same = refs.join(known.select("key"), "key", "left_anti")
        self._write(
            postings=self.table("postings").unionByName(postings),
            refs=same.unionByName(grown).unionByName(added.filter("key is not null").select(refs.columns)),
            filters=added.filter("data is not null").select("shard", "block", "data"),
        )

    def delete(self, ids: DataFrame) -> None:
        """Take out the documents whose doc_id is in `ids`; unknown ids change nothing."""
        ids = ids.select("doc_id").distinct()
        postings, refs = self.table("postings"), self.table("refs")
        touched = cut_lineage(postings.join(ids, "doc_id", "left_semi").select("key").distinct())
        left = postings.join(ids, "doc_id", "left_anti")
        counts = left.join(touched, "key", "left_semi").groupBy("key")
        counts = counts.agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
        changed = refs.join(touched, "key").select("key", "block").join(counts, "key", "left")
        changed = cut_lineage(changed)

        def remove(keys: pa.Table, filters: pa.Table) -> pa.Table:
            out = []
            of = np.array(keys.column("block").to_pylist(), dtype=np.int64)
            names = keys.column("key").to_pylist()
            for row in filters.to_pylist():
                block = CuckooFilter(np.frombuffer(row["data"], np.uint16).reshape(-1, SLOTS).copy())
                block.delete([names[i] for i in np.flatnonzero(of == row["block"])]) if (of == row["block"]).any() else None
                out.append({"shard": row["shard"], "block": row["block"], "data": block.table.tobytes()})
            return pa.Table.from_pylist(out, schema=arrow)

        arrow = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
        unheld = changed.filter("n_docs is null").select("key", "block")
        same = refs.join(touched, "key", "left_anti")
        self._write(
            postings=left,
            refs=same.unionByName(changed.filter("n_docs is not null").select(refs.columns)),
            filters=self._per_shard(unheld, remove, "shard int, block int, data binary"),
        )


def keys_type(counts: DataFrame) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(dict(counts.dtypes)["first_doc"], pa.int64())


def build_index(lines: DataFrame, folder: str, batches: int = 2) -> LineIndex:
    """An index of the lines, inserted in batches of documents drawn by a hash of their id."""
    spark = lines.sparkSession
    shards = max(1, -(-lines.count() // SHARD_KEYS))
    index = LineIndex(spark, folder, shards, dict(lines.dtypes)["doc_id"])
    for b in range(batches):
        index.insert(lines.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
    return index


def drop_lines(docs: DataFrame, lines: DataFrame, index: LineIndex) -> DataFrame:
    """Add n_lines, n_dropped and kept_text: a line that several documents hold stays in the smallest doc_id only.

    Lines whose key is shorter than the index takes stay, and so do all lines of a row without an id. A null text is
    one empty line. Rows that share an id are one document; each row keeps its own text. Columns of these names are
    replaced; all others stay.
    """
    repeated = index.table("refs").filter("n_docs > 1").select("key", "first_doc")
    gone = lines.join(repeated, "key").filter("doc_id != first_doc")
    # one document's positions: its length bounds them
    gone = gone.groupBy("doc_id", "text_id").agg(F.collect_set("pos").alias("_gone"))
    gone = gone.withColumnsRenamed({"doc_id": "_doc", "text_id": "_text"})
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    joined = docs.join(gone, (docs.doc_id == gone["_doc"]) & (F.xxhash64(docs.text) == gone["_text"]), "left")
    lines_of = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("_lines"), i)), "\n")
    return (
        joined.withColumn("_lines", lines_of)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dropped", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"))
        .withColumn("kept_text", F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept))
        .drop("_lines", "_gone", "_doc", "_text")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`drop_lines` over an index of the same documents."""
    lines = cut_lineage(line_keys(docs))
    return drop_lines(docs, lines, build_index(lines, shared_folder(docs.sparkSession)))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
