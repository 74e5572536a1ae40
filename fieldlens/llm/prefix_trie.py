"""The trie of conversation prefixes: which turns conversations share, and what keeping them once would save.

A conversation is a path of turn digests. Paths are dealt in ranges between splitter paths. A node that is no prefix of
a splitter has all its members in one shard, which finishes it in one pass over the sorted paths. The prefixes of the
splitters are the skeleton: every shard gives a partial result for those it has met, and these are added up.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fieldlens.llm.shared import broadcast_if_small, fold, ranked, shared_folder, stored

# hex digits of a turn's digest
STEP = 32
# paths of one shard; a shard holds the nodes below those open, a few times as much
SHARD_BYTES = 32 << 20
SAMPLED_A_SHARD = 64
# a splitter has so many turns at most: longer paths that agree in all of them are in one shard
SPLITTER_TURNS = 256
PIECE_IDS = 4096
BATCH_ROWS = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()

LOCAL, BELOW, PARTIAL, ENDS = range(4)


def conversations_of(turns: DataFrame) -> DataFrame:
    """A row per conv_id with its turns in order as (turn, digest, size).

    Null turn numbers come first; turns of one number are ordered by a digest of role and text. Null role or text is
    empty. Rows without a conv_id belong to no conversation. A conversation becomes one row of about 60 bytes a turn,
    its texts stay behind, which holds some ten million turns.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct("turn", F.substring(F.sha2(whole.cast("binary"), 256), 1, STEP).alias("digest"),
                    F.length(text).alias("size"))
    named = turns.select("conv_id", turn.alias("t")).filter("conv_id is not null")
    return named.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation with its first h turns taken from the conversation c - c % every; h is crc32(c) % heads.

    Where that conversation has fewer turns, all of them are taken, and none where there is none.
    """
    kept = stored(conversations)
    first = kept.filter(F.col("conv_id") % every == 0)
    first = first.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_head"))
    joined = kept.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every).join(first, "_base", "left")
    h = fold(F.col("conv_id"), heads)
    head = F.slice(F.coalesce(F.col("_head"), F.slice("turns", 1, 0)), F.lit(1), h)
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def splitters(paths: DataFrame, shards: int) -> list[tuple]:
    """At most shards - 1 places (path, conv_id) that cut the paths into ranges of about equal rows.

    They are quantiles of a sample drawn by a hash of the id. Only the splitters reach the driver.
    """
    rows = paths.count()
    share = min(1.0, shards * SAMPLED_A_SHARD / max(1, rows))
    place = F.pmod(F.xxhash64(F.lit(17), "conv_id"), F.lit(1 << 30)) / (1 << 30)
    width = SPLITTER_TURNS * STEP
    drawn = paths.filter(place < share).select(
        F.lit("").alias("key"),
        F.substring("path", 1, width).alias("path"),
        F.when(F.length("path") <= width, F.col("conv_id")).alias("conv_id"),
    )
    every = F.greatest(F.lit(1), F.floor(F.col("n") / shards))
    found = ranked(drawn, ["path", "conv_id"]).filter((F.col("pos") > 0) & (F.col("pos") % every == 0))
    cut = {(r["path"], float("-inf") if r["conv_id"] is None else r["conv_id"]) for r in found.collect()}
    return sorted(cut)


def common(a: str, b: str) -> int:
    """Turns at the start of both paths."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // STEP
    i = 0
    while a[i : i + STEP] == b[i : i + STEP]:
        i += STEP
    return i // STEP


class Node:
    """An open node: its first row in the shard, and sums over the children closed so far."""

    __slots__ = ("begun", "skeleton", "size", "first", "children", "leaves", "saved", "ids", "ended", "waiting")

    def __init__(self, begun, skeleton, size):
        self.begun, self.skeleton, self.size = begun, skeleton, size
        self.first, self.children, self.leaves, self.saved = None, 0, 0, 0
        self.ids, self.ended, self.waiting = [], None, []

    def meet(self, conv_id) -> None:
        if self.first is None or conv_id < self.first:
            self.first = conv_id


class Shard:
    """One pass over the sorted paths of a shard; `emit` takes the rows."""

    def __init__(self, number, cuts, emit):
        self.number, self.emit, self.rows, self.path = number, emit, 0, ""
        self.borders = [cuts[k][0] for k in (number - 1, number) if 0 <= k < len(cuts)]
        self.stack = [Node(0, True, 0)]

    def add(self, path, conv_id, sizes) -> None:
        shared = common(self.path, path)
        self.close(shared)
        if len(path) > shared * STEP:
            # nodes up to this depth are prefixes of a splitter
            bones = max((common(path, b) for b in self.borders), default=0)
            for d in range(shared, len(path) // STEP):
                self.stack.append(Node(self.rows, d < bones, sizes[d]))
        self.path = path
        self.rows += 1
        node = self.stack[-1]
        node.meet(conv_id)
        node.ids.append(str(conv_id))
        if len(node.ids) == PIECE_IDS:
            self.flush(node)

    def flush(self, node) -> None:
        """Take ids to the hash; those of skeleton nodes leave as pieces, in order."""
        if not node.ids:
            return
        text = ",".join(node.ids)
        if node.skeleton:
            node.ended = (node.ended or 0) + 1
            self.emit(kind=ENDS, key=self.path, shard=self.number, seq=node.ended, ends=text)
        elif node.ended is None:
            node.ended = hashlib.sha256(text.encode())
        else:
            node.ended.update(b"," + text.encode())
        node.ids = []

    def close(self, depth) -> None:
        """Close all nodes deeper than `depth`; -1 closes the root as well."""
        while len(self.stack) - 1 > depth:
            d = len(self.stack) - 1
            node = self.stack.pop()
            key = self.path[: d * STEP]
            self.path = key
            self.flush(node)
            parent = self.stack[-1] if d else None
            if parent:
                parent.meet(node.first)
            members = self.rows - node.begun
            row = {"depth": d, "conv_id": node.first, "n_convs": members}
            if node.skeleton:
                self.emit(
                    kind=PARTIAL, key=key, size=node.size, n_children=node.children, n_leaves=node.leaves,
                    saved_tokens=node.saved, **row,
                )
                continue
            node.saved += (members - 1) * node.size
            row |= {
                "n_children": node.children, "n_leaves": node.leaves or 1, "saved_tokens": node.saved,
                "ends": node.ended.hexdigest() if node.ended else NO_ENDS,
            }
            parent.children += 1
            parent.leaves += row["n_leaves"]
            parent.saved += node.saved
            for child in node.waiting:
                self.emit(kind=LOCAL, parent_conv_id=node.first, **child)
            if parent.skeleton:
                self.emit(kind=BELOW, key=key[:-STEP], **row)
            else:
                parent.waiting.append(row)


NUMBERS = "n_convs n_children n_leaves saved_tokens size shard seq".split()


def _finish(schema: pa.Schema, cuts):
    """Rows of all shards of a partition, which are sorted by shard, path and conv_id."""

    def run(batches):
        out, shard = [], None
        emit = lambda **row: out.append(row)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "sizes")]
            for number, path, conv_id, sizes in zip(*columns, strict=True):
                if shard is None or number != shard.number:
                    if shard:
                        shard.close(-1)
                    shard = Shard(number, cuts.value, emit)
                shard.add(path, conv_id, sizes)
                if len(out) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out.clear()
        if shard:
            shard.close(-1)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _hash_pieces(batches):
    """SHA-256 of the pieces of each key, joined by commas; they come in order, and one is held at a time."""
    key, held = None, None
    schema = pa.schema([("key", pa.string()), ("ends", pa.string())])
    for batch in batches:
        done = []
        for name, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if held is None or name != key:
                if held is not None:
                    done.append({"key": key, "ends": held.hexdigest()})
                key, held = name, hashlib.sha256(text.encode())
            else:
                held.update(b"," + text.encode())
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends": held.hexdigest()}], schema=schema)


def trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """A row per node of the trie of conversations (conv_id, turns as (turn, digest, size); one row per conv_id).

    Returns conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. A conversation without turns ends at the root; without conversations there is no node.
    Copies of one conversation may hold any share of the rows: they are dealt over shards by conv_id. Only the hash
    of the ids that end at one node is one task's work, over ids put together in pieces beforehand.
    """
    spark = conversations.sparkSession
    kind = dict(conversations.dtypes)["conv_id"]
    paths = stored(
        conversations.select(
            "conv_id",
            F.concat_ws("", F.transform("turns", lambda t: t["digest"])).alias("path"),
            F.transform("turns", lambda t: t["size"]).alias("sizes"),
        )
    )
    if shards is None:
        size = paths.agg(F.sum(F.length("path"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    # one splitter for each shard of 32 MB
    cuts = spark.sparkContext.broadcast(splitters(paths, shards))

    @F.arrow_udf("int")
    def shard_of(path: pa.Array, conv_id: pa.Array) -> pa.Array:
        places = zip(path.to_pylist(), conv_id.to_pylist(), strict=True)
        return pa.array([bisect_right(cuts.value, p) for p in places], pa.int32())

    dealt = paths.withColumn("shard", shard_of("path", "conv_id")).repartitionById(len(cuts.value) + 1, F.col("shard"))
    fields = f"kind int, key string, depth long, conv_id {kind}, parent_conv_id {kind}, ends string, "
    fields += ", ".join(f"{c} long" for c in NUMBERS)
    schema = to_arrow_schema(StructType.fromDDL(fields))
    found = dealt.sortWithinPartitions("shard", "path", "conv_id").mapInArrow(_finish(schema, cuts), fields)
    folder = shared_folder(spark)
    found.write.parquet(folder)
    found = spark.read.schema(fields).parquet(folder)
    bones = skeleton(found)
    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    named = found.withColumnRenamed("ends", "ends_sha256")
    parents = bones.select("key", F.col("conv_id").alias("_parent"))
    below = named.filter(F.col("kind") == BELOW).join(
        broadcast_if_small(parents, weigh=F.length("key") / 64), "key", "left"
    )
    below = below.withColumn("parent_conv_id", F.col("_parent"))
    return named.filter(F.col("kind") == LOCAL).select(own).union(below.select(own)).union(bones.select(own))


def skeleton(found: DataFrame) -> DataFrame:
    """Skeleton nodes with whole results from what the shards gave.

    There are no more of them than turns in all splitters. What a node adds of its own goes to all nodes above it.
    """
    partial = found.filter(F.col("kind") == PARTIAL).groupBy("key", "depth")
    nodes = stored(
        partial.agg(
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("size").alias("size"),
        )
    )
    up = F.expr(f"substring(key, 1, length(key) - {STEP})")
    more = nodes.filter("depth > 0").groupBy(up.alias("key")).agg(F.count("*").alias("_more"))
    nodes = nodes.join(more, "key", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce(F.col("_more"), F.lit(0))
    )
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    above = F.transform(F.sequence(F.lit(0), "depth"), lambda d: F.expr("key").substr(F.lit(1), (d * STEP).cast("int")))
    sums = nodes.select(
        F.explode(above).alias("key"),
        (F.col("n_leaves") + leaf).alias("_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).alias("_saved"),
    )
    sums = sums.groupBy("key").agg(F.sum("_leaves").alias("n_leaves"), F.sum("_saved").alias("saved_tokens"))
    pieces = found.filter(F.col("kind") == ENDS).select("key", "shard", "seq", "ends").repartition("key")
    pieces = pieces.sortWithinPartitions("key", "shard", "seq").select("key", "ends")
    ends = pieces.mapInArrow(_hash_pieces, "key string, ends string")
    parents = nodes.select(F.col("key").alias("_up"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.drop("n_leaves", "saved_tokens").join(sums, "key").join(ends, "key", "left")
    whole = whole.withColumn("_up", F.when(F.col("depth") > 0, up)).join(parents, "_up", "left")
    return stored(whole.withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie(rebuilt(conversations_of(turns)))
