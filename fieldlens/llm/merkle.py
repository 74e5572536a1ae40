"""A Merkle manifest of a data set: a digest per row, a tree per group, and for each row the proof that it belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.llm.oracle import LOWER, UPPER
from fieldlens.llm.shared import documents, fold, ranked, stored

ARITY = 8
# nodes of one window; a multiple of ARITY, so that no run is cut
BLOCK = ARITY**3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, put together in UTF-8."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(**columns: Column) -> Column:
    """Digest of a row: each field as `-` if null, else its length in bytes, a colon and its value."""
    text = [c.cast("string") for c in columns.values()]
    return digest(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text])


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Add `left` and `right`, the digests of the other nodes of a node's run, put together in order.

    A run is ARITY consecutive nodes of a key, the last one fewer. Lag and lead columns at every offset within a run
    are masked by the node's slot and by the length of its run.
    """
    block = Window.partitionBy("key", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    slot = F.col("pos") % ARITY
    size = F.least(F.lit(ARITY), F.col("n") - (F.col("pos") - slot))
    before = [F.when(slot >= j, F.lag("digest", j).over(block)) for j in range(ARITY - 1, 0, -1)]
    after = [F.when(slot + j < size, F.lead("digest", j).over(block)) for j in range(1, ARITY)]
    return nodes.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *after)})


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: the first child of each run hashes its run; the only node of a key stays as it is."""
    first = with_siblings(nodes.select("key", "pos", "n", "digest")).filter(F.col("pos") % ARITY == 0)
    return first.select(
        "key",
        F.floor(F.col("pos") / ARITY).cast("long").alias("pos"),
        F.ceil(F.col("n") / ARITY).cast("long").alias("n"),
        F.when(F.col("n") == 1, F.col("digest")).otherwise(digest(F.col("digest"), F.col("right"))).alias("digest"),
    )


def levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels from the leaves (key, pos, n, digest) up to one node per key; each is written once."""
    found = [leaves]
    widest = leaves.agg(F.max("n")).first()[0] or 1
    while widest > 1:
        found.append(stored(parents(found[-1])))
        widest = -(-widest // ARITY)
    return found


def with_paths(found: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with `path`, the siblings of each level upwards, and all other columns of `tops`.

    `tops` has a row per key, with the path from the key's root upwards. A path is made from the top down, so that
    nodes share what lies above them.
    """
    above = tops.withColumn("_up", F.lit(0).cast("long"))
    for k in range(len(found) - 1, -1, -1):
        if k < len(found) - 1:
            nodes = with_siblings(found[k]).withColumn("_up", F.floor(F.col("pos") / ARITY).cast("long"))
        else:
            nodes = found[k].withColumns({"left": F.lit(""), "right": F.lit(""), "_up": F.col("pos")})
        step = F.array(F.struct("left", "right"))
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(step, F.col("path")))
        above = nodes.join(above, ["key", "_up"]).withColumn("path", path).drop("_up", "left", "right")
        if k:
            above = above.drop("digest", "n").withColumnRenamed("pos", "_up")
    return above


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf's digest gives with the siblings of its path."""
    return F.aggregate(path, start, lambda d, s: digest(s["left"], d, s["right"]))


def proof(path: str = "path") -> Column:
    """All siblings of a path, from the lowest level to the root, from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(rows: DataFrame) -> DataFrame:
    """Paths and roots of rows (lang, doc_id, leaf and any others but the names added here).

    Adds `path` (array of left and right siblings), `subroot` (the root of the language's tree), `root` (of all). Leaves
    ascend by doc_id, nulls first; rows that share an id are ordered by their digest, so the result does not depend on
    the order of the rows. Languages ascend by UTF-8 bytes, null first. An empty table gives no rows. Trees have one
    level for every factor of eight, so a row's path grows with the logarithm of the rows.
    """
    # nulls are a key of their own, before all others
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = ranked(rows.withColumn("key", key), ["doc_id", "leaf"]).withColumn("digest", F.col("leaf"))
    trees = levels(leaves)
    subroots = trees[-1].select(F.lit("").alias("key"), F.col("key").alias("tree"), "digest")
    above = levels(ranked(subroots, ["tree"]))
    root = above[-1].select("key", F.array().cast("array<struct<left:string,right:string>>").alias("path"),
                            F.col("digest").alias("root"))
    tops = with_paths(above, root).select(
        F.col("tree").alias("key"), F.col("digest").alias("subroot"), "root", "path"
    )
    return with_paths(trees, tops).drop("key", "pos", "n", "digest")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and roots of all documents, and which of them a tampered text gives away.

    Texts of documents whose id has a crc32 that 3 divides are tampered with: A-Z become small. A null id counts as
    empty text there; a null text stays null.
    """
    docs = documents(spark, sf_dir)
    own = {c: F.col(c) for c in FIELDS}
    spoilt = own | {"text": F.translate("text", UPPER, LOWER)}
    original = leaf(**own)
    rows = docs.select(
        "doc_id",
        "lang",
        original.alias("leaf"),
        F.when(fold(F.col("doc_id"), 3) == 0, leaf(**spoilt)).otherwise(original).alias("claimed"),
    )
    found = manifest(rows).withColumn("folded_root", folded(F.col("claimed")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(proof()).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
