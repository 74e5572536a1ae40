"""Substring deduplication: recurring passages found by their seeds, located everywhere by Aho-Corasick automata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import tokens
from fieldlens.llm.shared import broadcast_if_small, documents, stored
from fieldlens.session import cut_lineage

WINDOW = 50
SEED = 16
# phrases of one automaton, and texts that one task streams through it
SHARD_PHRASES = 20_000
SPLIT_TEXTS = 2_000

_AT = 24
_MASK = np.uint64((1 << _AT) - 1)
_SECOND = np.uint64(0x8EBC6AF09C88C6E3)


def seeds(words: tokens.Words, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of every text, the place of each window's seed, and the hash of the seed phrase at each place.

    The seed of a window is its phrase of `seed` words with the smallest hash, the leftmost of equals. It depends on
    the words of the window only, so a window that occurs twice has the same seed twice.
    """
    starts = words.full(window)
    phrase = tokens.windows(words.hash, seed)
    if not len(starts):
        return starts, starts, phrase
    n, w = len(phrase), window - seed + 1
    if n <= 1 << _AT:
        key = (phrase & ~_MASK) | np.arange(n, dtype=np.uint64)
        return starts, (tokens.sliding_minimum(key, w)[starts] & _MASK).astype(np.int64), phrase
    _, order = np.unique(phrase & ~_MASK, return_inverse=True)
    key = (order.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    return starts, (tokens.sliding_minimum(key, w)[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64), phrase


def seed_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(seed, doc_id) of every text's windows; equal neighbours share a row."""
    kind = dict(docs.dtypes)["doc_id"]

    def extract(batches):
        for batch in batches:
            for piece in tokens.pieces(batch):
                words = tokens.split(piece.column("text"))
                _, at, phrase = seeds(words, window, seed)
                at = np.unique(at)
                ids = piece.column("doc_id").take(pa.array(words.text_of[at]))
                yield pa.RecordBatch.from_arrays([pa.array(phrase[at].view(np.int64)), ids], ["seed", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(extract, f"seed long, doc_id {kind}")


def equal_texts(docs: DataFrame) -> DataFrame:
    """doc_id of every row whose whole text also stands in a smaller doc_id."""
    digests = cut_lineage(docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = first.filter("first < last").drop("last")
    return digests.join(first, "digest").filter("first < doc_id").select("doc_id", "digest").distinct()


def routes(found: DataFrame) -> DataFrame:
    """For each text that holds a recurring seed: the shards it is streamed through and the phrases it contributes.

    The phrases that come from one document are in one shard, so a copy is streamed through few. A shard that many
    texts need is split: its automaton is built once per split, and every text goes to one split.
    """
    recurring = found.groupBy("seed").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    recurring = cut_lineage(recurring.filter("owner < last").drop("last"))
    shards = max(1, -(-recurring.count() // SHARD_PHRASES))
    shard = lambda owner: F.pmod(F.xxhash64(owner), F.lit(shards)).cast("int")
    needs = found.join(recurring, "seed").select("doc_id", shard("owner").alias("shard")).distinct()
    needs = cut_lineage(needs)
    loads = needs.groupBy("shard").agg(F.ceil(F.count("*") / SPLIT_TEXTS).cast("int").alias("splits"))
    # a row per shard: the number of phrases divided by those of one automaton
    loads = broadcast_if_small(loads)
    needs = needs.join(loads, "shard").groupBy("doc_id").agg(F.collect_list(F.struct("shard", "splits")).alias("shards"))
    owned = recurring.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("seed").alias("owned"))
    owned = owned.withColumn("shard", shard("doc_id")).join(loads, "shard")
    owned = owned.select("doc_id", "owned", F.struct("shard", "splits").alias("own"))
    return needs.join(owned, "doc_id", "left")


def shard_rows(docs: DataFrame, routed: DataFrame, window: int, seed: int) -> DataFrame:
    """What each split of each shard reads: its phrases (kind 0), then its texts (kind 1)."""
    kind = dict(docs.dtypes)["doc_id"]
    weight = F.size("shards") + F.coalesce(F.size("owned"), F.lit(0))
    joined = docs.select("doc_id", "text_id", "text").join(broadcast_if_small(routed, weigh=weight), "doc_id")
    split = F.pmod(F.xxhash64("text_id"), F.col("to.splits")).cast("int")
    texts = joined.select("doc_id", "text_id", "text", F.explode("shards").alias("to"))
    texts = texts.select("to.shard", split.alias("split"), F.lit(1).alias("kind"), "doc_id", "text_id", "text")

    def phrases(batches):
        for batch in batches:
            for piece in tokens.pieces(batch):
                words = tokens.split(piece.column("text"))
                _, at, phrase = seeds(words, window, seed)
                at = np.unique(at)
                text = words.text_of[at]
                small = (words.hash & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows = {"shard": [], "splits": [], "phrase": []}
                edges = np.searchsorted(text, np.arange(piece.num_rows + 1))
                for i, row in enumerate(piece.select(["owned", "own"]).to_pylist()):
                    wanted = np.array(row["owned"], np.int64).view(np.uint64)
                    own = at[edges[i] : edges[i + 1]]
                    own = own[np.isin(phrase[own], wanted)]
                    _, once = np.unique(phrase[own], return_index=True)
                    for p in own[once].tolist():
                        rows["shard"].append(row["own"]["shard"])
                        rows["splits"].append(row["own"]["splits"])
                        rows["phrase"].append(small[p : p + seed].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["shard"], pa.int32()), pa.array(rows["splits"], pa.int32()),
                     pa.array(rows["phrase"], pa.binary())], ["shard", "splits", "phrase"]
                )

    owners = joined.filter("owned is not null").select("text", "owned", "own")
    found = owners.mapInArrow(phrases, "shard int, splits int, phrase binary")
    found = found.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    found = found.select(
        "shard", "split", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("doc_id"),
        F.lit(None).cast("long").alias("text_id"), F.lit(None).cast("string").alias("text"), "phrase",
    )
    return found.unionByName(texts.withColumn("phrase", F.lit(None).cast("binary")))


def locate(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """Every window whose seed is a recurring phrase: h and x (its hash), doc_id, text_id, pos and more (places).

    Each task reads the phrases of a split first, compiles their automaton, and streams the split's texts through it.
    """
    kind = dict(rows.dtypes)["doc_id"]

    def stream(batches):
        import ahocorasick

        current, automaton, ready = None, None, False
        for batch in batches:
            begin = 0
            place = batch.select(["shard", "split", "kind"]).to_pandas().to_numpy()
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for end in [*cuts.tolist(), batch.num_rows]:
                part, (shard, split, sort) = batch.slice(begin, end - begin), place[begin]
                begin = end
                if (shard, split) != current:
                    current, ready = (shard, split), False
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
                if sort == 0:
                    for phrase in part.column("phrase").to_pylist():
                        automaton.add_word(tuple(np.frombuffer(phrase, np.uint32).tolist()))
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                for piece in tokens.pieces(part):
                    yield from windows_of(piece, automaton)

    def windows_of(piece, automaton):
        words = tokens.split(piece.column("text"))
        small = tuple((words.hash & np.uint64(0xFFFFFFFF)).tolist())
        here = np.zeros(len(words) + 1, bool)
        if len(automaton):
            # a phrase that runs over the end of a text is the seed of no window
            ends = np.fromiter((end for end, _ in automaton.iter(small)), np.int64)
            here[ends - seed + 1] = True
        starts, at, _ = seeds(words, window, seed)
        starts = starts[here[at]]
        text = words.text_of[starts]
        h = tokens.windows(words.hash, window)[starts]
        x = tokens.windows(tokens.mix(words.hash ^ _SECOND), window)[starts] >> np.uint64(33)
        pos = (starts - words.first[text]).astype(np.int32)
        # a window that a text repeats is one row, with its later places in `more`
        key = tokens.mix(h ^ ((text + 1).astype(np.uint64) * _SECOND))
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        one = order[new]
        later = np.diff(np.append(np.flatnonzero(new), len(order))) - 1
        ends = np.concatenate([[0], np.cumsum(later)]).astype(np.int32)
        more = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[order[~new]]), mask=pa.array(later == 0))
        taken = pa.array(text[one])
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[one].view(np.int64)), pa.array(x[one].astype(np.int32)), piece.column("doc_id").take(taken),
             piece.column("text_id").take(taken), pa.array(pos[one]), more],
            ["h", "x", "doc_id", "text_id", "pos", "more"],
        )

    dealt = rows.repartition("shard", "split").sortWithinPartitions("shard", "split", "kind")
    return dealt.mapInArrow(stream, f"h long, x int, doc_id {kind}, text_id long, pos int, more array<int>")


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, text_id and positions of the windows of `docs` that also start in a smaller doc_id."""
    routed = routes(seed_rows(docs, window, seed))
    windows = stored(locate(shard_rows(docs, routed, window, seed), window, seed))
    first = windows.groupBy("h", "x").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = first.filter("first < last").drop("last")
    later = windows.join(first, ["h", "x"]).filter("first < doc_id")
    # positions within one text: its length bounds them
    places = F.concat(F.collect_set("pos"), F.flatten(F.collect_set("more")))
    return later.groupBy("doc_id", "text_id").agg(places.alias("positions"))


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Add n_words, n_removed and kept_text: words covered by a window that also starts in a smaller doc_id go.

    Windows are judged on the input. A text equal to that of a smaller doc_id is not searched: all its windows start
    there. Null and blank texts have no words; texts of fewer words than a window, and rows without an id, keep all.
    Rows that share an id are one document, each with its own text. Columns of these names are replaced; all others
    stay. Two different windows are taken for equal with a chance of about 2**-90.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text").withColumn("text_id", F.xxhash64("text"))
    named = docs.filter("doc_id is not null").select("doc_id", "text_id", "text")
    copies = equal_texts(named)
    copies = broadcast_if_small(copies)
    digest = F.md5(F.col("text").cast("binary"))
    own = named.withColumn("digest", digest).join(copies, ["doc_id", "digest"], "left_anti").drop("digest")
    found = repeated_windows(own, window, seed).withColumnsRenamed({"doc_id": "_doc", "text_id": "_text"})
    marked = docs.withColumn("_digest", digest).join(
        copies.select(F.col("doc_id").alias("_copy"), F.col("digest").alias("_copied")),
        (F.col("doc_id") == F.col("_copy")) & (F.col("_digest") == F.col("_copied")),
        "left",
    )
    marked = marked.join(
        found, (F.col("doc_id") == F.col("_doc")) & (F.col("text_id") == F.col("_text")), "left"
    ).withColumn("_whole", F.col("_copy").isNotNull())

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept_text:string>")
    def remove(texts: pa.Array, positions: pa.Array, whole: pa.Array) -> pa.Array:
        parts = []
        batch = pa.RecordBatch.from_arrays([texts, positions, whole], ["text", "positions", "whole"])
        for piece in tokens.pieces(batch):
            words = tokens.split(piece.column("text"))
            lists = piece.column("positions")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            at = flat + np.repeat(words.first[:-1], sizes)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            counts = words.counts
            copied = piece.column("whole").to_numpy(zero_copy_only=False) & (counts >= window)
            gone |= np.repeat(copied, counts)
            removed = np.bincount(words.text_of[gone], minlength=piece.num_rows)
            kept = tokens.joined(words, ~gone, tokens.raw(piece.column("text"))[1])
            parts.append(
                pa.StructArray.from_arrays(
                    [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), kept],
                    ["n_words", "n_removed", "kept_text"],
                )
            )
        return pa.concat_arrays(parts) if parts else pa.array([], shape)

    shape = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    out = marked.withColumn("_out", remove("text", "positions", "_whole"))
    return out.select(*[c for c in docs.columns if c != "text_id"], "_out.*")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    sha = F.sha2(F.encode("kept_text", "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_removed", sha.alias("kept_sha256"))
