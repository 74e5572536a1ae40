"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import tokens
from fieldlens.llm.shared import documents, fold
from fieldlens.session import cut_lineage

# features are hashed to 2**BITS coordinates: the bound of the model, of its broadcast and of what the driver adds up
BITS = 18
# about so many labelled rows are learned from, drawn by a hash of the id
TRAIN_ROWS = 20_000
SHARDS = 4
PIECE_BITS = 6
PIECES = 1 << PIECE_BITS
ROUNDS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 0.1

_KINDS = tuple(np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F))


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of every distinct feature of every text, ordered by text.

    Features are words, pairs of neighbours, and pairs with one word between. Words are runs of ASCII letters and
    digits and of signs beyond ASCII, A-Z lower-cased. A text without words has none.
    """
    words = tokens.split(column, lower=True, kept=tokens.ALPHANUMERIC)
    text, h = words.text_of, words.hash
    drop = np.uint64(64 - bits)
    found = [(text, tokens.mix(h ^ _KINDS[0]) >> drop)]
    for gap, kind in ((1, _KINDS[1]), (2, _KINDS[2])):
        same = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, bool)
        pair = h[:-gap][same] * np.uint64(0xD6E8FEB86659FD93) + h[gap:][same]
        found.append((text[gap:][same], tokens.mix(pair ^ kind) >> drop))
    key = np.concatenate([(t.astype(np.uint64) << np.uint64(bits)) | c for t, c in found])
    key = np.unique(key)
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal. A feature that is present has the value 1; `bias` is fixed beforehand."""

    def __init__(self, bits: int = BITS, bias: float = 0.0, z=None, n=None):
        self.z = np.zeros(1 << bits) if z is None else z
        self.n = np.zeros(1 << bits) if n is None else n
        self.bias = bias

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(self.bias + w.sum()) - label
        n = self.n[at]
        after = n + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(n)) / ALPHA * w
        self.n[at] = after


STATE = "shard int, piece int, z binary, n binary"


def _state(shard: int, model: Ftrl) -> pa.RecordBatch:
    """The state of a shard in pieces; those that nothing has touched are left out."""
    n = model.n.reshape(PIECES, -1)
    touched = np.flatnonzero(n.any(axis=1))
    columns = [pa.array(np.full(len(touched), shard), pa.int32()), pa.array(touched, pa.int32())]
    for x in (model.z.reshape(PIECES, -1), n):
        columns.append(pa.array([x[i].tobytes() for i in touched], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["shard", "piece", "z", "n"])


def averaged(states: DataFrame, shards: int) -> DataFrame:
    """The mean of a piece over all shards, made in tasks; a group has a row per shard."""

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        sums = [sum(map(np.frombuffer, group.column(c).to_pylist())) / shards for c in ("z", "n")]
        columns = [group.column("piece").slice(0, 1), *[pa.array([x.tobytes()], pa.binary()) for x in sums]]
        return pa.table(columns, names=["piece", "z", "n"])

    return states.groupBy("piece").applyInArrow(mean, "piece int, z binary, n binary")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, bits: int = BITS) -> DataFrame:
    """doc_id, label and features of about `limit` labelled documents; all of them if there are fewer.

    The draw goes by a hash of the id. A document labelled more than once counts as toxic if any label says so; rows
    without an id or a label are left out.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
    known = known.agg(F.max("toxic").cast("int").alias("label"))
    share = min(1.0, limit / max(1, known.count()))
    place = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    # at most about `limit` rows of two numbers
    drawn = F.broadcast(known.filter(place < share))
    texts = docs.select("doc_id", "text").join(drawn, "doc_id").select("doc_id", "label", "text")

    def extract(batches):
        for batch in batches:
            for piece in tokens.pieces(batch):
                text, at = features(piece.column("text"), bits)
                first = pa.array(np.searchsorted(text, np.arange(piece.num_rows + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(first, pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("label"), lists], ["doc_id", "label", "features"]
                )

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(extract, f"doc_id {kind}, label int, features array<int>")


def train(rows: DataFrame, bits: int = BITS, shards: int = SHARDS, rounds: int = ROUNDS) -> dict:
    """Bias and the weights that are not 0, as {"bias", "at", "weight"}.

    In each round every shard learns its rows in order from the state all shards share, and the states are averaged.
    The bias is the log odds of the labels. Without rows, or with labels of one kind only, all weights are 0 and the
    bias is the smoothed log odds.
    """
    shard = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(shards)).cast("int")
    # one shard to a task
    rows = rows.withColumn("shard", shard).repartitionById(shards, F.col("shard"))
    rows = cut_lineage(rows.sortWithinPartitions("shard", "doc_id"))
    total, toxic, held = rows.agg(
        F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), F.count_distinct("shard")
    ).first()
    bias = math.log((toxic + 0.5) / (total - toxic + 0.5))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for _ in range(rounds if 0 < toxic < total else 0):
        shared = rows.sparkSession.sparkContext.broadcast((z, n))

        def learn(batches, shared=shared):
            model, shard = None, None
            for batch in batches:
                flat, first = batch.column("features").flatten().to_numpy(), batch.column("features").offsets.to_numpy()
                first = first - first[0]
                places = zip(batch.column("shard").to_pylist(), batch.column("label").to_pylist(), strict=True)
                for i, (own, label) in enumerate(places):
                    if own != shard:
                        if model is not None:
                            yield _state(shard, model)
                        shard, model = own, Ftrl(bits, bias, *(x.copy() for x in shared.value))
                    model.learn(flat[first[i] : first[i + 1]], label)
            if model is not None:
                yield _state(shard, model)

        # at most 2 * 2**bits numbers, however many documents and shards there are
        for r in averaged(rows.mapInArrow(learn, STATE), held).collect():
            own = slice(r["piece"] << bits >> PIECE_BITS, r["piece"] + 1 << bits >> PIECE_BITS)
            z[own], n[own] = np.frombuffer(r["z"]), np.frombuffer(r["n"])
        shared.destroy()
    tokens.give_back()
    w = Ftrl(bits, bias, z, n).weights()
    at = np.flatnonzero(w)
    return {"bias": bias, "at": at, "weight": w[at], "bits": bits}


def with_scores(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Add `score`, the probability that a text is toxic, read from nothing but the text.

    A text without words, or null, scores what the bias says. A column named score is replaced; all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        weight = np.zeros(1 << model["bits"])
        weight[model["at"]] = model["weight"]
        for column in texts:
            parts = [pa.array([], pa.float64())]
            for piece in tokens.pieces(pa.RecordBatch.from_arrays([column], ["text"])):
                text, at = features(piece.column("text"), model["bits"])
                total = np.bincount(text, weight[at], piece.num_rows)
                parts.append(pa.array(sigmoid(model["bias"] + total), pa.float64()))
            yield pa.concat_arrays(parts)

    return docs.withColumn("score", score(F.col(text)))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> dict:
    """Learn from labelled rows of the folds other than 0."""
    return train(training_rows(docs, labels.filter(fold(F.col("doc_id")) != 0), limit))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_scores(docs, model).withColumn("held_out", fold(F.col("doc_id")) == 0)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
