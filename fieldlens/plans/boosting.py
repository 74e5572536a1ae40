"""Boosted trees for the mean and for quantiles, grown from histograms.

Features are binned once. A job finds two levels of a tree: every partition adds up gradients and counts per node and
pair of bins of two features, which hold the sums of both children whatever the split of the node is. Where these would
be large, a job finds one level from sums per node, feature and bin. Only the sums, whose size does not depend on the
rows, reach the driver. Several losses grow their trees in the same jobs. The result is a model of Spark ML, so scoring
stays in the plan.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.session import cut_lineage, ensure_checkpoint_dir

BLOCK_ROWS = 100_000
# cells of the residuals of a leaf, finest around 0
CELLS = 2048
FINEST = 1e-5
# more partitions are added up by tasks before the driver
DIRECT = 64
CHECKPOINT_TREES = 25
# a job finds two levels while a partition's sums stay below this, and while the longer work on its rows stays below what
# a job of its own costs, in rows times tables
AHEAD_BYTES = 4 << 20
AHEAD_ROWS = 8_000_000
TIE = 1e-9
# blocks are written again after the fewer trees the more rows a task has
ROUNDS_ROWS = 2_700_000
# a count of rows and a count of some of them in one number
SECOND = 1 << 26


@dataclass(frozen=True)
class Settings:
    max_depth: int = 6
    learning_rate: float = 0.1
    n_estimators: int = 300
    subsample: float = 0.8
    colsample: float = 0.8
    min_child: int = 5
    seed: int = 42
    bins: int = 64
    penalty: float = 1.0


class Tree(NamedTuple):
    """A tree in heap order: children of i are 2i+1 and 2i+2; `feature` is -1 in leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n))

    def bare(self) -> Tree:
        """What places rows, for tasks."""
        return self._replace(feature=self.feature.astype(np.int16), cut=self.cut.astype(np.int16), gain=None, rows=None)

    @property
    def depth(self) -> int:
        return len(self.feature).bit_length() - 1

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """For every column of `bins` the node it reaches within so many levels."""
        size = len(self.feature)
        node = np.zeros(bins.shape[1], np.uint8 if size <= 256 else np.uint16)
        own = np.arange(size)
        for level in range(levels):
            first, last = 2**level - 1, 2 ** (level + 1) - 1
            used = np.unique(self.feature[first:last])
            right = np.zeros(len(node), bool)
            for f in used[used >= 0]:
                # bins are below the largest byte, so no row of another node goes right
                right |= bins[f] > _look_up(np.where(self.feature == f, self.cut, 255).astype(np.uint8), node)
            inner = (self.feature >= 0) & (own >= first) & (own < last)
            node = _look_up(np.where(inner, 2 * own + 1, own).astype(node.dtype), node) + right
        return node


def _look_up(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """`table[places]`; bytes by bytes are translated, which is several times faster."""
    if table.dtype == places.dtype == np.uint8:
        return np.frombuffer(places.tobytes().translate(table.tobytes().ljust(256, b"\0")), np.uint8)
    return table.take(places)


class Block(NamedTuple):
    """Rows of a partition: bins (features x rows), and what each loss has left to explain.

    `keys` has the source and the number of rows of every piece that was joined; `last` is the partition's last block.
    """

    keys: tuple
    last: bool
    bins: np.ndarray
    left: np.ndarray

    def drawn(self, seed: int, tree: int, share: float) -> np.ndarray:
        """Whether a tree learns from each row; a lost block draws the same again."""
        if share >= 1:
            return np.ones(self.left.shape[1], bool)
        return np.concatenate([np.random.default_rng([seed, tree, *key]).random(n) < share for *key, n in self.keys])

    def after(self, rounds: Sequence[list[Tree]]) -> Block:
        """With the predictions of so many trees of each loss taken off."""
        left = self.left
        for trees in rounds:
            left = left - np.stack([tree.value.take(tree.place(self.bins, tree.depth)) for tree in trees])
        return self._replace(left=left)


def _add(a: list, b: list) -> list:
    # counts are sent in as few bytes as they need and added up in 64 bits
    return [np.add(x, z, dtype=float if x.dtype.kind == "f" else np.int64) for x, z in zip(a, b, strict=True)]


def _total(blocks: RDD, of_block) -> list:
    """The sum over all blocks of a list of arrays; each partition sends one.

    It is sent at the last block, before the end of the input is asked for: Spark writes that as a few bytes of their own,
    which the kernel holds back for some 40 ms until something comes the other way.
    """

    def run(part):
        total = None
        for block in part:
            found = of_block(block)
            total = found if total is None else _add(total, found)
            if block.last:
                yield [x if x.dtype.kind == "f" else x.astype(np.min_scalar_type(x.max(initial=0))) for x in total]

    parts = blocks.mapPartitions(run)
    return reduce(_add, parts.collect()) if parts.getNumPartitions() <= DIRECT else parts.treeReduce(_add)


def _cell(residual: np.ndarray, width: float) -> np.ndarray:
    """Cells of equal width on the inverse hyperbolic sine of the residuals."""
    scale = width * FINEST
    top = np.arcsinh(1 / FINEST)
    place = (np.arcsinh(residual / scale) / top + 1) / 2 * CELLS
    return np.clip(place.astype(np.int64), 0, CELLS - 1)


def _residual(place: np.ndarray, width: float) -> np.ndarray:
    return np.sinh((place / CELLS * 2 - 1) * np.arcsinh(1 / FINEST)) * width * FINEST


def _quantile(counts: np.ndarray, quantile: float, width: float) -> np.ndarray:
    """Per row of `counts` (leaf x cell) the quantile, interpolated within its cell; 0 for an empty leaf."""
    sums = counts.cumsum(axis=1)
    rank = quantile * sums[:, -1:]
    at = np.minimum((sums < rank).sum(axis=1), CELLS - 1)
    leaf = np.arange(len(counts))
    inside = (rank[:, 0] - (sums[leaf, at] - counts[leaf, at])) / np.maximum(counts[leaf, at], 1)
    return np.where(sums[:, -1] > 0, _residual(at + np.clip(inside, 0, 1), width), 0.0)


def _edges(rows: DataFrame, n: int, bins: int) -> list[np.ndarray]:
    """Borders between the bins of every feature: approximate quantiles, equal ones once."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = rows.agg(
        *[F.percentile_approx(F.nanvl(F.get("x", F.lit(j)), F.lit(None)), shares, F.lit(20 * bins)) for j in range(n)]
    ).first()
    return [np.unique(np.array(e or [], float)) for e in found]


def _blocks(rows: DataFrame, edges: list[np.ndarray], starts: list[float]) -> RDD:
    def bin_rows(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                x = piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, len(edges))
                bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]).astype(np.uint8)
                y = piece.column("y").to_numpy()
                columns = ([part], [number], [bins.tobytes()], [y.tobytes()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                    ["part", "number", "bins", "y"],
                )
                number += 1

    kept = cut_lineage(rows.mapInArrow(bin_rows, "part int, number int, bins binary, y binary"))
    # as many tasks as run side by side, with about as many rows each
    n_parts = min(rows.sparkSession.sparkContext.defaultParallelism, kept.count())
    start = np.array(starts)[:, None]

    def joined(records, last) -> Block:
        ys = [np.frombuffer(r.y) for r in records]
        bins = [np.frombuffer(r.bins, np.uint8).reshape(len(edges), len(y)) for r, y in zip(records, ys, strict=True)]
        keys = tuple((r.part, r.number, len(y)) for r, y in zip(records, ys, strict=True))
        return Block(keys, last, np.concatenate(bins, axis=1), np.concatenate(ys) - start)

    def join(records) -> Iterator[Block]:
        some, n = [], 0
        for r in records:
            size = len(r.y) // 8
            if some and n + size > BLOCK_ROWS:
                yield joined(some, False)
                some, n = [], 0
            some.append(r)
            n += size
        if some:
            yield joined(some, True)

    return kept.repartition(n_parts).rdd.mapPartitions(join)


class Cells(NamedTuple):
    """Tables of sums by the bins of one or two features each, side by side."""

    tables: list[tuple[int, ...]]
    n_bins: np.ndarray

    @classmethod
    def of(cls, chosen: Sequence[int], n_bins: np.ndarray, ahead: bool) -> Cells:
        return cls(list(combinations(chosen, 2)) if ahead and len(chosen) > 1 else [(f,) for f in chosen], n_bins)

    @property
    def sizes(self) -> list[int]:
        return [int(np.prod([self.n_bins[f] for f in t])) for t in self.tables]

    def codes(self, bins: np.ndarray) -> list[np.ndarray]:
        """For every table the place of each row."""
        wide = bins.astype(np.uint16)
        return [wide[t[0]] if len(t) == 1 else wide[t[0]] * np.uint16(self.n_bins[t[1]]) + wide[t[1]] for t in self.tables]

    def each(self, sums: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        """The tables of (node x cell) sums, with an axis for each feature."""
        ends = np.cumsum(self.sizes)
        for t, size, end in zip(self.tables, self.sizes, ends, strict=True):
            yield t, sums[:, end - size : end].reshape(len(sums), *[self.n_bins[f] for f in t])

    def by_feature(self, sums: np.ndarray, chosen: Sequence[int], bins: int) -> np.ndarray:
        """(node x feature x bin) sums."""
        out = np.zeros((len(sums), len(chosen), bins), sums.dtype)
        place, found = {f: j for j, f in enumerate(chosen)}, set()
        for t, table in self.each(sums):
            for axis, f in enumerate(t):
                if f not in found:
                    found.add(f)
                    out[:, place[f], : self.n_bins[f]] = table if len(t) == 1 else table.sum(axis=2 - axis)
        return out

    def children(
        self, sums: np.ndarray, whole: np.ndarray, chosen: Sequence[int], feature: np.ndarray, cut: np.ndarray
    ) -> np.ndarray:
        """(side x node x feature x bin) sums left and right of each node's cut; `whole` has those of the nodes."""
        out = np.zeros((2, *whole.shape), sums.dtype)
        place = {f: j for j, f in enumerate(chosen)}
        node = np.arange(len(sums))
        of, goes_left = chosen[feature], np.arange(whole.shape[2]) <= cut[:, None]
        own = whole[node, feature]
        out[0, node, feature], out[1, node, feature] = np.where(goes_left, own, 0), np.where(goes_left, 0, own)
        for t, table in self.each(sums):
            for axis, f in enumerate(t if len(t) == 2 else ()):
                other = t[1 - axis]
                some = np.flatnonzero(of == f)
                by = np.moveaxis(table[some], 1 + axis, 1)
                for side in (0, 1):
                    mine = goes_left[some, : self.n_bins[f]] == (side == 0)
                    out[side, some, place[other], : self.n_bins[other]] = (by * mine[:, :, None]).sum(axis=1)
        return out


def _split(sums: np.ndarray, counts: np.ndarray, s: Settings) -> tuple:
    """Per node of (node x feature x bin) sums: best feature, cut, gain, and sums and counts left of it and in all."""
    left, n_left = sums.cumsum(axis=2), counts.cumsum(axis=2)
    whole, n = left[:, :1, -1:], n_left[:, :1, -1:]
    right, n_right = whole - left, n - n_left
    gain = left**2 / (n_left + s.penalty) + right**2 / (n_right + s.penalty) - whole**2 / (n + s.penalty)
    gain = np.where((n_left >= s.min_child) & (n_right >= s.min_child), gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    # of gains that differ by rounding only the first: features may split rows alike
    most = flat.max(axis=1, keepdims=True)
    best = (flat >= most - TIE * np.abs(most)).argmax(axis=1)
    feature, cut = np.divmod(best, sums.shape[2])
    node = np.arange(len(gain))
    return feature, cut, flat[node, best], left[node, feature, cut], n_left[node, feature, cut], whole[:, 0, 0], n[:, 0, 0]


def fit(
    rows: DataFrame, quantiles: Sequence[float | None], s: Settings = Settings()
) -> list[GBTRegressionModel]:
    """A model for every loss: None is the squared error, a number the pinball loss of that quantile.

    `rows` has `x` (array of numbers, one per feature, NaN above all) and `y`. Leaf values of quantile trees are the
    quantile of the residuals in the leaf, from counts per cell.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    rows = cut_lineage(rows.select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")))
    n, mean, low, high, width = rows.agg(
        F.count("y"), F.avg("y"), F.min("y"), F.max("y"), F.max(F.size("x"))
    ).first()
    if not n:
        raise ValueError("there are no rows to learn from")
    known = [q for q in quantiles if q is not None]
    first = rows.agg(F.percentile_approx("y", F.array(*map(F.lit, known)), F.lit(10_000))).first()[0] if known else []
    starts = [mean if q is None else first[known.index(q)] for q in quantiles]
    span = max(2.0 * (high - low), 1e-9)
    edges = _edges(rows, width, s.bins)
    blocks, older = _blocks(rows, edges, starts).persist(StorageLevel.MEMORY_AND_DISK), None
    rng = np.random.default_rng(s.seed)
    n_drawn = max(1, round(s.colsample * width))
    n_bins = np.array([len(e) + 1 for e in edges])
    forests = [[] for _ in quantiles]
    # every job applies the trees of the rounds since the blocks were written
    rounds, written = [], 0
    n_rounds = np.clip(round(math.sqrt(ROUNDS_ROWS * blocks.getNumPartitions() / (n * len(quantiles)))), 1, CHECKPOINT_TREES)
    for t in range(s.n_estimators):
        chosen = np.sort(rng.permutation(width)[:n_drawn])
        # a feature of one bin splits nothing
        chosen = chosen[n_bins[chosen] > 1] if (n_bins[chosen] > 1).any() else chosen[:1]
        trees = _grow(blocks, rounds, quantiles, s, t, chosen, n_bins, n)
        _quantile_leaves(blocks, rounds, quantiles, trees, s, span)
        if older is not None:
            # the jobs of this tree made the copy
            older.unpersist()
            older = None
        for forest, tree in zip(forests, trees, strict=True):
            forest.append(tree)
        rounds = [*rounds, [tree.bare() for tree in trees]]
        if len(rounds) >= n_rounds and t + 1 < s.n_estimators:

            def after(block, rounds=rounds):
                return block.after(rounds)

            older, blocks = blocks, blocks.map(after).persist(StorageLevel.MEMORY_AND_DISK)
            rounds = []
            if t + 1 - written >= CHECKPOINT_TREES:
                blocks.checkpoint()
                written = t + 1
    blocks.unpersist()
    return [
        _model(spark, forest, edges, start) for forest, start in zip(forests, starts, strict=True)
    ]


def _sums(
    block: Block, drawn: np.ndarray, cells: Cells, quantiles, trees: list[Tree], open_nodes: list[np.ndarray], level: int
) -> list:
    """For each loss the sums of the rows drawn, and their counts, by open node and cell.

    The squared error adds up gradients. A quantile counts rows at or below the prediction, which tells the gradients.
    """
    codes = cells.codes(block.bins)
    out = []
    for k, (tree, nodes) in enumerate(zip(trees, open_nodes, strict=True)):
        # rows in no open node and rows not drawn go to one slot more
        n = len(nodes)
        slot = np.full(len(tree.feature), n, np.uint8 if n < 256 else np.uint16)
        slot[nodes] = np.arange(n)
        own = np.where(drawn, _look_up(slot, tree.place(block.bins, level)), slot.dtype.type(n)).astype(np.int64)
        both = quantiles[k] is not None
        weight = 1.0 + SECOND * (block.left[k] <= 0) if both else -block.left[k]
        sums, counts = [], []
        for code, size in zip(codes, cells.sizes, strict=True):
            at = own * size
            at += code
            found = np.bincount(at, weight, (n + 1) * size)[: n * size].reshape(n, size)
            sums.append(found)
            if not both:
                counts.append(np.bincount(at, minlength=(n + 1) * size)[: n * size].reshape(n, size))
        found = np.concatenate(sums, axis=1)
        out += np.divmod(found.astype(np.int64), SECOND) if both else (found, np.concatenate(counts, axis=1))
    return out


def _grow(
    blocks: RDD, rounds, quantiles, s: Settings, t: int, chosen: np.ndarray, n_bins: np.ndarray, n: int
) -> list[Tree]:
    """One tree per loss, one or two levels with each job. Leaves of the squared error have their values."""
    trees = [Tree.empty(s.max_depth) for _ in quantiles]
    open_nodes = [np.array([0]) for _ in quantiles]
    level = 0
    while level < s.max_depth and any(map(len, open_nodes)):
        one, cells = (Cells.of(chosen, n_bins, ahead) for ahead in (False, True))
        size = sum(len(nodes) * (12 if q is None else 8) for nodes, q in zip(open_nodes, quantiles, strict=True))
        longer = n / blocks.getNumPartitions() * (len(cells.tables) - len(one.tables))
        ahead = level + 1 < s.max_depth and size * sum(cells.sizes) <= AHEAD_BYTES and longer <= AHEAD_ROWS
        cells = cells if ahead else one

        def sums(block, trees=[tree.bare() for tree in trees], open_nodes=open_nodes, level=level, cells=cells):
            drawn = block.drawn(s.seed, t, s.subsample)
            return _sums(block.after(rounds), drawn, cells, quantiles, trees, open_nodes, level)

        found = _total(blocks, sums)
        for k, (tree, nodes) in enumerate(zip(trees, open_nodes, strict=True)):
            if not len(nodes):
                continue
            g, c = found[2 * k : 2 * k + 2]
            if quantiles[k] is not None:
                g = g - quantiles[k] * c
            by_g, by_c = (cells.by_feature(x, chosen, s.bins) for x in (g, c))
            inner, feature, cut = _open(tree, nodes, by_g, by_c, s, chosen)
            below = np.concatenate([2 * nodes[inner] + 1, 2 * nodes[inner] + 2])
            if ahead and len(below):
                by_g, by_c = (
                    cells.children(x[inner], by[inner], chosen, feature, cut).reshape(-1, *by.shape[1:])
                    for x, by in ((g, by_g), (c, by_c))
                )
                inner, *_ = _open(tree, below, by_g, by_c, s, chosen)
                below = np.concatenate([2 * below[inner] + 1, 2 * below[inner] + 2])
            open_nodes[k] = below
        level += 1 + ahead
    return trees


def _open(tree: Tree, nodes: np.ndarray, g: np.ndarray, c: np.ndarray, s: Settings, chosen: np.ndarray) -> tuple:
    """Split nodes by their (node x feature x bin) sums; those that were, and the place in `chosen` and the cut of each."""
    feature, cut, gain, left, n_left, whole, n = _split(g, c, s)
    tree.rows[nodes] = n
    tree.value[nodes] = -s.learning_rate * whole / (n + s.penalty)
    inner = np.flatnonzero(gain > 0)
    split = nodes[inner]
    tree.feature[split], tree.cut[split] = chosen[feature[inner]], cut[inner]
    tree.gain[split] = gain[inner]
    for child, g_, n_ in zip((2 * split + 1, 2 * split + 2), (left, whole - left), (n_left, n - n_left), strict=True):
        tree.rows[child] = n_[inner]
        tree.value[child] = -s.learning_rate * g_[inner] / (n_[inner] + s.penalty)
    return inner, feature[inner], cut[inner]


def _quantile_leaves(blocks: RDD, rounds, quantiles, trees: list[Tree], s: Settings, span: float) -> None:
    """Put the quantile of the residuals into the leaves of quantile trees, from one job for all."""
    kept = [k for k, q in enumerate(quantiles) if q is not None]
    if not kept:
        return
    places = np.arange(len(trees[0].feature))
    # the root of a tree that drew no row is a leaf as well
    leaves = [np.flatnonzero((trees[k].feature < 0) & ((trees[k].rows > 0) | (places == 0))) for k in kept]

    def counts(block):
        block, out = block.after(rounds), []
        for k, own in zip(kept, leaves, strict=True):
            slot = np.zeros(len(trees[k].feature), np.int64)
            slot[own] = np.arange(len(own))
            at = slot.take(trees[k].place(block.bins, s.max_depth)) * CELLS + _cell(block.left[k], span)
            out.append(np.bincount(at, minlength=len(own) * CELLS).reshape(len(own), CELLS))
        return out

    for k, own, found in zip(kept, leaves, _total(blocks, counts), strict=True):
        trees[k].value[own] = s.learning_rate * _quantile(found, quantiles[k], span)


NODES = """treeID int, nodeData struct<id:int, prediction:double, impurity:double, impurityStats:array<double>,
  rawCount:bigint, gain:double, leftChild:int, rightChild:int,
  split:struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, numCategories:int>>"""


def _model(spark: SparkSession, forest: list[Tree], edges: list[np.ndarray], start: float) -> GBTRegressionModel:
    """The trees as a model of Spark ML, through the files in which Spark keeps one."""
    rows = []
    for number, tree in enumerate(forest or [Tree.empty(0)]):
        # nodes are numbered from the root, left before right
        order, todo = [], [0]
        while todo:
            node = todo.pop()
            order.append(node)
            if tree.feature[node] >= 0:
                todo += [2 * node + 2, 2 * node + 1]
        place = {node: k for k, node in enumerate(order)}
        for k, node in enumerate(order):
            f, n = int(tree.feature[node]), float(tree.rows[node])
            value = float(tree.value[node]) + (start if not number else 0.0)
            if f < 0:
                links, split = (-1.0, -1, -1), (-1, [], -1)
            else:
                borders = edges[f]
                split = (f, [float(borders[tree.cut[node]])], -1)
                links = (float(tree.gain[node]) / max(n, 1.0), place[2 * node + 1], place[2 * node + 2])
            rows.append((number, (k, value, 0.0, [n, n * value, n * value * value], int(n), *links, split)))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    n_trees = max(1, len(forest))

    def about(cls: str, **more) -> str:
        return json.dumps(
            {"class": f"org.apache.spark.ml.regression.{cls}", "timestamp": 0, "sparkVersion": spark.version,
             "uid": f"{cls}_{uuid.uuid4().hex[:12]}", "paramMap": {}, "defaultParamMap": {
                 "featuresCol": "features", "labelCol": "label", "predictionCol": "prediction", "leafCol": "", "impurity": "variance"}, **more}
        )

    write = lambda data, schema: spark.createDataFrame(data, schema, verifySchema=False).coalesce(1).write
    write(rows, NODES).parquet(f"{folder}/data")
    trees = [(k, about("DecisionTreeRegressionModel"), 1.0) for k in range(n_trees)]
    write(trees, "_1 int, _2 string, _3 double").parquet(f"{folder}/treesMetadata")
    whole = about("GBTRegressionModel", numFeatures=len(edges), numTrees=n_trees)
    write([(whole,)], "value string").text(f"{folder}/metadata")
    return GBTRegressionModel.load(folder)
