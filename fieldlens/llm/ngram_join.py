"""Jaccard join of word shingles by vertical partitioning of the global shingle order.

The order puts shingles by how often a sketch of all texts has seen them, coarsely, and then by hash. Two sets that
reach the threshold share one of their first shingles in this order, which gives candidates. The order is cut into
fragments; each candidate's partial overlaps are counted fragment by fragment and summed per pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.llm import tokens
from fieldlens.llm.graph import components
from fieldlens.llm.shared import broadcast_if_small, documents, stored, text_bytes

SHINGLE = 5
PERCENT = 75
FRAGMENTS = 8
# cells of the sketch: its memory in a task, and what is broadcast. A shingle of more than a few parts in 2**24 of all
# stands out at any size of input
MIN_CELL_BITS, MAX_CELL_BITS = 14, 24
# a further round of stars is worth a pass if the last one linked so many of its pairs
WORTHWHILE = 0.1
WORDS_PER_CELL = 8
SKETCH_PARTS = 64
# numbers of wanted texts that are broadcast: a long each
MARKS = 2_000_000


def shingles(piece: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; fewer than k words count as one shingle."""
    words = tokens.split(piece.column("text"), lower=True)
    by_size = {s: tokens.windows(words.hash, s) for s in range(1, k + 1)}
    out = []
    for begin, n in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        size = min(k, n)
        out.append(np.unique(by_size[size][begin : begin + n - size + 1]) if n else np.zeros(0, np.uint64))
    return out


def shingle_levels(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """How often the shingles of each cell of hashes occur in all texts, as a level: 0 for what chance explains.

    Each task counts in one array of cells; the arrays are added up part by part. The result has a byte per cell.
    """
    cells = text_bytes(docs) / 6 / WORDS_PER_CELL
    bits = int(np.clip(np.ceil(np.log2(max(1, cells))), MIN_CELL_BITS, MAX_CELL_BITS))

    def count(batches):
        # a task's count of a cell stops at 65535, which is frequent in any case
        total = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for piece in tokens.pieces(batch):
                words = tokens.split(piece.column("text"), lower=True)
                found = tokens.windows(words.hash, k)[words.full(k)]
                cell, n = np.unique((found >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
                total[cell] = np.minimum(total[cell] + n, 0xFFFF)
        if total.any():
            press = zstandard.ZstdCompressor(level=1)
            parts = [press.compress(_pack(p)) for p in np.split(total, SKETCH_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts)], ["part", "data"])

    def add(batches):
        # the rows come part by part
        part, total = None, None
        for batch in batches:
            for name, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if name != part:
                    if part is not None:
                        yield _sum_row(part, total)
                    part, total = name, np.zeros((1 << bits) // SKETCH_PARTS, np.int64)
                _add_packed(total, zstandard.ZstdDecompressor().decompress(data.as_py()))
        if part is not None:
            yield _sum_row(part, total)

    counted = docs.select("text").mapInArrow(count, "part int, data binary")
    counted = counted.repartition("part").sortWithinPartitions("part")
    counted = counted.mapInArrow(add, "part int, total long, data binary")
    counted = stored(counted)
    chance = 3 * max(1, (counted.agg(F.sum("total")).first()[0] or 0) / (1 << bits))
    levels = np.zeros(1 << bits, np.uint8)
    size = (1 << bits) // SKETCH_PARTS
    # a byte per cell comes to the driver, however many texts there are

    def to_levels(batches):
        for batch in batches:
            out = []
            for data in batch.column("data"):
                x = np.frombuffer(data.as_py(), np.int64) / chance
                out.append(np.where(x >= 1, np.floor(np.log2(np.maximum(x, 1))) + 1, 0).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(out)], ["part", "levels"])

    for row in counted.select("part", "data").mapInArrow(to_levels, "part int, levels binary").collect():
        levels[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["levels"], np.uint8)
    return levels


def _pack(counts: np.ndarray) -> bytes:
    """Which counts are not 0, a bit each, and those: most are 0, and most others 1."""
    return np.packbits(counts > 0).tobytes() + counts[counts > 0].tobytes()


def _add_packed(total: np.ndarray, data: bytes) -> None:
    bits = len(total) // 8
    there = np.unpackbits(np.frombuffer(data, np.uint8, bits)).view(bool)
    total[there] += np.frombuffer(data, np.uint16, offset=bits)


def _sum_row(part: int, total: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([int(total.sum())], pa.int64()), pa.array([total.tobytes()])]
    return pa.RecordBatch.from_arrays(columns, ["part", "total", "data"])


def level_of(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[(hashes >> np.uint64(64 - (len(levels).bit_length() - 1))).astype(np.int64)]


def class_of(hashes: np.ndarray) -> int:
    """Identifier of a set: texts with equal sets are one class."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def set_rows(docs: DataFrame, levels: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, class and the first shingles in the global order, as many as two similar sets must share one of."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def extract(batches):
        for batch in batches:
            for piece in tokens.pieces(batch):
                sizes, classes, first = [], [], []
                for found in shingles(piece, k):
                    n = len(found)
                    sizes.append(n)
                    classes.append(class_of(found) if n else None)
                    level = level_of(found, shared.value)
                    if level.any():
                        found = found[np.argsort(level, kind="stable")]
                    first.append(found[: n - -(-percent * n // 100) + 1 if n else 0].view(np.int64))
                ends = np.cumsum([0, *map(len, first)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("text_key"), pa.array(sizes, pa.int64()),
                     pa.array(classes, pa.int64()), lists], ["doc_id", "text_key", "n", "class", "first"],
                )

    schema = f"doc_id {kind}, text_key long, n long, class long, first array<long>"
    return docs.select("doc_id", "text", text_key()).mapInArrow(extract, schema)


def text_key():
    """With the id it names the text that stands for a class; the id alone may be null or that of several texts."""
    return F.xxhash64("text").alias("text_key")


def segments(docs: DataFrame, wanted: DataFrame, owners: DataFrame, levels: np.ndarray, k: int) -> DataFrame:
    """class, fragment and shingles of the wanted classes (class), from the text that owns each (owners: class, owner).

    The last fragment holds the frequent shingles, which come last in the order; the others are ranges of hashes.
    Some rows may come twice, and some of other classes, if rows repeat an id and a text or hashes of these clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    # a number per text, so that texts need not be shuffled however many are wanted
    mark = lambda doc_id, key: F.xxhash64(doc_id, key).alias("mark")
    marks = wanted.distinct().join(owners, "class").select(mark("owner.doc_id", "owner.text_key"))
    texts = docs.select("text", mark("doc_id", text_key()))
    texts = texts.join(broadcast_if_small(marks.distinct(), MARKS), "mark", "left_semi")

    def cut(batches):
        for batch in batches:
            for piece in tokens.pieces(batch):
                rows = {"class": [], "fragment": [], "part": []}
                for found in shingles(piece, k):
                    if not len(found):
                        continue
                    name = class_of(found)
                    ranges = (found >> np.uint64(40)).astype(np.int64) * (FRAGMENTS - 1) >> 24
                    fragment = np.where(level_of(found, shared.value) > 0, FRAGMENTS - 1, ranges)
                    for f in np.unique(fragment).tolist():
                        rows["class"].append(name)
                        rows["fragment"].append(f)
                        rows["part"].append(found[fragment == f].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["class"], pa.int64()), pa.array(rows["fragment"], pa.int32()),
                     pa.array(rows["part"], pa.list_(pa.int64()))], ["class", "fragment", "part"]
                )

    return texts.select("text").mapInArrow(cut, "class long, fragment int, part array<long>")


def linked(docs: DataFrame, pairs: DataFrame, owners: DataFrame, levels: np.ndarray, k: int, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) of classes whose overlap, summed over the fragments, reaches the threshold.

    The set of b goes to that of a, once per pair, and a's goes once; neither is written or shuffled in between.
    """
    pairs = broadcast_if_small(pairs)
    cut = lambda x: segments(docs, pairs.select(F.col(x).alias("class")), owners, levels, k)
    sent = cut("b").withColumnsRenamed({"class": "b", "part": "part_b"}).join(pairs, "b")
    both = sent.join(cut("a").withColumnsRenamed({"class": "a", "part": "part_a"}), ["a", "fragment"])
    counted = both.withColumn("overlap", F.size(F.array_intersect("part_a", "part_b")))
    # rows that repeat an id and a text give the same segments again
    each = counted.groupBy("a", "b", "n_a", "n_b", "fragment").agg(F.max("overlap").alias("overlap"))
    summed = each.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    enough = 100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))
    return summed.filter(enough).select("a", "b")


def _in_length(percent: int):
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return 100 * least >= percent * most


def _reach(percent: int):
    """The largest set with which this one can link if the shingle at `place` is the first the two have in common.

    Such a pair has at most the n - place shingles from there on in common, and needs percent / (100 + percent) of
    both sizes together. Every link is found at its first common shingle, so others need not pass.
    """
    rest = F.col("n") - F.col("place")
    return F.floor(((100 + percent) * rest - percent * F.col("n")) / percent)


def _may_link(percent: int):
    """Whether a pair that shares `shares` of its first shingles can reach the threshold.

    Beyond the first shingles of the set whose first shingles end earlier, at most that set's rest can be common.
    """
    rest = lambda n: F.ceil(percent * F.col(n) / 100) - 1
    bound = F.col("shares") + F.greatest(rest("n_a"), rest("n_b"))
    return (100 + percent) * bound >= percent * (F.col("n_a") + F.col("n_b"))


def similar_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and text_key of every row: components of the links between sets of shingles.

    Two sets link when 100 * intersection >= percent * union. Texts with equal sets are one class and are not compared.
    In rounds each class meets some of other components, that stand first among those of its length for one of its first
    shingles, and what is linked becomes one component; then, for every shingle that classes of different components
    still share, all pairs across these components that may have it as their first common one are tested. Pairs within a
    component need no test, so a large group of near copies costs what its rows cost.

    Texts without words have n_shingles 0 and are linked with nothing. A row without an id is linked like others; its
    component is the smallest id it reaches, or null. Rows that repeat an id are separate nodes. Extra columns are
    ignored. Shingles are compared by hashes of 64 bits. With the id, `text_key` tells rows of unlike texts apart.
    """
    docs = docs.select("doc_id", "text")
    levels = shingle_levels(docs, k)
    rows = stored(set_rows(docs, levels, k, percent).withColumn("row", F.monotonically_increasing_id()))
    # an id owns a class rather than none does
    owner = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text_key", "row")
    classes = rows.filter("n > 0").groupBy("class").agg(F.min(owner).alias("owner"))
    classes = stored(classes.select("class", "owner", F.col("owner.doc_id").alias("smallest")))
    links = class_links(docs, rows, classes, levels, k, percent)

    root = components(links)
    of_root = root.join(classes, root.node == classes["class"]).groupBy("root").agg(F.min("smallest").alias("component"))
    of_class = root.join(of_root, "root").select(F.col("node").alias("class"), "component")
    of_class = classes.join(broadcast_if_small(of_class), "class", "left")
    of_class = of_class.select("class", F.coalesce("component", "smallest").alias("component"))
    found = rows.join(of_class, "class", "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "text_key")


def class_links(docs, rows: DataFrame, classes: DataFrame, levels: np.ndarray, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that connect what all links connect."""
    mine = broadcast_if_small(classes.select(F.col("class").alias("_class"), F.col("owner.row").alias("_row")))
    keys = rows.filter("n > 0").join(mine, (F.col("class") == F.col("_class")) & (F.col("row") == F.col("_row")))
    postings = keys.select("class", "n", F.posexplode("first").alias("place", "shingle")).repartition("shingle")
    band = F.floor(F.log(F.col("n")) / np.log(100 / percent)).cast("int")
    postings = postings.select(
        "shingle", "class", "n", band.alias("band"), _reach(percent).alias("reach"), F.col("class").alias("root")
    )
    owners = classes.select("class", "owner")
    links, placed, turn = None, stored(with_hubs(contested(postings), 0)), 0
    while True:
        star = stored(stars(placed, turn, percent))
        found = stored(linked(docs, star, owners, levels, k, percent))
        joins = found.count()
        links = found if links is None else stored(links.union(found))
        turn += 1
        # the first turn is a narrow one and tells nothing of the next
        last = turn > 1 and joins <= WORTHWHILE * star.count()
        # components only grow: what is not contested now never will be
        if joins or not last:
            placed = contested(rooted(placed.drop("root", "hub"), links).repartition("shingle"))
        if last:
            break
        placed = stored(with_hubs(placed, turn))
    pairs = stored(across(stored(placed) if joins else placed, percent))
    return links.union(linked(docs, pairs, owners, levels, k, percent))


def rooted(postings: DataFrame, links: DataFrame) -> DataFrame:
    """Postings with the root of the class's component."""
    root = broadcast_if_small(components(links).withColumnRenamed("node", "class"))
    return postings.join(root, "class", "left").withColumn("root", F.coalesce("root", "class"))


def contested(placed: DataFrame) -> DataFrame:
    """Postings of shingles that classes of different components share, sorted by band; they come dealt by shingle."""
    over = Window.partitionBy("shingle")
    placed = placed.sortWithinPartitions("shingle", "band")
    placed = placed.withColumns({"least": F.min("root").over(over), "most": F.max("root").over(over)})
    return placed.filter("least < most").drop("least", "most")


def with_hubs(placed: DataFrame, turn: int) -> DataFrame:
    """Add the hub (class, n, root) that a class meets for its shingle: one of another component, or null.

    Each shingle and band of lengths has two hubs of different components. In the first turn all shingles of a class
    prefer the same hub; then hubs change from shingle to shingle. Behind `contested` this takes no shuffle or sort.
    """
    group = Window.partitionBy("shingle", "band")
    place = F.xxhash64(F.lit(turn), "shingle", "class") if turn else F.col("class")
    hub = F.struct(place.alias("place"), "class", "n", "root")
    met = placed.withColumn("one", F.min(hub).over(group))
    met = met.withColumn("two", F.min(F.when(F.col("root") != F.col("one.root"), hub)).over(group))
    met = met.withColumn("hub", F.when(F.col("root") != F.col("one.root"), F.col("one")).otherwise(F.col("two")))
    return met.withColumn("hub", F.col("hub").dropFields("place")).drop("one", "two")


def stars(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Candidates between each class and the hubs of its first shingles: no more than there are postings.

    In the first turn, where most are left, one candidate per class is kept, the hub of most of its shingles. Then all
    that may link are kept.
    """
    met = placed.filter("hub is not null")
    if not turn:
        met = met.groupBy("class", "n", "hub").agg(F.count("*").alias("shares"))
        met = met.groupBy("class", "n").agg(F.max(F.struct("shares", "hub")).alias("best")).select("class", "n", "best.*")
    first = F.col("class") < F.col("hub.class")
    star = met.select(
        *([] if turn else ["shares"]),
        F.least("class", "hub.class").alias("a"),
        F.greatest("class", "hub.class").alias("b"),
        F.when(first, F.col("n")).otherwise(F.col("hub.n")).alias("n_a"),
        F.when(first, F.col("hub.n")).otherwise(F.col("n")).alias("n_b"),
    ).filter(_in_length(percent))
    if turn:
        return _sharing(star.distinct(), placed, percent)
    return star.filter(_may_link(percent)).drop("shares").distinct()


def across(placed: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes of different components that may have a shingle as their first common one, and may link."""
    # a component is one row per shingle, with what its members allow at most
    roots = placed.groupBy("shingle", "root").agg(F.min("n").alias("n"), F.max("reach").alias("reach"))
    side = lambda df, x: df.withColumnsRenamed({c: f"{c}_{x}" for c in df.columns if c != "shingle"})
    in_reach = (F.col("n_a") <= F.col("reach_b")) & (F.col("n_b") <= F.col("reach_a"))
    meet = side(roots, "a").join(side(roots, "b"), "shingle").filter((F.col("root_a") < F.col("root_b")) & in_reach)
    # members that pass for none of the other component are not paired
    ends = {f"{c}_{x}": f"{c}_of_{x}" for c in ("n", "reach") for x in "ab"}
    fits = lambda x, y: (F.col(f"n_{x}") <= F.col(f"reach_of_{y}")) & (F.col(f"n_of_{y}") <= F.col(f"reach_{x}"))
    meet = meet.withColumnsRenamed(ends)
    members = placed.drop("band", "hub")
    pairs = meet.join(side(members, "a"), ["shingle", "root_a"]).filter(fits("a", "b"))
    pairs = pairs.join(side(members, "b"), ["shingle", "root_b"]).filter(fits("b", "a") & in_reach)
    pairs = pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), "n_a", "n_b")
    return _sharing(pairs.distinct(), placed, percent)


def _sharing(pairs: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) of classes of different components that share enough first shingles to link."""
    # all first shingles that a pair of different components shares are in `placed`
    own = stored(placed.groupBy("class").agg(F.collect_set("shingle").alias("own")))
    pairs = broadcast_if_small(pairs).join(own.withColumnsRenamed({"class": "a", "own": "own_a"}), "a")
    pairs = pairs.join(own.withColumnsRenamed({"class": "b", "own": "own_b"}), "b")
    pairs = pairs.withColumn("shares", F.size(F.array_intersect("own_a", "own_b"))).drop("own_a", "own_b")
    return pairs.filter(_may_link(percent)).drop("shares")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir)).drop("text_key")
