"""Benchmark decontamination: an FM-index per training shard, searched for the windows of test items."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.llm import tokens
from fieldlens.llm.shared import documents

WINDOW = 10
# words of a training shard: what one index holds; a longer text is a shard of its own
SHARD_WORDS = 500_000
# every so many text positions the suffix array is kept
SAMPLE = 16
# text of test items whose windows make one broadcast, of some 15 times the size; more items go in several
BLOCK_BYTES = 2 << 20

END, GAP, FIRST_WORD = 0, 1, 2


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Order of all suffixes of an integer text that ends in a unique smallest value, by prefix doubling.

    The first pass orders by three symbols; later passes touch only suffixes that are not yet told apart.
    """
    n, wide = len(ids), int(ids.max()) + 2
    h = 3 if wide < 1 << 20 else 2
    key = ids + 1
    for k in range(1, h):
        key *= wide
        key[: n - k] += ids[k:] + 1
    sa = np.argsort(key)
    start = np.ones(n, bool)
    start[1:] = key[sa[1:]] != key[sa[:-1]]
    del key
    # the rank of a suffix is the first place of its group
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    alone = start & np.append(start[1:], True)
    places = np.flatnonzero(~alone)
    while len(places):
        open_sa = sa[places]
        at = open_sa + h
        after = np.where(at < n, rank[np.minimum(at, n - 1)], -1)
        key = rank[open_sa] * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        sa[places] = open_sa = open_sa[order]
        key = key[order]
        start = np.ones(len(places), bool)
        start[1:] = key[1:] != key[:-1]
        rank[open_sa] = np.maximum.accumulate(np.where(start, places, 0))
        alone = start & np.append(start[1:], True)
        places, h = places[~alone], 2 * h
    return sa


class Bits:
    """A bit vector with ranks, counted in blocks of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(counts, out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, rest = i >> 6, (i & 63).astype(np.uint64)
        below = self.words[block] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[block] + np.bitwise_count(below)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Rank and access over an integer sequence: one bit vector per bit, zeros ordered before ones at each level."""

    def __init__(self, symbols: np.ndarray):
        self.height = max(1, int(symbols.max()).bit_length())
        self.levels = []
        for level in range(self.height - 1, -1, -1):
            one = (symbols >> level) & 1 == 1
            self.levels.append(Bits(one))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        begin, end = np.zeros_like(i), i
        for k, bits in enumerate(self.levels):
            one = (symbol >> (self.height - 1 - k)) & 1 == 1
            b, e = bits.ones(begin), bits.ones(end)
            begin = np.where(one, bits.zeros + b, begin - b)
            end = np.where(one, bits.zeros + e, end - e)
        return end - begin

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for bits in self.levels:
            one, ones = bits.at(i), bits.ones(i)
            symbol = symbol * 2 + one
            i = np.where(one, bits.zeros + ones, i - ones)
        return symbol


class FmIndex:
    """Counts and places of word sequences in a shard of texts, given as word hashes and text ranges."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        texts = len(first) - 1
        # a gap after every text, and the end
        text = np.full(len(hashes) + texts + 1, GAP, np.int64)
        text[-1] = END
        self.gaps = first[1:] + np.arange(texts)
        inside = np.ones(len(text), bool)
        inside[self.gaps] = inside[-1] = False
        text[inside] = ids + FIRST_WORD
        sa = suffix_array(text)
        last = text[sa - 1]
        self.tree = WaveletTree(last)
        counts = np.bincount(text, minlength=len(self.vocabulary) + FIRST_WORD)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        sampled = sa % SAMPLE == 0
        self.sampled = Bits(sampled)
        self.samples = sa[sampled]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word, -1 for words that do not occur."""
        if not len(self.vocabulary):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + FIRST_WORD, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of the suffixes that start with each pattern (rows of symbols), by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.smaller[-1], np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k]
            low, high = self.smaller[c] + self.tree.rank(c, low), self.smaller[c] + self.tree.rank(c, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: step backwards until a sampled position."""
        steps, place, open_rows = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(open_rows):
            at = rows[open_rows]
            known = self.sampled.at(at)
            done = open_rows[known]
            place[done] = self.samples[self.sampled.ones(at[known])] + steps[done]
            open_rows, at = open_rows[~known], at[~known]
            c = self.tree.access(at)
            rows[open_rows] = self.smaller[c] + self.tree.rank(c, at)
            steps[open_rows] += 1
        return place

    def occurrences(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word position in the shard) of every occurrence of patterns given as rows of word hashes."""
        symbols = self.symbols(patterns)
        known = np.flatnonzero((symbols >= 0).all(axis=1))
        low, high = self.search(symbols[known])
        found = np.maximum(high - low, 0)
        rows = np.repeat(low - np.cumsum(found) + found, found) + np.arange(found.sum())
        text = self.locate(rows)
        return np.repeat(known, found), text - np.searchsorted(self.gaps, text)


WINDOW_ROWS = "size int, key binary, name string"


def window_rows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The windows of items (name, text), made in tasks; a window that an item repeats is one row."""

    def cut(batches):
        for batch in batches:
            for piece in tokens.pieces(batch):
                words = tokens.split(piece.column("text"), lower=True, kept=tokens.ALPHANUMERIC)
                sizes, keys, names = [], [], []
                for i, (begin, end) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                    size = min(window, end - begin)
                    if size:
                        rows = np.lib.stride_tricks.sliding_window_view(words.hash[begin:end], size)
                        keys += [r.tobytes() for r in rows]
                        sizes += [size] * len(rows)
                        names += [piece.column("name")[i].as_py()] * len(rows)
                columns = (pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(names, pa.string()))
                yield pa.RecordBatch.from_arrays(list(columns), ["size", "key", "name"])

    return items.mapInArrow(cut, WINDOW_ROWS).distinct()


def packed_windows(found: pa.Table) -> list[tuple]:
    """Rows of `window_rows` by length: (patterns, first, owner, names).

    Patterns are distinct rows of word hashes; the items of the i-th are names[owner[first[i]:first[i + 1]]].
    """
    out = []
    for size in pc.unique(found.column("size")).to_pylist():
        own = found.filter(pc.equal(found.column("size"), size)).sort_by([("key", "ascending"), ("name", "ascending")])
        keys, names = own.column("key").combine_chunks(), own.column("name").combine_chunks().dictionary_encode()
        rows = np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, size)
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        first = np.append(np.flatnonzero(new), len(rows))
        out.append((rows[new], first, names.indices.to_numpy(), names.dictionary.to_pylist()))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


def search_shard(columns: list[pa.Array], windows) -> list[tuple[int, list, set]]:
    """For each text: number of words, spans hit as word ranges, and items found. One index serves all blocks."""
    hashes, counts = [], []
    for column in columns:
        words = tokens.split(column, lower=True, kept=tokens.ALPHANUMERIC)
        hashes.append(words.hash)
        counts.append(words.counts)
        del words
    hashes, counts = np.concatenate(hashes), np.concatenate(counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    spans, items = defaultdict(list), defaultdict(set)
    index = FmIndex(hashes, first)
    del hashes
    for block in windows:
        for patterns, owned, owner, names in block.value:
            which, at = index.occurrences(patterns)
            text = np.searchsorted(first, at, side="right") - 1
            size = patterns.shape[1]
            for p, t, begin in zip(which.tolist(), text.tolist(), (at - first[text]).tolist(), strict=True):
                spans[t].append((begin, begin + size))
                items[t].update(names[k] for k in owner[owned[p] : owned[p + 1]].tolist())
        if len(windows) > 1:
            # the next block takes its place; a broadcast that is asked for again is read again
            block.__dict__.pop("_value", None)
    return [(int(n), merged(spans[i]), items[i]) for i, n in enumerate(counts.tolist())]


def _blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """Windows of the test items as broadcasts, each of the items of about `block_bytes` of text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    context = benchmark.sparkSession.sparkContext
    found = items.withColumn("_block", F.pmod(F.xxhash64("name", "text"), F.lit(n)))
    return [
        context.broadcast(packed_windows(window_rows(found.filter(F.col("_block") == b).drop("_block")).toArrow()))
        for b in range(n)
    ]


SPANS = "array<struct<begin:int,end:int>>"


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, clean: bool = False
) -> DataFrame:
    """Add n_words, spans (ranges of words inside a window of a test item, merged) and items (their ids).

    With `clean`, also the text without the spans, from the same pass; it is null where nothing is cut.

    A window is ten consecutive words of an item; an item of fewer, but not none, is one window. Null texts and null
    items have no words. An item without an id is called "". Items that share an id count as one. Columns of these
    names are replaced; all others stay. Tasks index their rows shard by shard, so nothing is shuffled.
    """
    new = {"n_words": "long", "spans": SPANS, "items": "array<string>"} | ({"clean": "string"} if clean else {})
    docs = docs.drop(*new)
    schema = docs.withColumns({c: F.lit(None).cast(kind) for c, kind in new.items()}).schema
    blocks = _blocks(benchmark, block_bytes)

    def search(batches):
        held, size = [], 0
        for batch in batches:
            for piece in tokens.pieces(batch):
                held.append(piece)
                size += len(tokens.raw(piece.column("text"))[0])
                # a word and the blank after it have about six bytes
                if size >= 6 * SHARD_WORDS:
                    yield from answers(held, blocks, clean)
                    held, size = [], 0
        if held:
            yield from answers(held, blocks, clean)
        tokens.give_back()

    return docs.mapInArrow(search, schema)


def answers(batches: list[pa.RecordBatch], windows, clean: bool):
    """The batches with their new columns."""
    found = search_shard([b.column("text") for b in batches], windows)
    at = 0
    for batch in batches:
        own = found[at : at + batch.num_rows]
        at += batch.num_rows
        spans = [[{"begin": b, "end": e} for b, e in cut] for _, cut, _ in own]
        new = {
            "n_words": pa.array([n for n, _, _ in own], pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
            "items": pa.array([sorted(names) for _, _, names in own], pa.list_(pa.string())),
        }
        if clean:
            hit = pa.array([bool(x) for x in spans])
            texts = iter(cut_texts(batch.column("text").filter(hit), [x for x in spans if x]).to_pylist())
            new["clean"] = pa.array([next(texts) if x else None for x in spans], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, *new.values()], [*batch.schema.names, *new])


def cut_texts(texts: pa.Array, spans: list) -> pa.Array:
    """Texts without their spans, each cut from its first word to its last."""
    words = tokens.split(texts, lower=True, kept=tokens.ALPHANUMERIC)
    data, offsets = tokens.raw(texts)
    out = []
    for i, cut in enumerate(spans):
        if not texts[i].is_valid:
            out.append(None)
            continue
        at, parts = offsets[i], []
        for span in cut or ():
            parts.append(data[at : words.begin[words.first[i] + span["begin"]]].tobytes())
            at = words.end[words.first[i] + span["end"] - 1]
        parts.append(data[at : offsets[i + 1]].tobytes())
        out.append(b"".join(parts).decode())
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without their spans, each cut from its first word to its last."""
    return cut_texts(texts, spans.to_pylist())


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
