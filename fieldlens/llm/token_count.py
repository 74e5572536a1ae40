"""Token counts by byte-pair merging on a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.shared import documents

# pieces kept with their counts in a task; forgetting them costs time, never a result
REMEMBERED = 400_000


def byte_of_sign() -> dict[str, int]:
    """The signs that stand for bytes in the vocabulary file.

    Printable bytes stand for themselves; the others follow, in order, from code point 256.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[tuple[bytes, bytes], int], list[str]]:
    """Ranks of the merges, and the special strings, of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    sign = byte_of_sign()
    plain = lambda s: bytes(sign[c] for c in s)
    merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    ranks = {(plain(a), plain(b)): i for i, (a, b) in enumerate(merges)}
    return ranks, [t["content"] for t in spec.get("added_tokens", [])]


def symbols_left(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols of a piece after all merges: initial symbols minus merges.

    The lowest-rank adjacent pair is popped again and again, the leftmost first. Neighbours are linked by position;
    a popped pair counts only while both of its symbols still stand as they were pushed.
    """
    n = len(piece)
    symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbol[i], symbol[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbol[i], symbol[i + 1]))
    heapq.heapify(heap)
    merged = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if symbol[i] is not a or j >= n or symbol[j] is not b:
            continue
        both = a + b
        symbol[i], symbol[j] = both, None
        after = right[i] = right[j]
        merged += 1
        if after < n:
            left[after] = i
            rank = ranks.get((both, symbol[after]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, both, symbol[after]))
        before = left[i]
        if before >= 0:
            rank = ranks.get((symbol[before], both))
            if rank is not None:
                heapq.heappush(heap, (rank, before, symbol[before], both))
    return n - merged


class Counts(dict):
    """Symbols left of each piece seen."""

    def __init__(self, ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[piece] = symbols_left(piece.encode(), self.ranks)
        return found


def token_counter(spark: SparkSession, path: str, pattern: str):
    """A column function: tokens of a text under the vocabulary in `path`, whose texts are cut by `pattern`.

    The ranks go to the executors as a broadcast; their number is that of the file's merges.
    """
    ranks, special = read_vocabulary(path)
    shared = spark.sparkContext.broadcast((ranks, special))

    @F.arrow_udf("long")
    def tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        ranks, special = shared.value
        counts, find = Counts(ranks), regex.compile(pattern).findall
        marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        for column in texts:
            out = []
            for text in column:
                text = text.as_py() or ""
                parts = marks.split(text) if marks else [text]
                out.append(len(parts) - 1 + sum(sum(map(counts.__getitem__, find(p))) for p in parts))
            yield pa.array(out, pa.int64())

    return tokens


def with_token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """Add n_bytes, n_tokens and over_limit; columns of these names are replaced, all others stay.

    Special strings inside a text are one token each, as the library reads them by default. Null and empty texts have
    0 bytes and 0 tokens. Each row is counted by itself, whatever its id or copies.
    """
    tokens = token_counter(docs.sparkSession, path, pattern)
    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("n_tokens", tokens(F.col(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
