"""Language-model scores by a hierarchical Pitman-Yor model.

A restaurant for each preceding word shares one parent restaurant over all words, whose parent is uniform.
Customers are the training tokens; seating is sampled by Gibbs sweeps, and probabilities are averaged over samples.

Words are dealt to buckets by hash, so that all customers of a word, in every restaurant, are in one bucket. Between
sweeps the buckets exchange the restaurants' totals. Those of the most frequent contexts, a fixed number, go through
the driver. All others are summed in the bucket that has the context as a word, and go back to the buckets that ask.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import tokens
from fieldlens.llm.shared import documents, fold, stored, text_bytes

# contexts with the most tokens: every bucket gets their totals; the totals of all others are shuffled
HOT_CONTEXTS = 4096
# words with the most tokens are scored after hot contexts where the texts are, with a table of both
HOT_WORDS = 512
# text whose words make up a bucket, and text that a task counts or looks up at once
BUCKET_BYTES = 16 << 20
GROUP_BYTES = 8 << 20
# pairs that a bucket takes in before it adds them up
MERGE_PAIRS = 1 << 19
SWEEPS, BURN_IN = 3, 1
STRENGTH = (1.0, 1.0)
SEATED_SINGLY = 64

_END = np.uint64(0xE7037ED1A0B428DB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted numbers as differences, bytes of equal rank together."""
    steps = np.diff(x, prepend=np.uint64(0))
    return pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def unpack_sorted(data: bytes) -> np.ndarray:
    columns = unpack(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(columns.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_pairs(word: np.ndarray, context: np.ndarray) -> bytes:
    """Pairs in order of their words."""
    words, first = np.unique(word, return_index=True)
    names, at = np.unique(context, return_inverse=True)
    per = np.diff(np.append(first, len(word))).astype(np.uint32)
    return pickle.dumps((pack_sorted(words), pack(per), pack_sorted(names), pack(at.astype(np.uint32))))


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    words, per, names, at = pickle.loads(data)
    return np.repeat(unpack_sorted(words), unpack(per, np.uint32)), unpack_sorted(names)[unpack(at, np.uint32)]


def sums_from(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else x[:0]


def token_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, hash of the word before, and text number of every token; each text closes with an end token."""
    words = tokens.split(column, lower=True)
    texts = len(words.first) - 1
    n = len(words) + texts
    ends = words.first[1:] + np.arange(texts)
    word = np.empty(n, np.uint64)
    inside = np.ones(n, bool)
    inside[ends] = False
    word[inside] = words.hash
    word[ends] = _END
    # before the first token an end; so a word is a context as often as it is a token
    return word, np.concatenate([[_END], word[:-1]]), np.repeat(np.arange(texts), words.counts + 1)


def groups(batches, size: int = GROUP_BYTES):
    """Lists of record batches with about `size` bytes of text together."""
    held, total = [], 0
    for batch in batches:
        for piece in tokens.pieces(batch):
            held.append(piece)
            total += len(tokens.raw(piece.column("text"))[0])
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and for each value its place among them in 32 bits."""
    order = np.argsort(x, kind="stable").astype(np.int32)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], at


def dealt(word: np.ndarray, context: np.ndarray, buckets: int):
    """(bucket, places of its tokens in order of word and context) for every bucket that has some."""
    if not len(word):
        return
    # numbers in the order of bucket and word; a context's order is that of its hash
    words, w = places(word)
    bucket = (words % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[by] = np.arange(len(words))
    pair = rank[w]
    del w
    contexts, c = places(context)
    pair *= len(contexts)
    pair += c
    del c
    order = np.argsort(pair, kind="stable")
    names, starts = np.unique(bucket[by], return_index=True)
    cuts = np.searchsorted(pair[order], starts[1:] * len(contexts))
    yield from zip(names.tolist(), np.split(order, cuts), strict=True)


ROW = "bucket int, kind int, grp long, a binary, b binary, c binary, d binary"
_ROW = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), ("grp", pa.int64()), *[(c, pa.binary()) for c in "abcd"]]
)


def _row(bucket, kind, group=0, a=None, b=None, c=None, d=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(
        [{"bucket": bucket, "kind": kind, "grp": group, "a": a, "b": b, "c": c, "d": d}], schema=_ROW
    )


def summed(word: np.ndarray, context: np.ndarray, counts: np.ndarray, ordered: bool = False):
    """Each pair once, in order of word and context, with the sum of its counts."""
    if not ordered:
        order = np.lexsort((context, word))
        word, context, counts = word[order], context[order], counts[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1])
    start = np.flatnonzero(new)
    return word[start], context[start], sums_from(counts, start)


COUNTS = "bucket int, keys binary, counts binary, asked binary, words long, tokens long, ones array<long>, pairs long, top array<struct<key:long,n:long>>"


def pair_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Per bucket the customers of each (word, context): `keys` and `counts`.

    With a column held_out, its rows bring no customers; contexts that only they have before the bucket's words are
    in `asked`. A task adds up what it reads before the shuffle, and a bucket adds up what tasks have found.
    """
    held = F.coalesce("held_out", F.lit(True)) if "held_out" in docs.columns else F.lit(False)

    def count(batches):
        for group in groups(batches):
            parts = [token_rows(p.column("text")) for p in group]
            learned = np.concatenate(
                [~p.column("held_out").to_numpy(zero_copy_only=False).astype(bool)[x[2]] for p, x in zip(group, parts, strict=True)]
            ).astype(np.int32)
            word, context = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            del parts
            for bucket, at in dealt(word, context, buckets):
                w, c, n = summed(word[at], context[at], learned[at], ordered=True)
                yield _row(bucket, 0, 0, pack_pairs(w, c), pack(n.astype(np.uint32)))

    def bucket_row(bucket, found):
        word, context, counts = summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
        known = counts > 0
        asked = np.setdiff1d(context[~known], context[known])
        word, context, counts = word[known], context[known], counts[known]
        words, first = np.unique(word, return_index=True)
        per_word = sums_from(counts, first)
        pairs_of = np.diff(np.append(first, len(word)))
        # how many words have one and two tokens, and so for pairs
        ones = [int((x == k).sum()) for x in (pairs_of, counts) for k in (1, 2)]
        top = np.argsort(-per_word, kind="stable")[: max(HOT_WORDS, HOT_CONTEXTS)]
        return {
            "bucket": bucket,
            "keys": pack_pairs(word, context),
            "counts": pack(counts),
            "asked": pack_sorted(asked),
            "words": len(words),
            "tokens": int(counts.sum()),
            "ones": ones,
            "pairs": len(word),
            "top": [{"key": int(k), "n": int(n)} for k, n in zip(words[top].view(np.int64), per_word[top], strict=True)],
        }

    def merge(batches):
        schema = pa.schema(
            [("bucket", pa.int32()), *[(c, pa.binary()) for c in ("keys", "counts", "asked")], ("words", pa.int64()),
             ("tokens", pa.int64()), ("ones", pa.list_(pa.int64())), ("pairs", pa.int64()),
             ("top", pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())])))]
        )
        current, found = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != current and found:
                    yield pa.RecordBatch.from_pylist([bucket_row(current, found)], schema=schema)
                    found = []
                current = row["bucket"]
                found.append((*unpack_pairs(row["a"]), unpack(row["b"], np.uint32).astype(np.int64)))
                if len(found) > 1 and sum(len(x[0]) for x in found[1:]) >= max(MERGE_PAIRS, len(found[0][0])):
                    found = [summed(*(np.concatenate(x) for x in zip(*found, strict=True)))]
        if found:
            yield pa.RecordBatch.from_pylist([bucket_row(current, found)], schema=schema)
        tokens.give_back()

    rows = docs.select(held.alias("held_out"), "text").mapInArrow(count, ROW).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(merge, COUNTS)


@dataclass
class Totals:
    """Of all restaurants after a sweep: tables by hot context, and customers and tables of the parent."""

    tables: np.ndarray
    customers: float
    parent_tables: float


@dataclass
class Model:
    """What all buckets share. `totals` starts with the first seating and gains one entry per sweep.

    `hot` are the hot contexts in order and `customers` theirs. `asked` has, per sweep, the other contexts' totals for the
    buckets that seat customers there, `last` what scoring needs, and `lines` the hot words' seats; these tables' names
    stay on the driver.
    """

    words: int
    tokens: int
    hot: np.ndarray
    customers: np.ndarray
    discounts: tuple[float, float]
    totals: list[Totals]
    seed: int = 0
    buckets: int = 1
    asked: list[DataFrame] = field(default_factory=list)
    last: DataFrame | None = None
    lines: DataFrame | None = None

    def __getstate__(self):
        return self.__dict__ | {"asked": [], "last": None, "lines": None}

    def find(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which contexts are hot, and their places."""
        if not len(self.hot):
            return np.zeros(len(contexts), bool), np.zeros(len(contexts), np.int64)
        at = np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)
        return self.hot[at] == contexts, at

    def cold(self, contexts: np.ndarray) -> np.ndarray:
        """Places of the contexts that are not hot, those of one home together; `contexts` are in order."""
        at = np.flatnonzero(~self.find(contexts)[0])
        return at[np.argsort(contexts[at] % np.uint64(self.buckets), kind="stable")]

    def restaurants(self, contexts: np.ndarray, cold=None) -> tuple[np.ndarray, np.ndarray]:
        """Customers of each context, and its tables in every sample; `cold` has those of contexts that are not hot."""
        hot, at = self.find(contexts)
        after = self.totals[BURN_IN + 1 :]
        customers, tables = np.zeros(len(contexts)), np.zeros((len(after), len(contexts)))
        customers[hot] = self.customers[at[hot]]
        for k, t in enumerate(after):
            tables[k, hot] = t.tables[at[hot]]
        if cold is not None and len(cold[0]):
            names, values = cold
            at = np.minimum(np.searchsorted(names, contexts), len(names) - 1)
            found = np.flatnonzero(names[at] == contexts)
            customers[found], tables[:, found] = values[0, at[found]], values[1:, at[found]]
        return customers, tables

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def parent(self, totals: Totals, customers, tables):
        """Probability of words in the parent restaurant; for an unseen word both are 0."""
        d, s = self.discounts[0], STRENGTH[0]
        uniform = (s + d * totals.parent_tables) / (self.words + 1)
        return (customers - d * tables + uniform) / (s + totals.customers)


class Draws:
    """Numbers that follow from seed, sweep and a key for each dish, however words are dealt to buckets."""

    def __init__(self, seed: int, sweep: int, keys: np.ndarray):
        self.keys = keys.astype(np.uint64) ^ tokens.mix(np.array([(seed << 8) + sweep + 1], np.uint64))

    def at(self, dishes: np.ndarray, step: int) -> Draws:
        self.now = tokens.mix(tokens.mix(self.keys[dishes]) + np.array([step], np.uint64) * _STEP)
        return self

    def random(self, n: int, part: int = 0) -> np.ndarray:
        return (tokens.mix(self.now + np.uint64(part)) >> np.uint64(11)) * 2.0**-53

    def binomial(self, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """By inversion, in parts that expect 200 at most."""
        rare = np.minimum(p, 1 - p)
        parts = np.maximum(1, np.ceil(n * rare / 200)).astype(np.int64)
        total = np.zeros(len(n), np.int64)
        for k in range(int(parts.max(initial=0))):
            m = np.where(k < parts, n // parts + (k < n % parts), 0)
            u, x = self.random(len(n), k), np.zeros(len(n), np.int64)
            mass = np.exp(m * np.log1p(-rare))
            sums = mass.copy()
            on = np.flatnonzero((u >= sums) & (x < m))
            while len(on):
                x[on] += 1
                mass[on] *= (m[on] - x[on] + 1) / x[on] * rare[on] / (1 - rare[on])
                sums[on] += mass[on]
                on = on[(u[on] >= sums[on]) & (x[on] < m[on])]
            total += x
        return np.where(p > 0.5, n - total, total)


def seat(customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, rng) -> np.ndarray:
    """Tables of each dish after all its customers are seated again, given the tables of the other dishes.

    Customers come one by one at first and, from then on, in blocks of an eighth of those seated, with one binomial
    draw per block.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    active, i = np.flatnonzero(customers > 1), 1
    while len(active):
        step = 1 if i < SEATED_SINGLY else i // 8
        arriving = np.minimum(customers[active] - i, step)
        t = tables[active]
        opens = (strength + discount * (others[active] + t)) * base[active]
        chance = np.clip(opens / (i + (arriving - 1) / 2 - discount * t + opens), 0, 1)
        draws = rng.at(active, i) if isinstance(rng, Draws) else rng
        tables[active] += (draws.random(len(active)) < chance) if step == 1 else draws.binomial(arriving.astype(np.int64), chance)
        i += step
        active = active[customers[active] > i]
    return tables


class Seats:
    """Pairs with more than one customer and what else a sweep needs; a pair with one customer always has one table."""

    def __init__(self, pairs, word, at, word_key, pair_key, counts, contexts, line=()):
        self.pairs, self.word, self.at, self.counts, self.contexts = pairs, word, at, counts, contexts
        # what draws follow from: 32 bits of each word with more than one pair, and of each of the pairs
        self.word_key, self.pair_key = word_key, pair_key
        # hot words after hot contexts: hash, tokens and number of the words; of pairs word, context and place among the above
        self.line = line

    def pack(self) -> bytes:
        rest = [pack(x.astype(np.uint32)) for x in (self.pairs, self.word, self.at, self.word_key, self.pair_key)]
        line = [(x.dtype.str, pack(x)) for x in self.line]
        return pickle.dumps((rest, pack(self.counts), pack_sorted(self.contexts), line))

    @staticmethod
    def unpack(data: bytes) -> Seats:
        rest, counts, names, line = pickle.loads(data)
        rest = [unpack(x, np.uint32).astype(np.int64) for x in rest]
        return Seats(*rest, unpack(counts, np.int64), unpack_sorted(names), [unpack(x, kind) for kind, x in line])

    def sweeps(self, model: Model, n: int, cold=()):
        """(tables, parent customers, parent tables) after each of n sweeps; the same on every call.

        `cold` has the totals of contexts that are not hot: those of the first seating, then what each sweep adds.
        """
        hot, place = model.find(self.contexts)
        others_at = model.cold(self.contexts)
        tables = np.ones(len(self.counts))
        customers, parents = self.pairs.astype(np.float64), np.ones(len(self.pairs))
        for s in range(n):
            totals = model.totals[s]
            total = np.zeros(len(self.contexts))
            total[hot] = totals.tables[place[hot]]
            if len(others_at):
                total[others_at] = cold[0] + cold[s] if s else cold[0]
            base = model.parent(totals, customers, parents)[self.word]
            draws = Draws(model.seed, 2 * s, self.pair_key)
            tables = seat(self.counts, total[self.at] - tables, base, model.discounts[1], STRENGTH[1], draws)
            customers = self.pairs + np.bincount(self.word, tables - 1, len(self.pairs))
            uniform = np.full(len(self.pairs), 1 / (model.words + 1))
            draws = Draws(model.seed, 2 * s + 1, self.word_key)
            parents = seat(
                customers, totals.parent_tables - parents, uniform, model.discounts[0], STRENGTH[0], draws
            )
            yield tables, customers, parents


class Bucket:
    """Words of a bucket with their customers in every restaurant."""

    def __init__(self, number: int, keys: bytes, counts: bytes):
        self.number = number
        words, per, names, at = pickle.loads(keys)
        self.word, self.pairs = unpack_sorted(words), unpack(per, np.uint32).astype(np.int64)
        self.klass = unpack_sorted(names)[unpack(at, np.uint32)]
        self.counts = unpack(counts, np.int64)
        self.first = np.cumsum(self.pairs) - self.pairs
        self.of = np.repeat(np.arange(len(self.word), dtype=np.int32), self.pairs)
        self.tokens = sums_from(self.counts, self.first)
        self.many = np.flatnonzero(self.counts > 1)

    def seats(self, model: Model | None = None, wanted: np.ndarray = ()) -> Seats:
        contexts, at = np.unique(self.klass[self.many], return_inverse=True)
        line = ()
        if len(wanted):
            mine = np.flatnonzero(np.isin(self.word, wanted))
            hot, place = model.find(self.klass)
            pairs = np.flatnonzero(np.isin(self.of, mine) & hot)
            among = np.full(len(self.counts), -1)
            among[self.many] = np.arange(len(self.many))
            line = (self.word[mine], self.tokens[mine], mine, self.of[pairs], place[pairs], among[pairs])
        upper = np.uint64(32)
        word_key = np.where(self.pairs > 1, tokens.mix(self.word) >> upper, np.uint64(0))
        pair_key = tokens.mix(tokens.mix(self.word)[self.of[self.many]] + self.klass[self.many]) >> upper
        return Seats(self.pairs, self.of[self.many], at, word_key, pair_key, self.counts[self.many], contexts, line)

    def samples(self, model: Model, cold=()) -> tuple[np.ndarray, np.ndarray]:
        """Mean discounted customers of each pair, and the parent's probability of each word in every sample."""
        kept = [x for s, x in enumerate(self.seats().sweeps(model, SWEEPS, cold)) if s >= BURN_IN]
        own = self.counts - model.discounts[1]
        own[self.many] = self.counts[self.many] - model.discounts[1] * sum(t for t, _, _ in kept) / len(kept)
        after = model.totals[BURN_IN + 1 :]
        parent = np.array([model.parent(t, c, p) for t, (_, c, p) in zip(after, kept, strict=True)])
        return own, parent

    def index(self):
        """A function from words and contexts to places of the words and of the pairs, -1 for those without customers."""
        names, place = places(self.klass)
        pairs = self.of.astype(np.int64)
        pairs *= len(names)
        pairs += place
        del place

        def at(x: np.ndarray, table: np.ndarray) -> np.ndarray:
            if not len(table):
                return np.full(len(x), -1)
            i = np.minimum(np.searchsorted(table, x), len(table) - 1)
            return np.where(table[i] == x, i, -1)

        def find(word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            w, c = at(word, self.word), at(context, names)
            return w, at(np.where((w >= 0) & (c >= 0), w * len(names) + c, -1), pairs)

        return find


# kinds of rows between buckets: sums by context are asked for with ALL or SOME, and go back as many numbers
OWN, ALL, SOME = 0, 1, 2
ANSWER = 10
SEATS, TOTAL, LINE = 20, 21, 22
KEYS, HEAD, TOKENS = 30, 31, 32
ROW_COLUMNS = _ROW.names
SWEPT = f"{ROW}, tables array<long>, customers double, parents double"
_SWEPT = pa.schema([*_ROW, ("tables", pa.list_(pa.int64())), ("customers", pa.float64()), ("parents", pa.float64())])


def _swept(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SWEPT)


def by_home(model: Model, number: int, kind: int, contexts: np.ndarray, values: np.ndarray) -> list[dict]:
    """Rows with the numbers of contexts that are not hot for the buckets that have them as words."""
    order = model.cold(contexts)
    home = (contexts[order] % np.uint64(model.buckets)).astype(np.int64)
    names, starts = np.unique(home, return_index=True)
    return [
        {"bucket": int(h), "kind": kind, "grp": number, "a": pack_sorted(contexts[at]), "b": pack(values[at].astype(np.uint32))}
        for h, at in zip(names, np.split(order, starts[1:]) if len(names) else (), strict=True)
    ]


def rows_of(counts: DataFrame, model: Model, kinds, wanted: np.ndarray = ()) -> DataFrame:
    """Of each bucket rows of the wanted kinds: its words' tokens, pairs by context, contexts it seats in, its seats."""

    def make(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bucket, out = Bucket(row["bucket"], row["keys"], row["counts"]), []
                n = bucket.number
                if OWN in kinds:
                    words, values = pack_sorted(bucket.word), pack(bucket.tokens.astype(np.uint32))
                    out.append({"bucket": n, "kind": OWN, "grp": n, "a": words, "b": values})
                if ALL in kinds:
                    asked = unpack_sorted(row["asked"])
                    contexts, at = np.unique(np.concatenate([bucket.klass, asked]), return_inverse=True)
                    out += by_home(model, n, ALL, contexts, np.bincount(at[: len(bucket.klass)], minlength=len(contexts)))
                if SOME in kinds:
                    contexts = np.unique(bucket.klass[bucket.many])
                    out += by_home(model, n, SOME, contexts, np.zeros(len(contexts)))
                if SEATS in kinds:
                    out.append({"bucket": n, "kind": SEATS, "grp": n, "a": bucket.seats(model, wanted).pack()})
                if TOTAL in kinds:
                    hot, at = model.find(bucket.klass)
                    per = np.bincount(at[hot], minlength=len(model.hot)).tolist()
                    out.append({"bucket": n, "kind": TOTAL, "grp": n, "tables": per})
                del bucket
                yield _swept(out)
        tokens.give_back()

    return counts.select("bucket", "keys", "counts", "asked").mapInArrow(make, SWEPT)


def answered(rows: DataFrame, model: Model, kind: int, to: int, sums) -> DataFrame:
    """For every row of kind `to` a row of `kind` with, for each of its contexts, the sums over rows of the named kinds."""

    def answer(batches):
        def done(home, held):
            names = [unpack_sorted(r["a"]) for r in held]
            contexts, at = np.unique(np.concatenate(names), return_inverse=True)
            ends = np.cumsum([len(x) for x in names])
            per = np.zeros((len(sums), len(contexts)), np.int64)
            for row, place in zip(held, np.split(at, ends[:-1]), strict=True):
                values = unpack(row["b"], np.uint32)
                for k, wanted in enumerate(sums):
                    if row["kind"] in wanted:
                        # a row has a context once
                        per[k, place] += values
            for row, place in zip(held, np.split(at, ends[:-1]), strict=True):
                if row["kind"] == to:
                    yield _row(row["grp"], kind, home, pack(per[:, place].astype(np.uint32)))

        current, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != current and held:
                    yield from done(current, held)
                    held = []
                current = row["bucket"]
                held.append(row)
        if held:
            yield from done(current, held)
        tokens.give_back()

    rows = rows.select("bucket", "kind", "grp", "a", "b").repartition(model.buckets, "bucket")
    return stored(rows.sortWithinPartitions("bucket", "kind", "grp").mapInArrow(answer, ROW))


class Replies:
    """Collects rows of `answered` for one bucket, which come in order of kind and home."""

    def __init__(self):
        self.bucket, self.held = None, {}

    def add(self, row: dict, n: int = 1) -> None:
        if row["bucket"] != self.bucket:
            self.bucket, self.held = row["bucket"], {}
        self.held.setdefault(row["kind"], []).append(unpack(row["a"], np.uint32).reshape(n, -1).astype(np.float64))

    def of(self, bucket: int, kinds) -> list[np.ndarray]:
        return [np.concatenate(self.held[k], axis=1) for k in kinds if bucket == self.bucket and k in self.held]


def top_words(counts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and tokens of the words with the most tokens."""
    top = counts.select(F.inline("top")).orderBy(F.desc("n"), "key").limit(n).collect()
    key = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.array([r["n"] for r in top], np.int64)[order]


def swept(counts: DataFrame, model: Model, s: int) -> DataFrame:
    """After sweep s: what seating has added to totals, for the driver and for `answered`; at the last, hot words' lines."""
    wanted = top_words(counts, HOT_WORDS)[0] if s == SWEEPS - 1 else ()

    def sweep(batches):
        replies = Replies()
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] != SEATS:
                    replies.add(row)
                    continue
                seats, n = Seats.unpack(row["a"]), row["bucket"]
                cold = [x[0] for x in replies.of(n, range(ANSWER, ANSWER + s + 1))]
                done = list(seats.sweeps(model, s + 1, cold))
                tables, customers, parents = done[-1]
                added = np.bincount(seats.at, tables - 1, len(seats.contexts)).astype(np.int64)
                hot, place = model.find(seats.contexts)
                per = np.zeros(len(model.hot), np.int64)
                per[place[hot]] = added[hot]
                out = by_home(model, n, SOME, seats.contexts, added)
                out.append({"bucket": n, "kind": TOTAL, "grp": n, "tables": per.tolist(),
                            "customers": float(customers.sum()), "parents": float(parents.sum())})
                if len(wanted):
                    out += lines(seats, model, done[BURN_IN:], n)
                del seats, done, tables, customers, parents
                yield _swept(out)
        tokens.give_back()

    rows = rows_of(counts, model, {SEATS}, wanted).select(ROW_COLUMNS)
    for reply in model.asked:
        rows = rows.unionByName(reply)
    rows = rows.repartition(model.buckets, "bucket").sortWithinPartitions("bucket", "kind", "grp")
    return stored(rows.mapInArrow(sweep, SWEPT))


def lines(seats: Seats, model: Model, kept: list, n: int) -> list[dict]:
    """Of the bucket's hot words: tokens, discounted customers after each hot context, and seats in the parent."""
    key, words_tokens, mine, of, place, among = seats.line
    mean = sum(t for t, _, _ in kept) / len(kept)
    own = np.full(len(of), 1 - model.discounts[1])
    many = among >= 0
    own[many] = seats.counts[among[many]] - model.discounts[1] * mean[among[many]]
    out = []
    for k, n_tokens, w in zip(key.view(np.int64).tolist(), words_tokens.tolist(), mine.tolist(), strict=True):
        line = np.zeros(len(model.hot))
        line[place[of == w]] = own[of == w]
        parent = np.array([n_tokens, *[x[w] for _, c, p in kept for x in (c, p)]], np.float64)
        out.append({"bucket": n, "kind": LINE, "grp": k, "a": pack(line), "b": pack(parent)})
    return out


def train(counts: DataFrame, seed: int = 0, buckets: int = 1) -> Model:
    """Run the sweeps. The driver holds totals of the hot contexts only, and the hot words' seats there."""

    def by_context(df: DataFrame) -> np.ndarray:
        rows = df.select(F.posexplode("tables").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(len(hot))
        for r in rows:
            out[r["at"]] = r["n"]
        return out

    sums = counts.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "tokens", "pairs")],
        *[F.coalesce(F.sum(F.get("ones", F.lit(k))), F.lit(0)).alias(f"n{k}") for k in range(4)],
    ).first()
    discounts = tuple(min(0.95, max(0.05, (sums[a] + 1) / (sums[a] + 2 * sums[b] + 2))) for a, b in (("n0", "n1"), ("n2", "n3")))
    hot, customers = top_words(counts, HOT_CONTEXTS)
    model = Model(sums["words"], sums["tokens"], hot, customers, discounts, [], seed, buckets)
    first = by_context(rows_of(counts, model, {TOTAL}))
    model.totals.append(Totals(first, float(sums["pairs"]), float(sums["words"])))
    # words beyond the hot ones are contexts as well
    cold = sums["words"] > len(hot)
    added = rows_of(counts, model, {ALL, SOME}).select(ROW_COLUMNS)
    sweeps = []
    for s in range(SWEEPS):
        if cold:
            model.asked.append(answered(added, model, ANSWER + s, SOME, [(ALL, SOME)]))
        sweeps.append(swept(counts, model, s))
        added = sweeps[-1].filter(F.col("kind") == SOME).select(ROW_COLUMNS)
        total = sweeps[-1].agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("customers", "parents")]).first()
        model.totals.append(Totals(first + by_context(sweeps[-1]), total[0], total[1]))
    if cold:
        rows, sums = rows_of(counts, model, {OWN, ALL}).select(ROW_COLUMNS), [(OWN,)]
        for k, df in enumerate(sweeps[BURN_IN:]):
            more = df.filter(F.col("kind") == SOME).select(ROW_COLUMNS)
            rows = rows.unionByName(more.withColumn("kind", F.lit(SOME + k)))
            sums.append((ALL, SOME + k))
        model.last = answered(rows, model, ANSWER + SWEEPS, ALL, sums)
    model.lines = sweeps[-1].filter(F.col("kind") == LINE)
    return model


def hot_table(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words with the most tokens: hash, tokens, and log10 probability after each hot context."""
    # HOT_WORDS rows of HOT_CONTEXTS numbers
    found = sorted(model.lines.select("grp", "a", "b").collect(), key=lambda r: np.int64(r["grp"]).view(np.uint64))
    after, tokens_of, table = model.totals[BURN_IN + 1 :], [], []
    for r in found:
        n, *seats = unpack(r["b"], np.float64)
        parent = np.array([[model.parent(t, c, p)] for t, c, p in zip(after, seats[::2], seats[1::2], strict=True)])
        tokens_of.append(n)
        table.append(np.log10(probability(model, unpack(r["a"], np.float64), model.hot, parent)))
    return (
        np.array([r["grp"] for r in found], np.int64).view(np.uint64),
        np.array(tokens_of),
        np.array(table).reshape(len(found), len(model.hot)),
    )


def probability(model: Model, own: np.ndarray, context: np.ndarray, parent: np.ndarray, cold=None) -> np.ndarray:
    """Probability averaged over the samples; `own` are mean discounted customers, `parent` has a row per sample."""
    customers, tables = model.restaurants(context, cold)
    left = (STRENGTH[1] + model.discounts[1] * tables) / (STRENGTH[1] + customers)
    return own / (STRENGTH[1] + customers) + (left * parent).mean(axis=0)


def score_texts(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """`docs` (doc_id, held_out, text) with n_tokens, n_known, base_score and score."""
    kind, buckets = dict(docs.dtypes)["doc_id"], model.buckets
    shared = docs.sparkSession.sparkContext.broadcast(hot_table(model))

    def deal(batches):
        hot_key, hot_tokens, hot_log = shared.value
        for number, group in enumerate(groups(batches)):
            name = (TaskContext.get().partitionId() << 32) + number
            parts = [token_rows(p.column("text")) for p in group]
            starts = np.cumsum([0, *[p.num_rows for p in group]])
            word, context = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            text = np.concatenate([p[2] + s for p, s in zip(parts, starts, strict=False)])
            texts = int(starts[-1])
            hot, sums = np.zeros(len(word), bool), [np.zeros(texts)] * 3
            if len(hot_key):
                at = np.minimum(np.searchsorted(hot_key, word), len(hot_key) - 1)
                hot, place = model.find(context)
                hot &= hot_key[at] == word
                w = at[hot]
                values = (hot_log[w, place[hot]], model.base(hot_tokens[w]), None)
                sums = [np.bincount(text[hot], x, texts) for x in values]
            head = pa.Table.from_batches([p.select(["doc_id", "held_out"]) for p in group]).combine_chunks()
            head = head.append_column("n_tokens", pa.array(np.bincount(text, minlength=texts), pa.int64()))
            for column, x in zip(("score", "base", "known"), sums, strict=True):
                head = head.append_column(column, pa.array(x, pa.float64()))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as writer:
                writer.write_table(head)
            yield _row(number % buckets, HEAD, name, sink.getvalue().to_pybytes())
            word, context, text = word[~hot], context[~hot], text[~hot].astype(np.uint32)
            for bucket, at in dealt(word, context, buckets):
                yield _row(bucket, TOKENS, name, pack_pairs(word[at], context[at]), pack(text[at]))

    def look_up(batches):
        replies, ready = Replies(), None
        after = model.totals[BURN_IN + 1 :]
        nothing = np.array([[float(model.parent(t, 0.0, 0.0))] for t in after])
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] < KEYS:
                    replies.add(row, 1 + len(after) if row["kind"] == ANSWER + SWEEPS else 1)
                elif row["kind"] == KEYS:
                    ready = None
                    bucket = Bucket(row["bucket"], row["a"], row["b"])
                    seated = [x[0] for x in replies.of(bucket.number, range(ANSWER, ANSWER + SWEEPS))]
                    contexts = np.unique(np.concatenate([bucket.klass, unpack_sorted(row["c"])]))
                    order, cold = model.cold(contexts), None
                    if last := replies.of(bucket.number, [ANSWER + SWEEPS]):
                        by = np.argsort(order)
                        cold = contexts[order[by]], last[0][:, by]
                    replies = Replies()
                    ready = (row["bucket"], bucket, bucket.index(), cold, *bucket.samples(model, seated))
                elif row["kind"] == HEAD:
                    yield _row(0, 2, row["grp"], row["a"])
                else:
                    (word, context), text = unpack_pairs(row["a"]), unpack(row["b"], np.uint32)
                    own, tokens_of, cold = np.zeros(len(word)), np.zeros(len(word)), None
                    parent = np.repeat(nothing, len(word), axis=1)
                    # without a row of its own a bucket has no words
                    if ready is not None and ready[0] == row["bucket"]:
                        _, bucket, find, cold, seated, parents = ready
                        at, pair = find(word, context)
                        own[pair >= 0] = seated[pair[pair >= 0]]
                        tokens_of[at >= 0] = bucket.tokens[at[at >= 0]]
                        parent[:, at >= 0] = parents[:, at[at >= 0]]
                    values = (
                        np.log10(probability(model, own, context, parent, cold)), model.base(tokens_of), tokens_of > 0
                    )
                    names, place = np.unique(text, return_inverse=True)
                    sums = [np.bincount(place, x, len(names)) for x in values]
                    yield _row(
                        row["bucket"], 3, row["grp"], pack(names), pack(sums[0]), pack(sums[1]), pack(sums[2])
                    )
        tokens.give_back()

    def finish(batches):
        current, head, sums = None, None, None

        def done():
            out = head.drop_columns(["score", "base", "known"])
            out = out.append_column("n_known", pa.array(sums[2].round().astype(np.int64)))
            out = out.append_column("base_score", pa.array(sums[1])).append_column("score", pa.array(sums[0]))
            return out.to_batches()

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 2:
                    if head is not None:
                        yield from done()
                    current, head = row["grp"], pa.ipc.open_stream(row["a"]).read_all()
                    sums = [head.column(c).to_numpy().copy() for c in ("score", "base", "known")]
                else:
                    assert row["grp"] == current
                    at = unpack(row["a"], np.uint32)
                    for x, c in zip(sums, "bcd", strict=True):
                        x[at] += unpack(row[c], np.float64)
        if head is not None:
            yield from done()

    none = F.lit(None).cast("binary")
    seats = counts.select(
        "bucket", F.lit(KEYS).alias("kind"), F.lit(0).cast("long").alias("grp"),
        F.col("keys").alias("a"), F.col("counts").alias("b"), F.col("asked").alias("c"), none.alias("d"),
    )
    rows = docs.select("doc_id", "held_out", "text").mapInArrow(deal, ROW).unionByName(seats)
    for reply in [*model.asked, *([model.last] if model.last else [])]:
        rows = rows.unionByName(reply)
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "grp")
    found = rows.mapInArrow(look_up, ROW).repartition("grp").sortWithinPartitions("grp", "kind", "bucket")
    return found.mapInArrow(
        finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )


def with_scores(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs`.

    `held_out` is a column expression; rows for which it is false are learned from. Tokens are the text's words, A-Z
    lower-cased, and an end. `score` is the model's log10 probability of the tokens; an unseen word shares the mass of
    one word in the uniform base. `base_score` is that of single words with 0.5 added to each count. A null text is an
    empty one: its end is its only token. Rows that share an id are scored each by its own text. Extra columns are
    ignored. Without rows to learn from every word is unseen. Words are compared by hash.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    buckets = text_bytes(docs) // BUCKET_BYTES + 1
    counts = stored(pair_counts(docs, buckets))
    model = train(counts, buckets=buckets)
    scored = score_texts(docs, counts, model)
    return scored.withColumn("train_tokens", F.lit(int(model.tokens)).cast("long"))


def perplexity(scored: DataFrame) -> DataFrame:
    """Per fold (held_out), perplexity per token of the model and of the base."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_scores(documents(spark, sf_dir).select("doc_id", "text"), fold(F.col("doc_id")) == 1)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
