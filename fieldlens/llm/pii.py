"""Personal data: spans of fixed formats, and further ones that boosted trees find likely.

Generators propose spans with high recall; they may overlap. Trees read a span's format and what stands around it, but
not the marks that only the fixed formats have (the plus sign, the @, single dots or blanks). So they score a span in
another spelling as they score the plain one. They learn from the texts themselves: spans of fixed format are examples,
also in other spellings put in their place, and all other proposals are counterexamples.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import tokens
from fieldlens.llm.shared import documents
from fieldlens.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH = 20, 4
# a span is added if so large a share of held-out examples with its score or a higher one is right
CONFIDENCE = 0.98
# held-out examples and counterexamples that a threshold needs
SEEN = 30
AROUND = 24
# examples that a task holds at once
EXAMPLE_ROWS = 2_000

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# proposals: runs of digits and separators, numbers parted by dots, and addresses with a written-out @ or dot
DIGITS = re.compile(r"[(+]?[0-9](?:[\x20().\-/]{0,3}+[0-9])++")
PARTS = re.compile(r"(?<![0-9])[0-9]++(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]++){3}")
AT = re.compile(r"@|\x20?[\[(](?:at|AT)[\])]\x20?|\x20(?:at|AT)\x20")
FAR_DOMAIN = re.compile(
    r"[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]{1,63}+)++"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses; each @ is looked at once, so a long word costs no more than its length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            # no address reaches back over an @
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed formats, by kind as listed, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        # four digits or more may be zeros before a small number
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(only_digits(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all that might be personal data; a run of digits is proposed as each kind it may be."""
    out = set()
    for m in AT.finditer(text):
        start = m.start()
        while start and m.start() - start < 64 and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = FAR_DOMAIN.match(text, m.end()) if start < m.start() else None
        if found:
            out.add((0, start, found.end()))
    out.update((1, *m.span()) for m in PARTS.finditer(text))
    for m in DIGITS.finditer(text):
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer("[0-9]+", m.group())]
        sizes = np.cumsum([0, *[b - a for a, b in groups]]).tolist()
        lead = m.start() if text[m.start()] in "(+" else None
        for i in range(len(groups)):
            start = lead if not i and lead is not None else groups[i][0]
            if i and text[start - 1] == "(":
                start -= 1
            # a span of 19 digits at most has 19 groups at most
            for j in range(i, min(i + 19, len(groups))):
                n = sizes[j + 1] - sizes[i]
                if n > 19:
                    break
                if 7 <= n <= 15:
                    out.add((3, start, groups[j][1]))
                if 13 <= n:
                    out.add((2, groups[i][0], groups[j][1]))
    return sorted(out)


CUES = (
    ("mail", "contact", "write to"), ("ip", "host", "server", "addr"), ("card", "visa", "credit", "pay"),
    ("tel", "phone", "call", "fax", "mobile"), ("token", "key", "hash", "secret"), ("version", "license", " v", "no."),
)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Numbers about a span's format and about the text within 24 characters of it."""
    span = text[start:end]
    digits = only_digits(span)
    groups = re.findall("[0-9]+", span.removeprefix("+").replace("(", " "))
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    left, right = before[-1:], after[:1]
    low = before.lower()
    spelt = re.split(r"[\x20()\[\]]*(?:@|\bat\b|\bAT\b|\bdot\b|\bDOT\b|\.)[\x20()\[\]]*", span) if not kind else []
    near = before + after
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(len(groups[0])) if groups else 0.0,
        float(digits[:1] or -1),
        float(len(set(digits))),
        float(luhn(digits)),
        float(max((len(g.lstrip("0")) > 3 or int(g.lstrip("0") or 0) > 255 for g in groups), default=False)),
        float(sum(c.isalpha() for c in span)),
        float(len(spelt)),
        float(len(spelt[-1])) if spelt else 0.0,
        float(len(spelt[0])) if spelt else 0.0,
        float(left.isalnum()),
        float(right.isalnum()),
        float(left.isspace() or not left),
        float(right.isspace() or not right),
        float(left in "\"'=#/_") if left else 0.0,
        float(right in "\"'%#/_") if right else 0.0,
        sum(c.isdigit() for c in near) / max(1, len(near)),
        sum(c.isupper() for c in near) / max(1, len(near)),
        sum(not c.isalnum() and not c.isspace() for c in near) / max(1, len(near)),
        *[float(any(c in low for c in cues)) for cues in CUES],
    ]


WIDTH = len(features("", 0, 0, 0))


def respelt(kind: int, span: str, turn: int) -> str:
    """The same datum as some people write it; `turn` chooses how."""
    if kind == 0:
        local, domain = span.split("@", 1)
        at, dot = ((" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "))[turn % 3]
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return span.replace(".", ("[.]", " . ", "(.)")[turn % 3])
    digits = only_digits(span)
    if kind == 2:
        return (" ", "-", ".")[turn % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own = digits[-10:] if len(digits) > 10 else digits
    return (f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}-{own[3:6]}-{own[6:]}", f"{own[:3]}.{own[3:6]}.{own[6:]}")[
        turn % 3
    ]


def overlaps(a, b) -> bool:
    return a[1] < b[2] and b[1] < a[2]


def examples(text: str) -> Iterator[tuple[int, int, list[float]]]:
    """(kind, label, features): fixed formats, each in one other spelling too, and the proposals that touch none."""
    base = base_spans(text)
    for k, a, b in base:
        yield k, 1, features(text, k, a, b)
        other = respelt(k, text[a:b], a)
        near = text[max(0, a - AROUND) : a]
        changed = near + other + text[b : b + AROUND]
        yield k, 1, features(changed, k, len(near), len(near) + len(other))
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
    for p in proposals(text):
        i = int(np.searchsorted(starts, p[2]))
        if not i or reach[i - 1] <= p[1]:
            yield p[0], 0, features(text, *p)


@dataclass(frozen=True)
class Trees:
    """Boosted trees as arrays: a node splits on `feature` at `cut` or, where `feature` is -1, holds `value`."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    root: np.ndarray
    weight: np.ndarray
    # the least margin that is added, by kind
    least: tuple[float, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root, weight in zip(self.root, self.weight, strict=True):
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                right = x[rows, np.maximum(self.feature[at], 0)] > self.cut[at]
                at = np.where(inner, self.child[at, right.astype(int)], at)
            total += weight * self.value[at]
        return total


def _arrays(model) -> dict:
    """The trees of a fitted classifier as arrays."""
    feature, cut, child, value, root = [], [], [], [], []

    def add(node) -> int:
        at = len(feature)
        leaf = node.numDescendants() == 0
        feature.append(-1 if leaf else node.split().featureIndex())
        cut.append(0.0 if leaf else node.split().threshold())
        value.append(node.prediction())
        child.append([at, at])
        if not leaf:
            child[at] = [add(node.leftChild()), add(node.rightChild())]
        return at

    for tree in model.trees:
        root.append(add(tree._java_obj.rootNode()))
    return {
        "feature": np.array(feature), "cut": np.array(cut), "child": np.array(child), "value": np.array(value),
        "root": np.array(root), "weight": np.array(model.treeWeights),
    }


def pooled(rows) -> list[list]:
    """Isotonic regression of (margin, examples, right ones), margins rising: neighbours are pooled until shares rise.

    Pools of parts that are pooled again are those of the whole.
    """
    pools = []
    for row in rows:
        pools.append(list(row))
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, n, s = pools.pop()
            pools[-1][1] += n
            pools[-1][2] += s
    return pools


def surest(pools: list, confidence: float = CONFIDENCE, seen: int = SEEN) -> float:
    return next((float(v) for v, n, s in pools if s >= confidence * n and n >= seen), math.inf)


def least_margin(margin: np.ndarray, label: np.ndarray, confidence: float = CONFIDENCE, seen: int = SEEN) -> float:
    """The least margin whose calibrated probability reaches `confidence`.

    Margins are calibrated by isotonic regression: neighbours are pooled until the share of examples rises with the
    margin. Where fewer than `seen` examples are that sure nothing is sure enough.
    """
    values, first = np.unique(margin, return_inverse=True)
    return surest(pooled(zip(values, np.bincount(first), np.bincount(first, label), strict=True)), confidence, seen)


def fit(docs: DataFrame, text: str = "text") -> Trees | None:
    """Learn from all texts; None if they give no examples of both labels.

    Three quarters of the texts grow the trees, the rest calibrates them. Equal texts are on one side.
    """
    drawn = docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull())
    drawn = drawn.select((F.pmod(F.xxhash64(F.lit(31), "text"), F.lit(4)) == 0).alias("held"), "text")
    schema = pa.schema([("held", pa.bool_()), ("kind", pa.int32()), ("label", pa.float64()),
                        ("x", pa.list_(pa.float64()))])

    def extract(batches):
        for batch in batches:
            for piece in tokens.pieces(batch):
                rows = (
                    {"held": held, "kind": k, "label": float(label), "x": x}
                    for held, t in zip(piece.column("held").to_pylist(), piece.column("text").to_pylist(), strict=True)
                    for k, label, x in examples(t)
                )
                while some := list(itertools.islice(rows, EXAMPLE_ROWS)):
                    yield pa.RecordBatch.from_pylist(some, schema=schema)

    rows = cut_lineage(drawn.mapInArrow(extract, "held boolean, kind int, label double, x array<double>"))
    grow = rows.filter(~F.col("held")).withColumn("features", array_to_vector("x"))
    if grow.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    booster = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.2, minInstancesPerNode=5, seed=7)
    trees = _arrays(booster.fit(grow.select("features", "label")))
    return Trees(**trees, least=thresholds(rows.filter("held"), Trees(**trees, least=())))


def thresholds(held: DataFrame, trees: Trees) -> tuple[float, ...]:
    """The least margin that is added, by kind, from held-out examples (kind, label, x).

    Tasks pool ranges of margins. Shares of pools rise, so there are far fewer pools than examples.
    """

    def judge(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kind"), batch.column("label"), pa.array(trees.margin(x))], ["kind", "label", "margin"]
                )

    def pool(batches):
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for of, own in itertools.groupby(rows, lambda r: r[0]):
            pools = [[of, *p] for p in pooled(r[1:] for r in own)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pools, strict=True)], ["of", "margin", "n", "s"])

    everything = len(KINDS)
    judged = held.select("kind", "label", "x").mapInArrow(judge, "kind int, label double, margin double")
    judged = judged.withColumn("of", F.explode(F.array("kind", F.lit(everything))))
    counted = judged.groupBy("of", "margin").agg(F.count("*").alias("n"), F.sum("label").alias("s"))
    counted = counted.select(F.col("of").cast("long"), "margin", "n", "s")
    counted = cut_lineage(counted).repartitionByRange("of", "margin").sortWithinPartitions("of", "margin")
    found = [[] for _ in range(everything + 1)]
    for r in sorted(counted.mapInArrow(pool, "of long, margin double, n long, s double").collect()):
        found[r["of"]].append(r[1:])
    own = [surest(pooled(rows)) for rows in found]
    wrong = [sum(n - s for _, n, s in rows) for rows in found]
    # a kind with few counterexamples of its own has to pass those of all kinds as well
    whole = own[everything] if wrong[everything] >= SEEN else math.inf
    return tuple(max(own[k], whole) if wrong[k] < SEEN else own[k] for k in range(everything))


def added_spans(texts: list[str], base: list[list], model: Trees) -> list[list[tuple[int, int, int]]]:
    """For each text the proposals sure enough that touch no base span, the surest first and none that overlap."""
    places, x = [], []
    for i, text in enumerate(texts):
        taken = sorted((a, b) for _, a, b in base[i])
        starts = [a for a, _ in taken]
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
        for p in proposals(text):
            j = int(np.searchsorted(starts, p[2])) if taken else 0
            if math.isfinite(model.least[p[0]]) and (not j or reach[j - 1] <= p[1]):
                places.append((i, p))
                x.append(features(text, *p))
    out = [[] for _ in texts]
    if not places:
        return out
    margin = model.margin(np.array(x))
    sure = [(-m, p[1] - p[2], p, i) for m, (i, p) in zip(margin, places, strict=True) if m >= model.least[p[0]]]
    held = [set() for _ in texts]
    for *_, p, i in sorted(sure):
        # a span is short, but for blanks in a run of digits
        if not any(c in held[i] for c in range(p[1], p[2])):
            held[i].update(range(p[1], p[2]))
            out[i].append(p)
    return out


SPANS = "array<struct<kind:int,start:int,end:int,base:boolean>>"


def find_personal_data(docs: DataFrame, model: Trees | None, text: str = "text") -> DataFrame:
    """Add `spans`: (kind, start, end, base) in code points, end exclusive, by kind as listed, then start.

    A null or empty text has none. Without a model only spans of fixed format are found. A column named spans is
    replaced; all others stay. Every row is read by itself: repeated rows get equal spans.
    """

    # a model of some hundred nodes travels with the function
    @F.arrow_udf(SPANS)
    def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(
            pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        )
        for column in columns:
            out = []
            for piece in tokens.pieces(pa.RecordBatch.from_arrays([column], ["text"])):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, model) if model else [[]] * len(texts)
                for own, added in zip(base, more, strict=True):
                    spans = sorted([(*s, True) for s in own] + [(*s, False) for s in added])
                    out.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans])
            yield pa.array(out, kind)

    return docs.withColumn("spans", find(F.col(text)))


def redacted(text: str = "text", spans: str = "spans"):
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    names = list(KINDS)

    @F.arrow_udf("string")
    def put(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for s in sorted(own or [], key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"<{names[s['kind']]}>"]
                at = max(at, s["end"])
            out.append("".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    return put(F.col(text), F.col(spans))


def listed(spans):
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def of_kind(spans, kind: int):
    """How many spans are of a kind."""
    # a second parameter of the lambda would be the place in the array
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find_personal_data(docs, fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    counts = [of_kind("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", base.alias("base"), "spans").select(
        "doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )
