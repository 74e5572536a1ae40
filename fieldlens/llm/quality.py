"""Quality rules as a short-circuit cascade, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.shared import documents

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
# the cascade's order is estimated on so many rows, drawn by a hash of id and text; it never changes a verdict
SAMPLE_ROWS = 2_000


def words(text: str) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    inner = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), rf"^{BLANKS}|{BLANKS}$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANKS, -1))


def duplicate_lines(text: str) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(w: Column, k: int = 3) -> Column:
    """Words of an array that lie in a k-word window found at least twice in it.

    Each window is its hash of 64 bits and its position. Once sorted, equal windows are neighbours. The sum over the
    positions that repeat, in order, of the distance to the next, k at most, counts the words they cover. Time grows as
    n log n with the length.
    """
    n = F.size(w)
    windows = F.transform(
        F.sequence(F.lit(0), n - k), lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(k)]).alias("h"), i.alias("i"))
    )
    found = F.transform(
        F.array(F.sort_array(windows)),
        lambda s: F.sort_array(
            F.filter(
                F.transform(
                    s,
                    lambda x, i: F.when(
                        (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        ),
    )
    covered = F.transform(
        found,
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(k)), F.lit(k))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
    )
    return F.when(n < k + 1, F.lit(0)).otherwise(F.get(covered, F.lit(0))).cast("long")


def counts(text: str) -> dict[str, Column]:
    """What the rules read, each as an expression of the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    split = F.array(words(text))
    return {
        "n_words": F.size(words(text)).cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, BLANKS, "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": F.get(F.transform(split, lambda w: repeated_words(w)), F.lit(0)),
        "n_lines": F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("long"),
        "n_capitals": F.regexp_count(whole, F.lit("[A-Z]")).cast("long"),
        "n_small": F.regexp_count(whole, F.lit("[a-z]")).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """`reject` is a condition over the counts named in `reads`; it is never null."""

    name: str
    reads: tuple[str, ...]
    reject: object

    def on(self, count: dict[str, Column]) -> Column:
        return self.reject(*[count[name] for name in self.reads])


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 50 * n),
)
# limits wide enough for lists, tables and headings in running text
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > n),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 2 * d > n),
    Rule("capitals", ("n_capitals", "n_small"), lambda c, s: c > s),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 15 * n)),
)


def _now() -> Column:
    """The JVM's clock in nanoseconds, read where the expression stands in a row."""
    return F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


def estimate(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """For each rule its share rejected and its cost: the middle of the nanoseconds it takes for a row of a sample.

    One job runs all rules row by row and reads the clock between them, so neither jobs nor scans are in the cost. The
    sample is drawn by a hash of the text and has about `sample_rows` rows of any size of input; it orders the rules and
    decides nothing else. Without rows every rule rejects nothing.
    """
    every = max(1, docs.count() // sample_rows)
    sample = docs.select(text).filter(F.pmod(F.xxhash64(F.lit(11), text), F.lit(every)) == 0)
    steps = [_now().alias("t0")]
    for k, rule in enumerate(rules):
        steps += [rule.on(counts(text)).alias(f"r{k}"), _now().alias(f"t{k + 1}")]
    timed = sample.select(F.struct(*steps).alias("s"))
    took = [F.col(f"s.t{k + 1}") - F.col(f"s.t{k}") for k in range(len(rules))]
    found = timed.agg(
        F.count("*").alias("n"),
        *[F.percentile_approx(took[k], F.lit(0.5)).alias(f"c{k}") for k in range(len(rules))],
        *[F.count_if(F.col(f"s.r{k}")).alias(f"h{k}") for k in range(len(rules))],
    ).first()
    rows = max(1, found["n"])
    return [
        {"rule": rule, "rejects": found[f"h{k}"] / rows, "cost": float(found[f"c{k}"] or 0)}
        for k, rule in enumerate(rules)
    ]


def by_rejection_per_cost(estimates: list[dict]) -> list[Rule]:
    order = sorted(estimates, key=lambda e: (-(e["rejects"] / max(e["cost"], 1.0)), e["cost"]))
    return [e["rule"] for e in order]


def verdict(rules, count: dict[str, Column]) -> Column:
    """Name of the first rule that rejects, or null. A later rule is not evaluated once one has rejected."""
    out = F
    for rule in rules:
        out = out.when(rule.on(count), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def cascade(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add `rejected_by`: the first rule to reject, in the estimated order; null where all pass.

    A null or empty text has no words. The order may differ between runs, so `rejected_by` may name another of the
    rules that reject a row; whether it is null may not. A column of that name is replaced; all others stay.
    """
    order = by_rejection_per_cost(estimate(docs, rules, text, sample_rows))
    return docs.withColumn("rejected_by", verdict(order, counts(text)))


BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_counts(docs: DataFrame, text: str = "text", names=BASE_COUNTS) -> DataFrame:
    """Add the named counts; columns of these names are replaced, all others stay.

    A null, empty or blank text has none of anything. Every row is counted by itself: repeated rows get equal counts, an
    empty table none.
    """
    named = counts(text) | {"n_words": F.size("_words").cast("long"), "n_repeat_words": repeated_words(F.col("_words"))}
    return docs.withColumn("_words", words(text)).withColumns({c: named[c] for c in names}).drop("_words")


def judged(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add the base counts and `rejected_by`, as `cascade` does.

    Base counts are asked for in any case. What other counts a rule reads is counted within its step, so only for rows
    that no earlier rule has rejected.
    """
    order = by_rejection_per_cost(estimate(docs, rules, text, sample_rows))
    known = counts(text) | {c: F.col(c) for c in BASE_COUNTS}
    return with_counts(docs, text).withColumn("rejected_by", verdict(order, known))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(documents(spark, sf_dir).select("doc_id", "text"))
    known = {c: F.col(c) for c in BASE_COUNTS}
    failed = BASE_RULES[0].on(known) | BASE_RULES[1].on(known)
    return found.select(
        "doc_id", *BASE_COUNTS, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept")
    )
