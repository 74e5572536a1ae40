"""Splits by time: exact row counts without a global sort or any row ranks.

A cut position is located by counting rows per day, then per second and per instant of the
boundary day, then per hash slice of the boundary instant. Each step is an aggregation that Spark
combines before its shuffle, and hands a handful of numbers to the next step as literals, so the
later scans are pruned to the boundary days. Rows are then labelled by comparing them with the
located cuts: the facts themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000
SECOND = 1_000_000
NEVER = 2**62  # stands for a missing time, which sorts last
SLICE_DIGITS = 4  # 65 536 slices of the rows of one instant
HASH_DIGITS = 32


@dataclass(frozen=True)
class Cut:
    """Rows at or after (time, hash) lie behind the cut; `rest` rows are still to be skipped."""

    at: int
    until: int
    mix: str = ""
    rest: int = 0

    def passed(self, at: Column, mixed: Column) -> Column:
        return (at > self.at) | ((at == self.at) & (mixed >= self.mix))


def _order(date: str, tie: Sequence[str]) -> tuple[Column, Column]:
    at = F.coalesce(F.unix_micros(F.col(date).cast("timestamp")), F.lit(NEVER))
    mixed = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in tie]))
    return at, mixed


def _place(counts: DataFrame, level: str, rest: Column) -> DataFrame:
    """Rows of `counts` (cut, level, n) that hold position `rest`, with the position inside."""
    order = Window.partitionBy("cut").orderBy(level)
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.col("upto") - F.col("n")
    return (
        counts.withColumn("upto", upto)
        .withColumn("rest", rest - before)
        .filter((F.col("rest") >= 0) & (F.col("rest") < F.col("n")))
        .select("cut", level, "rest")
    )


def _first_cuts(df: DataFrame, at: Column, positions: Column) -> dict[int, Cut]:
    # one row per calendar day, so the running sum over all of them is short
    days = df.groupBy(F.floor(at / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n_day"))
    everything = Window.partitionBy(F.lit(1))
    sized = days.withColumn("n", F.sum("n_day").over(everything))
    spread = sized.select("day", F.col("n_day").alias("n"), F.posexplode(positions)).select(
        F.col("pos").alias("cut"), "day", "n", F.col("col").alias("position")
    )
    found = _place(spread, "day", F.col("position")).collect()
    return {r.cut: Cut(r.day * DAY, (r.day + 1) * DAY, rest=r.rest) for r in found}


def _refine(
    df: DataFrame, date: str, at: Column, mixed: Column, cuts: dict[int, Cut], level: Column
) -> dict[int, object]:
    first, last = min(c.at for c in cuts.values()), max(c.until for c in cuts.values())
    near = F.col(date).isNull()
    if first < NEVER - DAY:
        stop = min(last, NEVER - DAY)
        near = near | (
            (F.col(date) >= F.timestamp_micros(F.lit(first)))
            & (F.col(date) < F.timestamp_micros(F.lit(stop)))
        )
    held = F.array(
        *[
            F.struct(
                F.lit(k).alias("cut"),
                F.lit(c.at).alias("at"),
                F.lit(c.until).alias("until"),
                F.lit(c.mix).alias("mix"),
                F.lit(c.rest).cast("long").alias("rest"),
            )
            for k, c in cuts.items()
        ]
    )
    mine = F.filter(
        held, lambda c: (at >= c["at"]) & (at < c["until"]) & mixed.startswith(c["mix"])
    )
    rows = df.filter(near).select(F.inline(F.transform(mine, lambda c: F.struct(
        c["cut"].alias("cut"), c["rest"].alias("target"), level.alias("level")
    ))))
    counts = rows.groupBy("cut", "target", "level").agg(F.count(F.lit(1)).alias("n"))
    return {r.cut: r for r in _place(counts, "level", F.col("target")).collect()}


def rank_cuts(df: DataFrame, date: str, tie: Sequence[str], positions: Column) -> list[Cut | None]:
    """First row at or after each position, in the order (time, hash of tie).

    `positions` is an array expression over the total row count `n`; None stands for a position
    at or past the end. (date, tie) should identify a row, as (week_start, field_id) does.
    """
    at, mixed = _order(date, tie)
    cuts = _first_cuts(df, at, positions)
    for step in (SECOND, 1):
        still = {k: c for k, c in cuts.items() if c.rest}
        if still:
            for k, r in _refine(df, date, at, mixed, still, F.floor(at / step)).items():
                cuts[k] = Cut(r.level * step, (r.level + 1) * step, rest=r.rest)
    for digits in (SLICE_DIGITS, HASH_DIGITS):
        still = {k: c for k, c in cuts.items() if c.rest}
        if still:
            prefix = F.substring(mixed, 1, digits)
            for k, r in _refine(df, date, at, mixed, still, prefix).items():
                cuts[k] = replace(cuts[k], mix=r.level, rest=r.rest)
    return [cuts.get(k) for k in range(max(cuts, default=-1) + 1)]


def label_by_cuts(
    df: DataFrame, cuts: Sequence[Cut | None], date: str, tie: Sequence[str], out: str
) -> DataFrame:
    """Number of cuts at or before each row, from literal comparisons."""
    at, mixed = _order(date, tie)
    passed = F.lit(0)
    for cut in cuts:
        if cut is not None:
            passed = passed + F.when(cut.passed(at, mixed), 1).otherwise(0)
    return df.withColumn(out, passed)


def temporal_split(
    df: DataFrame,
    date: str = "week_start",
    test_ratio: float = 0.2,
    tie: Sequence[str] = ("field_id",),
    whole_weeks: bool = False,
) -> DataFrame:
    """Adds `split`: the oldest `int(n * (1 - test_ratio))` rows are `train`, the rest `test`.

    `whole_weeks` moves the cut to the start of its instant, so no week is on both sides.
    """
    size = F.array(F.floor(F.col("n") * F.lit(1 - test_ratio)))
    cuts = rank_cuts(df, date, tie, size)
    if whole_weeks:
        cuts = [replace(c, mix="") for c in cuts if c]
    labelled = label_by_cuts(df, cuts, date, tie, "_passed")
    return labelled.withColumn(
        "split", F.when(F.col("_passed") == 0, "train").otherwise("test")
    ).drop("_passed")


def time_folds(
    df: DataFrame, n_folds: int = 5, date: str = "week_start", tie: Sequence[str] = ("field_id",)
) -> DataFrame:
    """Adds `fold`: 0 for rows that only train, k for rows tested in fold k (1 … n_folds).

    Fold k trains on every row with a smaller `fold`. Each test part has n // (n_folds + 1) rows.
    """
    part = F.floor(F.col("n") / (n_folds + 1))
    starts = F.array(*[F.col("n") - part * (n_folds - k) for k in range(n_folds)])
    return label_by_cuts(df, rank_cuts(df, date, tie, starts), date, tie, "fold")


def fold_parts(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold."""
    return folded.filter(F.col("fold") < fold), folded.filter(F.col("fold") == fold)
