"""Mix sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.llm.shared import documents
from fieldlens.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
SEED = 7
# rows that a task sums up in order
SLICE_ROWS = 4_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int = SEED) -> Column:
    """The number by which the rows of a source are shuffled."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def cyclic_weight(place: Column) -> Column:
    """1, 2, 3, repeating."""
    return place % 3 + 1


def source_targets(sized: DataFrame, weight=cyclic_weight, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target.

    The sources, in code point order and null last, share the size of all documents by weight. A share stops at
    `max_repeats` times its source's size and the excess is shared by weight among the others, until none is above.
    In the order of limit / weight the sources that stop come first, and one stops if its limit / weight is not above
    the level that all from it on would share; so running sums settle all rounds at once.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # from here on there is one row per source
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    limit = (F.col("source_size") * max_repeats).cast("double")
    per = per.withColumn("place", place).withColumn("limit", limit)
    per = per.withColumn("weight", weight(F.col("place")).cast("double"))
    per = per.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", "place")
    spent = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    waiting = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything) - spent) / waiting)
    shares = F.col("ratio") > F.col("level")
    shared = F.min(F.when(shares, F.struct("ratio", "place", "level"))).over(everything)["level"]
    per = per.withColumn("shared", shared)
    target = F.when(shares, F.col("weight") * F.col("shared")).otherwise(F.col("limit"))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weight=cyclic_weight, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """Every row of `docs` (doc_id, source, text) with size, source_size, target, copies, taken and finishes.

    Each source is shuffled by a hash of seed, id and text. A copy of a document finishes at the tokens of its source
    up to and with it, divided by the source's target. All copies are cut into ranges of that time, in order, and taken
    until the budget, the size of all documents, is used up. `finishes` holds the finish times of the copies taken:
    exploding it and sorting by it gives the stream in the order of the mix. `draw` names the id and text of a row.

    Null texts have size 0, and so has the null source's share if all its texts are null; null is a source of its own.
    Rows of equal id and text are separate documents of equal rank. Of `docs` the three columns are read, whatever else
    there is. An empty table gives an empty one.
    """
    sized = docs.select(
        "doc_id",
        "source",
        word_count("text").alias("size"),
        draw(seed).alias("draw"),
        F.monotonically_increasing_id().alias("row"),
    )
    # read once: the passes below take these narrow rows
    sized = cut_lineage(sized)
    rows = sized.count()
    slices = max(1, rows // SLICE_ROWS)

    # running sum within each source: of slices of the shuffled order, then within a slice
    part = F.floor((F.col("draw") / F.lit(2.0**64) + 0.5) * slices)
    cut = sized.withColumn("slice", F.least(part, F.lit(slices - 1)).cast("int"))
    sums = cut.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("slice_size").over(up_to), F.lit(0)))
    sums = sums.withColumnsRenamed({"source": "s_source", "slice": "s_slice"}).drop("slice_size")
    targets = cut_lineage(source_targets(sized, weight, max_repeats))
    goals = targets.withColumnsRenamed({"source": "t_source"})
    sums = sums.join(goals, F.col("s_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    same = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice"))
    placed = cut.join(sums, same).drop("s_source", "s_slice")
    order = Window.partitionBy("source", "slice").orderBy("draw", "doc_id", "row")
    order = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("at", F.col("ahead") + F.sum("size").over(order))

    # one row per copy that could be wanted, with its virtual finish time
    copies = F.when(F.col("target") > 0, F.ceil(F.col("target") / F.col("source_size"))).otherwise(1)
    copies = F.least(copies, F.lit(max_repeats)).cast("int")
    copied = placed.withColumn("copies", copies).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    finish = (F.col("copy") * F.col("source_size") + F.col("at")) / F.col("target")
    copied = copied.withColumn("finish", F.when(F.col("target") > 0, finish).otherwise(0.0))
    copied = copied.withColumn("range", F.floor(F.col("finish") * slices).cast("long"))
    copied = cut_lineage(copied.drop("ahead", "slice", "at"))

    # the range in which the budget runs out, from one row per range
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    per = copied.groupBy("range").agg(F.sum("size").alias("n"))
    per = per.withColumn("used", F.sum("n").over(Window.orderBy("range")))
    last = per.filter(F.col("used") > budget).orderBy("range").first()
    if last is None:
        taken = copied.withColumn("fits", F.lit(True))
    else:
        rest = budget - (last["used"] - last["n"])
        edge = copied.filter(F.col("range") == last["range"])
        running = Window.orderBy("finish", "draw", "doc_id", "row", "copy")
        edge = edge.withColumn("fits", F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, 0)) <= rest)
        away = copied.filter(F.col("range") != last["range"])
        taken = away.withColumn("fits", F.col("range") < last["range"]).unionByName(edge)
    fits = F.col("fits")
    return taken.groupBy("row", "draw", "doc_id", "source", "size", "source_size", "target").agg(
        F.sum(F.when(fits, F.col("size")).otherwise(0)).alias("taken"),
        F.count_if(fits).alias("copies"),
        F.array_sort(F.collect_list(F.when(fits, F.col("finish")))).alias("finishes"),
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
