"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.shared import BROADCAST_ROWS
from fieldlens.session import cut_lineage

# edges for each task of a round, about: a megabyte or two
EDGES = 50_000


def _undirected(edges: DataFrame) -> DataFrame:
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pair.filter("a < b").distinct()


def _looked_up(nodes: DataFrame, n: int) -> DataFrame:
    """A table of the nodes of `n` edges, two numbers a row, to be broadcast if it is small."""
    return F.broadcast(nodes) if 2 * n <= BROADCAST_ROWS else nodes


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    In every round each node joins the best among itself and its neighbours, by degree and then by a hash that changes
    with the round, and edges between joined nodes disappear. A star is done in a round or two, and a path, in
    whatever order its nodes are numbered, shrinks by a factor each time. Each round is written before the next.

    Tasks and files of a round follow its edges, not the number of shuffle partitions: late rounds have few edges.
    """
    edges, steps, most = cut_lineage(_undirected(edges)), [], 0
    while n := edges.count():
        most = max(most, n)
        tasks = 1 + n // EDGES
        edges = edges.coalesce(tasks)
        rank = lambda node: F.struct("degree", F.xxhash64(F.lit(len(steps)), node), F.col(node).alias("up"))  # noqa: B023, E731
        both = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        both = edges.select(both)
        degree = both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("degree"))
        near = both.join(_looked_up(degree, n), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.max(rank("b")).alias("best"), F.count("*").alias("degree"))
        up = near.select("node", F.greatest(rank("node"), "best")["up"].alias("up"))
        steps.append(_looked_up(cut_lineage(up.coalesce(tasks)), n))
        moved = edges
        for end in ("a", "b"):
            to = steps[-1].withColumnsRenamed({"node": end, "up": f"up_{end}"})
            moved = moved.join(to, end)
        moved = _undirected(moved.select(F.col("up_a").alias("a"), F.col("up_b").alias("b")))
        edges = cut_lineage(moved.coalesce(tasks))
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0].withColumnRenamed("up", "root")
    for step in steps[1:]:
        found = found.join(step.withColumnRenamed("node", "root"), "root", "left")
        found = found.select("node", F.coalesce("up", "root").alias("root"))
    tasks = 1 + most // EDGES
    found = cut_lineage(found.coalesce(tasks)).coalesce(tasks)
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(_looked_up(least, most), "root").select("node", F.col("least").alias("root"))
