"""Connected components of a graph that no one machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources import materialize


def _with_least(rows: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``rows`` (a, b) with the least neighbour m of a, or a if that is less.

    A minimum with partial sums, written, and a join of its own exchange, which
    adaptive execution can split where a node has very many edges.
    """
    least = materialize(neighbours.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")), "least")
    return rows.join(least, F.col("a") == F.col("of")).select("a", "b", F.least("a", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are joined with the least of its neighbours and itself. ``edges`` have a > b."""
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    joined = _with_least(up, edges.unionByName(up))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and it, are joined with the least of them. ``edges`` have a > b."""
    joined = _with_least(edges, edges)
    ends = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return ends.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b) of longs: root is the least node of its component.

    Alternating large and small stars until nothing changes: rounds grow with
    the logarithm of the nodes, rows never exceed twice the edges, and a hub's
    edges need not meet in one task. Edges from a node to
    itself give it a row only if another edge does.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        edges = materialize(_small_star(_large_star(edges)), name)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
