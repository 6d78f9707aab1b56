"""Connected components by contraction: every step is a join or a partial aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is one node of the component.

    A round hooks each node to its smallest neighbour, follows the hooks to their ends by pointer
    doubling, and goes on with the edges between ends. Every component that has edges left loses
    nodes in each round, usually most of them. Loops and repeated edges do no harm.
    """
    edges = _between(edges)
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("b"))
        hooks = _ends(hooks.select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        found = hooks if found is None else _followed(found, hooks)
        a, b = (hooks.withColumnsRenamed({"node": x, "root": f"_{x}"}) for x in "ab")
        edges = _between(edges.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def _between(edges: DataFrame) -> DataFrame:
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return checkpointed(ordered.distinct())


def _followed(nodes: DataFrame, hooks: DataFrame) -> DataFrame:
    """Nodes with their roots replaced by where the hooks lead from these."""
    onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("_next"))
    joined = nodes.join(onward, "root", "left")
    return checkpointed(joined.select("node", F.coalesce("_next", "root").alias("root")))


def _ends(hooks: DataFrame) -> DataFrame:
    hooks = checkpointed(hooks)
    while True:
        onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        further = checkpointed(hooks.join(onward, "root").select("node", F.col("_next").alias("root"), F.col("root").alias("_was")))
        done = further.where("root <> _was").isEmpty()
        hooks = further.drop("_was")
        if done:
            return hooks
