"""Connected components by contraction: every node hooks on to its least neighbour, round by round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, nodes: int, most: int) -> DataFrame:
    """node, root of every node of edges (a, b); a root is any node of the component. nodes, most: bounds on the nodes and edges.

    Nodes should be hashes, so that chains of ever smaller nodes are short: a
    round then shrinks every chain by a constant factor, and a star whose
    centre is its least node is done in one. A node's neighbours are
    pre-aggregated before the shuffle; nothing is gathered by node or
    component. No edges give no rows.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    left, hooks, rows = both, [], min(nodes, 2 * most)
    for _ in range(1_000):
        hook = checkpointed(left.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("child"), F.least("a", "b").alias("parent")), rows)
        rows = hook.count()
        if not rows:
            break
        hooks.append(hook)
        up, over = hook.select(F.col("child").alias("a"), F.col("parent").alias("pa")), hook.select(F.col("child").alias("b"), F.col("parent").alias("pb"))
        left = checkpointed(left.join(up, "a").join(over, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), 2 * most)
        most = left.count()
        if not most:
            break
        rows = min(rows, most)
    else:
        raise RuntimeError("components did not settle")
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    first = hooks[0].select(F.col("child").alias("node"), F.col("parent").alias("root"))
    return reduce(lambda found, hook: found.join(hook, found["root"] == hook["child"], "left").select("node", F.coalesce("parent", "root").alias("root")), hooks[1:], first)
