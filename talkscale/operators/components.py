"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkscale.operators.store import forget, once


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each component. Nodes are the ends of edges, of any type that has an order and a hash; null ends and loops are left out.

    In each round every node hooks to the neighbour, or itself, that is first in an order drawn anew by hashing; hooks are
    followed one step further and edges are contracted to what nodes hook to. Nodes that others hook to are a fraction of all,
    whatever the shape and the numbering, so a chain takes as many rounds as the logarithm of its length. Edges and hooks only
    shrink from round to round; a node with very many neighbours is one partial minimum in each task.
    """
    left = once(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    nodes = once(left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct(), "nodes")
    roots, turn = nodes.withColumn("root", F.col("node")), 0
    while left.head(1):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("place"), F.col(c).alias("node"))  # noqa: B023, E731
        hooks = both.groupBy("a").agg(F.min(place("b")).alias("near")).select(F.col("a").alias("node"), F.least(place("a"), "near")["node"].alias("up"))
        further = hooks.select(F.col("node").alias("at"), F.col("up").alias("next"))
        hooks = once(hooks.join(further, F.col("up") == F.col("at")).select("node", F.col("next").alias("up")), "hooks")
        ends = [hooks.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in ("a", "b")]
        rest = once(left.join(ends[0], "a").join(ends[1], "b").where("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "edges")
        step = hooks.select(F.col("node").alias("root"), "up")
        moved = once(roots.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        for spent in (left, hooks, roots):
            forget(spent)
        left, roots, turn = rest, moved, turn + 1
    forget(left)
    # a component is now known by any of its nodes
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(least, "root").select("node", F.col("least").alias("root"))
