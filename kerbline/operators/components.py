"""Connected components and strongly connected components as joins and aggregations."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.plans.lineage import cut


def components(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, component) of every node of the links (a, b); a component is named by its smallest node.

    Nodes are of any ordered type, structs included. Alternating large-star and small-star rounds: a
    row only ever meets the smallest neighbour of its node, so a node with very many neighbours costs
    a partial aggregation, not one large group. Stops when a round changes nothing;
    where most_rounds is given and met before, this is an error.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for done in itertools.count():
        if done == most_rounds:
            raise RuntimeError(f"components still change after {done} rounds")
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        two = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        edges = cut(large.join(low, "u").select(F.explode(two).alias("e")).select("e.*").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _reached(arcs: DataFrame, nodes: DataFrame, pivots: DataFrame) -> DataFrame:
    """Nodes reachable from the pivots along arcs (a, b) that stay within nodes, a frontier at a time."""
    inner = cut(arcs.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi"))
    seen = front = cut(pivots.select("node"))
    while not front.isEmpty():
        step = front.select(F.col("node").alias("a"))
        for _ in range(4):  # several hops for each round of bookkeeping
            step = step.union(step.join(inner, "a").select(F.col("b").alias("a"))).distinct()
        front = cut(step.select(F.col("a").alias("node")).join(seen, "node", "left_anti"))
        seen = cut(seen.union(front))
    return seen


def largest_strong_component(arcs: DataFrame) -> DataFrame:
    """Nodes of the largest strongly connected component of arcs (a, b); the one with the least node of equals.

    Nodes that no arc enters or none leaves are trimmed first. A pivot's component is what it reaches
    and is reached from; the rest is searched as long as it could hold a larger one.
    """
    arcs = cut(arcs.select("a", "b").where("a <> b").distinct())
    left = cut(arcs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    best, size = None, 0
    while True:
        total = left.count()
        if total <= size:
            return best if best is not None else left
        inner = arcs.join(left.select(F.col("node").alias("a")), "a", "left_semi").join(left.select(F.col("node").alias("b")), "b", "left_semi")
        core = cut(left.join(inner.select(F.col("a").alias("node")), "node", "left_semi").join(inner.select(F.col("b").alias("node")), "node", "left_semi"))
        if core.count() < total:
            if best is None:
                best, size = left.agg(F.min("node").alias("node")), 1
            left = core
            continue
        pivot = inner.groupBy("a").count().orderBy(F.desc("count"), "a").limit(1).select(F.col("a").alias("node"))
        forward = _reached(inner, left, pivot)
        backward = _reached(inner.select(F.col("b").alias("a"), F.col("a").alias("b")), left, pivot)
        found = cut(forward.join(backward, "node", "left_semi"))
        n = found.count()
        if n > size or n == size and found.agg(F.min("node")).first()[0] < best.agg(F.min("node")).first()[0]:
            best, size = found, n
        left = cut(left.join(found, "node", "left_anti"))
