"""Connected components of an edge table: tops are hung on a neighbour, alternating large-star and small-star steps settle the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators.tables import Scratch, materialize


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, smaller_only: bool, keep: Scratch) -> DataFrame:
    """Link the neighbours of each node to its least neighbour. ``pairs``: (u, v), v a neighbour of u."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    # Written first, so that both sides of the join are plain exchanges whose hot keys Spark can split.
    least = keep(least, "cc-least")
    joined = pairs.join(least, "u")
    if smaller_only:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def _without_tops(links: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, at) for every node, and the edges (a, b) left between the nodes that others are hung at.

    A top, which no greater node is linked to, is hung at its least neighbour: its other neighbours
    are linked to that one instead, and it has that one's root. ``links``: distinct (u, v), u >= v.
    """
    up = links.filter("u <> v").select(F.col("v").alias("node"), F.lit(None).cast(links.schema["v"].dataType).alias("v"), F.lit(True).alias("up"))
    ends = links.select(F.col("u").alias("node"), F.when(F.col("u") != F.col("v"), F.col("v")).alias("v"), F.lit(False).alias("up")).union(up)
    nodes = keep(ends.groupBy("node").agg(F.min("v").alias("least"), F.count("v").alias("down"), F.max("up").alias("up")), "cc-nodes")
    # A node's only edge down is known from its row; edges move again where there are several.
    one = nodes.filter("up and down = 1").select(F.col("node").alias("a"), F.col("least").alias("b"))
    several = keep(nodes.filter("down > 1").select(F.col("node").alias("u"), F.when(F.col("up"), F.col("node")).otherwise(F.col("least")).alias("a")), "cc-several")
    left = one.union(links.join(several, "u").select("a", F.col("v").alias("b")).filter("a <> b"))
    return nodes.select("node", F.when(F.col("up"), F.col("node")).otherwise(F.coalesce("least", "node")).alias("at")), left


def components(edges: DataFrame, loops: bool = False) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    ``edges``: (a, b), any order, repeats and loops allowed, of one ordered type; null ends are no
    edges. With ``loops`` a node whose only edges are loops is a component of its own, else it is left
    out. Nodes above all their neighbours, often most of them, are hung at one and take no part in
    the rounds. Each round halves path lengths at least; a node's edges are never gathered in one task (the minimum is
    taken by partial aggregation). Rounds are written to the shared folder.
    """
    with Scratch(edges.sparkSession) as keep:
        real = edges.filter("a = b or a <> b" if loops else "a <> b")
        links = keep(real.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
        nodes, left = _without_tops(links, keep)
        now = keep(left, "cc-left")
        keep.drop(links)
        seen = None
        while (mark := _fingerprint(now)) != seen and mark[0]:
            seen = mark
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
            large = keep(_star(both, smaller_only=False, keep=keep), "cc-large")
            keep.drop(now)
            down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            now = keep(_star(down, smaller_only=True, keep=keep), "cc-small")
            keep.drop(large)
        # Every node once, with the root of where it is hung: the end of its star, or that place itself.
        roots = now.select(F.col("a").alias("at"), F.col("b").alias("root"))
        return materialize(nodes.join(roots, "at", "left").select("node", F.coalesce("root", "at").alias("root")), "cc-roots")
