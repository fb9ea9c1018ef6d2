"""Connected components of a graph of links, without collecting it anywhere.

Large and small stars in turn: a large star hangs every greater neighbour of a node on
the node's smallest neighbour, a small star every smaller one and the node itself. Both
keep components together, and they end in a star around each component's smallest
node. A star is a minimum by key and a join, never a group in one task: the minimum is
aggregated before the shuffle, and Spark splits a skewed join. Each round is cut by
``checkpoint()`` into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(w, m) for edges (n, w) and least (u, m) where n is u.

    Keys are cast, so that both sides are shuffled for the join: Spark splits a
    partition only then, and a node with very many neighbours makes a large one.
    """
    key = lambda c: F.col(c).cast("decimal(20,0)")
    left = edges.select(key("n").alias("k"), "w")
    return left.join(least.select(key("u").alias("k"), "m"), "k").select("w", "m")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (u, v) with u > v."""
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = _joined(edges.select(F.col("u").alias("n"), F.col("v").alias("w")), least).union(least)
    else:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = _joined(edges.select(F.col("v").alias("n"), F.col("u").alias("w")), least)
    return hung.toDF("u", "v").filter("u > v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of each node in links (a, b) of longs: the smallest node of its component."""
    shared_dir(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct().checkpoint()

    def state(e: DataFrame) -> tuple:
        # Stars around smallest nodes: no node hangs on a node that hangs itself, and each once.
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = _star(_star(edges, small=False), small=True).checkpoint()
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
