"""Connected components of an edge table by alternating stars; every step is a join or a partially aggregated group-by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Workspace


def _toward_smaller(edges: DataFrame) -> DataFrame:
    a, b = F.greatest("src", "dst"), F.least("src", "dst")
    return edges.filter(F.col("src") != F.col("dst")).select(a.alias("src"), b.alias("dst")).distinct()


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least node of their src. The key is masked on the small side, so it gets an exchange of its own and a
    hub's edges can be split over tasks as a skewed join."""
    side = least.select(F.col("src").bitwiseXOR(F.lit(0).cast("long")).alias("_src"), "m")
    return edges.join(side, F.col("src") == F.col("_src")).drop("_src")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node next to it."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
    return _with_least(both, least).filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = _with_least(edges, least)
    return moved.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def components(spark: SparkSession, edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) of every node on an edge (src, dst: long); component is its smallest reachable node.

    Loops and repeated edges don't matter; an empty table gives an empty one. Each round is written to shared storage, so
    lost executors cost a round at most. The number of rounds grows with the logarithm of the longest path.
    """
    now = work.table(_toward_smaller(edges), f"{name}-0")
    state, k = _state(now), 0
    while state[0]:
        k += 1
        nxt = work.table(_toward_smaller(_small_star(_toward_smaller(_large_star(now)))), f"{name}-{k}")
        was, state, now = state, _state(nxt), nxt
        work.drop(f"{name}-{k - 1}")
        if was == state:
            break
    tops = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(tops)
