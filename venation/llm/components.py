"""Connected components by alternating large-star and small-star.

Both steps are a minimum per node and a join back, so a node with very many neighbours is summed before it is shuffled and
its rows can be split among tasks. No neighbourhood is gathered anywhere. Edges are written to the shared folder after
each round, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import forget, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of them. Edges run from the larger node, a, to the smaller, b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal when a round changed nothing."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of an edge (a, b) the smallest node reachable from it, itself included.

    Edges with a null end or equal ends are ignored; repeated edges count once; no edges give no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    now = written(now, "edges")
    before = _state(now)
    while before[0]:
        last, now = now, written(_small_star(_large_star(now)), "edges")
        after = _state(now)
        forget(last)
        if after == before:
            break
        before = after
    # every edge now runs from a node to the smallest of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
