"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_by_key

#: Up to so many edges, the least neighbours of nodes are broadcast; beyond, hot nodes are split off.
BROADCAST_ROWS = 500_000


def _with_least(edges: DataFrame, grouped: DataFrame, few: bool, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """``edges`` with the least neighbour m of u among ``grouped``, and the table of these."""
    least = grouped.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    if few:
        return edges.join(F.broadcast(least), "u"), least
    least = work.save(least)
    return join_by_key(edges, least, "u", "degree", BROADCAST_ROWS), least


def _large_star(edges: DataFrame, few: bool, work: Workspace) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved, least = _with_least(both.where("v > u"), both, few, work)
    out = work.save(moved.select(F.col("v").alias("u"), F.least("u", "m").alias("v")))  # the small star drops repeated edges
    work.drop(least)
    return out


def _small_star(edges: DataFrame, few: bool, work: Workspace) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these; here u > v always."""
    moved, least = _with_least(edges, edges, few, work)
    moved = moved.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = work.save(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
    work.drop(least)
    return out


def _shape(edges: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes that keep them from being stars around least nodes: those with
    two smaller neighbours, and those with smaller and larger ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    bent = (F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))
    n, wrong = nodes.agg(F.sum("below"), F.sum(bent.cast("long"))).first()
    return n or 0, wrong or 0


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``node, component`` for every node that an edge touches.

    ``edges`` has two integer columns ``u`` and ``v``; component is the least node reachable.
    Loops, repeated edges and rows with a null end are ignored; no edges give no rows. Each
    round is written to the shared folder, and the rounds end when all edges are stars around the least
    node of their component. A node with any number of neighbours is no burden to one task (see
    ``join_by_key``).
    """
    state = edges.where("u is not null and v is not null and u <> v")
    state = work.save(state.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        n, wrong = _shape(state)
        if not wrong:
            break
        few = 2 * n <= BROADCAST_ROWS
        large = _large_star(state, few, work)
        small = _small_star(large, few, work)
        work.drop(large, state)
        state = small
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
