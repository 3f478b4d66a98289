"""Connected components of an edge table, kept in tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

#: Alternations that no graph of 2**62 nodes exceeds; a guard against a fault, not a limit.
MOST_ROUNDS = 200


def _hooked(edges: DataFrame, name: str) -> DataFrame:
    """Large star, then small star, as a stored table: every node's larger neighbours, then its smaller ones, move to its
    least one. The tables before are deleted."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Saved, so that the joins below deal out both sides and can split a hub's edges.
    least = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
    large = saved(large, "large-star")
    small = saved(large.groupBy("a").agg(F.min("b").alias("m")), "small-star")
    pairs = large.join(small, "a")
    out = saved(
        pairs.select(F.col("m").alias("u"), F.col("b").alias("v"))
        .unionByName(pairs.select(F.col("m").alias("u"), F.col("a").alias("v")))
        .filter("u != v")
        .distinct(),
        name,
    )
    discard(least, large, small, edges)
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node with an edge; component is the least node reachable.

    ``edges`` has long columns u and v, in either direction; loops and repeats do no harm and null ends are dropped.
    Alternates large-star and small-star steps, each on a table written to the shared folder, until all edges are stars
    (of order log n rounds). Hub nodes are met by a pre-aggregated minimum and a join that can be split.
    """
    state = saved(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), name)
    mark = None
    for _ in range(MOST_ROUNDS):
        n = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == mark or not n[0]:
            break
        mark = n
        state = _hooked(state, name)
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return state.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
