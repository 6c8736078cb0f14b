"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonset.session import saved_once


def _step(edges: DataFrame, larger: bool) -> DataFrame:
    """One star operation: neighbours of a node are linked to the smallest of its neighbourhood instead.

    The minimum is an aggregate joined back, so that a node with very many neighbours can be split.
    """
    if larger:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Rounds go on until the edge table stays the same; it then links each node to its component. Every
    round is written to the shared folder, so that a lost executor costs one round.
    """
    edges = saved_once(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        edges = saved_once(_step(_step(edges, True), False), "stars")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    pairs = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    return pairs.union(pairs.select(F.col("component").alias("node"), "component").distinct())
