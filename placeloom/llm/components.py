"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links of ``u`` to neighbours ``v`` are moved to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    # an expression as the key: its rows are shuffled anew for the join, and adaptive execution only splits a hot key there
    least = least.select(F.when(F.col("u").isNotNull(), F.col("u")).alias("w"), F.least("u", "m").alias("m"))
    joined = links.join(least, links["u"] == least["w"])
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    moved = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return moved.select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(u, v)``: each node of ``edges`` but the least of its component, with that least node.

    Both ends are of one orderable type. Rows with a null end and loops are ignored; repeated and
    reversed edges count once; an empty table has no components. No node is ever collected: each
    round is an aggregation and a join whose hot keys adaptive execution splits, and each round's
    edges are stored in the shared folder, so a lost executor repeats one round at most.
    """
    edges = edges.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stored(edges.distinct(), "edges")
    before = None
    while (now := _mark(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = stored(_star(_star(both, True), False), "edges")
    return edges
