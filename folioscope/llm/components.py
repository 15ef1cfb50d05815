"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Workspace


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _mins(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node's smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _mins(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """``u``, ``v`` links between numbers to (``node``, ``component``): the least node reachable.

    Only nodes with a link other than to themselves have a row. Nulls link nothing. Every round is
    written to the shared folder; rounds end when one changes no link, which takes about the
    logarithm of the number of nodes squared at most, and 2 or 3 for groups like stars.
    """
    now = space.stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    check = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen, k = check(now), 0
    while seen[0]:
        k += 1
        now = space.stash(small_star(large_star(now)), f"{name}-{k}")
        space.drop(f"{name}-{k - 1}")
        last, seen = seen, check(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
