"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps.

Every step replaces links by links to a smaller node nearby; after a number of rounds that grows with the logarithm of
the graph each component is a star around its smallest node. All steps are joins and minima over tables in the shared
folder, which go when the next ones are there; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def least_of(pairs: DataFrame) -> DataFrame:
    """(w, m): each u and the smallest of it and its partners. Written before the join, so that a node with very many
    partners can be split over tasks there."""
    return stage(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "components-least")


def large_star(edges: DataFrame) -> DataFrame:
    pairs = both_ways(edges)
    least = least_of(pairs)
    p = pairs.join(least, F.col("u") == F.col("w"))
    out = stage(p.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "components-large")
    discard(least)
    return out


def small_star(edges: DataFrame) -> DataFrame:
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = least_of(pairs)
    p = pairs.join(least, F.col("u") == F.col("w"))
    both = p.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(p.select("u", F.col("m").alias("v")))
    out = stage(both.where("u != v").distinct(), "components-small")
    discard(least)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (u long, v long). Returns (node, component), the component's smallest node, for each node of a link."""
    e = stage(edges.where("u != v").select("u", "v").distinct(), "components-edges")
    before = None
    for _ in range(rounds):
        large = large_star(e)
        small = small_star(large)
        discard(e, large)
        e = small
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    out = stage(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(e)
    return out
