"""Connected components of a distributed edge list, by alternating large and small stars.

Each round hangs a node's larger neighbours, then its smaller ones, on the smallest node that it
knows; rounds fall off with the logarithm of the longest path. Minima are summed before the
shuffle and joined back, so that a node with very many neighbours is not gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _hang(pairs: DataFrame, larger: bool) -> DataFrame:
    """Each node of a pair (u, v) on the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    own = pairs.where(F.col("v") > F.col("u")) if larger else pairs
    hung = own.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        hung = hung.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.where("a != b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the smallest node it can reach) of every node that has an edge (u, v) to another one; nulls have none."""
    now = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(most):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _hang(both, True)
        now = materialise(_hang(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False), "stars")
        last, sign = sign, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if sign == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError("the components did not settle")
