"""Connected components by alternating star contraction, wholly in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import durable


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    return tuple(row)


def connected(edges: DataFrame) -> DataFrame:
    """Components of the graph whose edges are the rows (a, b), both long.

    Returns (node, root) for every node but the roots themselves; ``root`` is the least node of the
    component. Each round lets every node point its larger neighbours, then its smaller ones, at the
    least node it sees; the number of rounds grows with the logarithm of a component's size. Minima
    are combined before the shuffle, so a node with very many neighbours costs no more than others.
    Self-loops and repeated edges are allowed; an empty table gives an empty result.
    """
    edges = durable(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _digest(edges)
    while seen[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        # Minima are written before they are joined: both sides are then plain exchanges, and the rows
        # of a node with very many neighbours can be split.
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = durable(large)
        root = durable(large.groupBy("a").agg(F.min("b").alias("m")))
        small = (
            large.join(root, "a")
            .where("b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(root.select("a", F.col("m").alias("b")))
            .distinct()
        )
        edges = durable(small)
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
