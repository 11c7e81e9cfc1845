"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dexspark.llm.common import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. edges has (a, b) with a > b.

    The least neighbours are written first: then both sides of the join are plain exchanges, of
    which adaptive execution splits the part of a node with very many neighbours.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        out = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = materialise(edges.groupBy("a").agg(F.min("b").alias("m")))
        to_low = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = to_low.union(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is its smallest node.

    Each round keeps at most one row per edge; rows are written to the shared folder after
    it, so that a lost executor repeats one round. Edges with nulls and loops are left out.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _digest(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        edges = materialise(_stars(_stars(edges, large=True), large=False))
        now = _digest(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
