"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.shared import stored


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node. Stored, so that a join with it can split a hot node."""
    least = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("least"))
    return stored(least, "least")


def _signature(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.pmod(mixed, F.lit(1 << 31))), F.sum(F.shiftright(mixed, 33))
        ).collect()[0]
    )


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's least node.

    Each round replaces edges by edges to smaller nodes: a node's larger neighbours move to its
    least one, then its smaller ones do. Edges never grow in number, a round needs two joins
    on the node, and the rounds grow with the logarithm of the longest path. Loops and repeated
    edges are allowed; no edges give no rows.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.distinct(), "edges")
    before = None
    while before != (now := _signature(edges)):
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_least(both), F.col("a") == F.col("n"))
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
            .where("a != b")
            .distinct()
        )
        large = stored(large, "edges")
        joined = large.join(_least(large), F.col("a") == F.col("n"))
        small = joined.select(F.explode(F.array(F.struct("b", "least"), F.struct(F.col("a").alias("b"), "least"))).alias("e"))
        small = small.select(F.col("e.b").alias("a"), F.col("e.least").alias("b")).where("a != b")
        edges = stored(small.distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
