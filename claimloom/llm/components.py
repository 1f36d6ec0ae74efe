"""Connected components of a graph given by its edges, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, root: the least node of its component, for each node with an edge.

    Alternates two steps until nothing changes: each neighbour that is greater than the node is tied to the least node
    around it, then each lesser one. A node's neighbours are never gathered, only their minimum; the edges are the state,
    written to the shared folder after each round.

    Defined cases: edges without either end, and from a node to itself, are none; repeated and reversed edges are one; no
    edges give no rows. Other columns are not read.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, now = now, materialize(small.where("a != b").distinct(), "edges")
        discard(before)
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().join(roots, "node", "left_anti"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit("mark")))).first())
