"""Maximal cliques of a graph given by its nodes and edges.

Nodes are peeled off in rounds, those of low degree first, and each edge points to the end that goes later. What a node
points to is then bounded by the density of the graph's densest part, not by its degree: a hub's many neighbours go before
it. A clique is found at its first node, among the nodes that this one points to, so a task holds these and the edges among
them. A clique is maximal among the later nodes by the search; whether an earlier node could join it is settled by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.scratch import settle

CLIQUES = "clique string, members array<string>, size int"


def _extend(now: set, may: set, seen: set, around: dict[str, set]) -> Iterator[set]:
    """Bron-Kerbosch with a pivot, on a stack of its own so that deep graphs do not recurse."""
    stack = [(now, may, seen)]
    while stack:
        now, may, seen = stack.pop()
        if not may:
            if not seen:
                yield now
            continue
        pivot = max(may | seen, key=lambda v: (len(may & around[v]), v))
        for v in sorted(may - around[pivot]):
            stack.append((now | {v}, may & around[v], seen & around[v]))
            may, seen = may - {v}, seen | {v}


def _twins(both: DataFrame) -> DataFrame:
    """node, rep: nodes with the same neighbours, themselves included, lie in the same maximal cliques; the least one stands for them."""
    closed = both.unionByName(both.select("a", F.col("a").alias("b"))).distinct()
    h = closed.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("b")).alias("h_1"), F.bit_xor(F.xxhash64("b", F.lit("second"))).alias("h_2"))
    return h.select(F.col("a").alias("node"), F.min("a").over(Window.partitionBy("n", "h_1", "h_2")).alias("rep"))


def peeled(edges: DataFrame) -> DataFrame:
    """node, level: the round in which each node with an edge goes. edges: a, b, both ways.

    Each round takes the nodes of at most the average degree, and a tenth more, of what is left; so an eleventh of the nodes
    goes at least, and a node has at most 1.1 times the average degree of some part of the graph among the nodes after it.
    """
    left, level, done = edges, 0, None
    while not left.isEmpty():
        degree = left.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
        mean = degree.agg(F.avg("degree").alias("mean"))  # one row
        gone = settle(degree.crossJoin(F.broadcast(mean)).where(F.col("degree") <= 1.1 * F.col("mean")).select(F.col("a").alias("node"), F.lit(level).alias("level")), "graph-peel")
        done = gone if done is None else done.unionByName(gone)
        left = settle(left.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"), "graph-rest")
        level += 1
    nodes = edges.select(F.col("a").alias("node")).distinct()
    # nodes whose neighbours have all gone go last
    return nodes.withColumn("level", F.lit(level)) if done is None else nodes.join(done, "node", "left").withColumn("level", F.coalesce("level", F.lit(level)))


def maximal_cliques(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: node; edges: a, b. A row for each maximal clique; a node without edge is one. An empty graph has one empty clique.

    Nodes with the same neighbours are one. The number of cliques can grow beyond measure in a dense part; none is left out.
    """
    edges = settle(edges.select("a", "b"), "graph-edges")
    whole = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    twins = settle(nodes.select("node").distinct().join(_twins(whole), "node", "left").select("node", F.coalesce("rep", "node").alias("rep")), "graph-twins")
    if twins.isEmpty():
        return nodes.sparkSession.createDataFrame([("", [], 0)], CLIQUES)
    side = lambda s: twins.select(F.col("node").alias(s), F.col("rep").alias(f"rep_{s}"))
    both = settle(whole.join(side("a"), "a").join(side("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).where("a <> b").distinct(), "graph-pairs")
    level = settle(peeled(both), "graph-levels")
    at = lambda s: level.select(F.col("node").alias(s), F.col("level").alias(f"level_{s}"))
    later = F.struct("level_a", "a") < F.struct("level_b", "b")
    points = settle(both.join(at("a"), "a").join(at("b"), "b").where(later).select("a", "b"), "graph-points")
    x, y, z = points.alias("x"), points.alias("y"), points.alias("z")
    among = x.join(y, F.col("x.b") == F.col("y.a")).join(z, (F.col("x.a") == F.col("z.a")) & (F.col("y.b") == F.col("z.b")))
    triangles = among.select(F.col("x.a").alias("node"), F.col("x.b").alias("a"), F.col("y.b").alias("b"))
    none = F.lit(None).cast("string")
    rows = twins.select(F.col("rep").alias("node"), none.alias("a"), none.alias("b")).distinct().unionByName(points.select(F.col("a").alias("node"), F.col("b").alias("a"), none.alias("b"))).unionByName(triangles)

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        node, a, b = key[0].as_py(), rows["a"].to_pylist(), rows["b"].to_pylist()
        around: dict[str, set] = {v: set() for v in a if v is not None}
        for v, w in zip(a, b, strict=True):
            if w is not None:
                around[v].add(w)
                around[w].add(v)
        found = [sorted(c) for c in _extend({node}, set(around), set(), around)]
        return pa.table([pa.array([node] * len(found), pa.string()), pa.array(["|".join(c) for c in found], pa.string()), pa.array(found, pa.list_(pa.string()))], ["node", "clique", "members"])

    found = settle(rows.groupBy("node").applyInArrow(search, "node string, clique string, members array<string>"), "graph-found")
    # an earlier node that points to the first one and to all others makes it part of a larger clique
    before = points.select(F.col("a").alias("earlier"), F.col("b").alias("node"))
    asked = found.join(before, "node").select("clique", F.size("members").alias("size"), "earlier", F.explode("members").alias("member"))
    joins = asked.join(points.select(F.col("a").alias("earlier"), F.col("b").alias("member")), ["earlier", "member"], "left_semi")
    part = joins.groupBy("clique", "earlier", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size").select("clique").distinct()
    whole = found.join(part, "clique", "left_anti")
    spread = whole.select("clique", F.explode("members").alias("rep")).join(twins, "rep").groupBy("clique").agg(F.sort_array(F.collect_list("node")).alias("members"))
    return spread.select(F.array_join("members", "|").alias("clique"), "members", F.size("members").alias("size"))
