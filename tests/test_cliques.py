"""Cliques around hubs, and of random graphs against a plain search."""

from __future__ import annotations

import itertools
import random

from claimloom.operators import cliques

NODES, EDGES = "node string", "a string, b string"


def plain(nodes: list[str], edges: set[frozenset]) -> set[tuple]:
    near = {v: {w for w in nodes if frozenset((v, w)) in edges} for v in nodes}
    found = set()
    for k in range(1, len(nodes) + 1):
        for c in itertools.combinations(sorted(nodes), k):
            if all(w in near[v] for v, w in itertools.combinations(c, 2)) and not set.intersection(*(near[v] for v in c)):
                found.add(c)
    return found


def test_random_graphs(spark):
    draw = random.Random(9)
    for n, share in ((9, 0.5), (11, 0.7)):
        nodes = [f"n{i}" for i in range(n)]
        edges = {frozenset(p) for p in itertools.combinations(nodes, 2) if draw.random() < share}
        pairs = [tuple(draw.sample(sorted(e), 2)) for e in edges]
        got = cliques.maximal_cliques(spark.createDataFrame([(v,) for v in nodes], NODES), spark.createDataFrame(pairs, EDGES)).collect()
        assert {tuple(r.members) for r in got} == plain(nodes, edges) and len(got) == len({r.clique for r in got})


def test_a_hub_of_unlike_neighbours(spark):
    """5,000 neighbours, each with another one of its own and some with one another: they go before the hub."""
    n = 5000
    pairs = [("hub", f"a{i:04}") for i in range(n)] + [(f"a{i:04}", f"z{i:04}") for i in range(n)] + [(f"a{i:04}", f"a{i + 1:04}") for i in range(0, n, 10)]
    nodes = sorted({v for p in pairs for v in p})
    edges = spark.createDataFrame(pairs, EDGES)
    got = {tuple(r.members) for r in cliques.maximal_cliques(spark.createDataFrame([(v,) for v in nodes], NODES), edges).collect()}
    together = {(f"a{i:04}", f"a{i + 1:04}", "hub") for i in range(0, n, 10)}
    alone = {(f"a{i:04}", "hub") for i in range(n) if i % 10 > 1}
    assert got == together | alone | {(f"a{i:04}", f"z{i:04}") for i in range(n)}
    both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
    level = {r.node: r.level for r in cliques.peeled(both).collect()}
    assert len(level) == len(nodes) and level["hub"] > max(level[v] for v in nodes if v != "hub" and v[0] == "z")
