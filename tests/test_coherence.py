"""Pairs that share positions, with one that all hold."""

from __future__ import annotations

import random
from itertools import combinations

from claimloom.operators import stance


def test_common_positions_are_not_joined_on(spark):
    draw = random.Random(6)
    held = {f"c{i:02}": {("g", "hot"): 0.5, **{("g", f"e{draw.randrange(9)}"): draw.choice([0.0, 0.02, 1.0]) for _ in range(draw.randrange(4))}} for i in range(40)}
    held |= {f"only{i}": {("g", "hot"): 0.5} for i in range(30)}  # share nothing else
    held |= {"twin": dict(held["c00"])}
    rows = [(k, g, e, v) for k, at in held.items() for (g, e), v in at.items()]
    table = spark.createDataFrame(rows, "claim_id string, group_name string, evidence_id string, value double")
    for least in (1, 2, 3):
        want = set()
        for a, b in combinations(sorted(held), 2):
            shared = held[a].keys() & held[b].keys()
            if len(shared) >= least and all(abs(held[a][p] - held[b][p]) < 0.05 for p in shared):
                want.add((a, b, len(shared)))
        got = [tuple(r) for r in stance.coherent(table, "claim_id", least).collect()]
        assert set(got) == want and len(got) == len(want)
