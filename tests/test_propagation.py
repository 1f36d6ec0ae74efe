"""Sums of propagated edges against the edges themselves, on random maps, and the prefix counts below them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from claimloom import constants as K
from claimloom.operators import edges, propagation, residuals, state
from claimloom.plans.run_state import SummedRun
from claimloom.sources import bindings
from tests.test_claim_map import full, make

VALUES = [0.0, 0.1, 0.25, 0.3, 0.5, 0.52, 0.75, 1.0]


def random_map(spark, seed: int, several: bool):
    """Papers with many members, members listed twice, absent ones and ones without a value or of several groups, claims of other strengths."""
    draw = random.Random(seed)
    evidence = [(f"e{i}", f"p{draw.randrange(5)}", "x" if i % 4 else "y", draw.choice(VALUES)) for i in range(40)]
    members = [(f"g{i % 3}", f"e{i}") for i in range(40)] + [("g0", "e3"), ("g1", "gone"), ("g1", "e1")] + ([("g0", f"e{i}") for i in range(1, 20, 3)] if several else [])
    claims = [(f"c{i}", f"p{draw.randrange(6)}", []) for i in range(25)]
    said = []
    for c, paper, _ in claims:
        own = [e for e, q, *_ in evidence if q == paper]
        for name in ("x", "y"):
            aims = draw.sample(own, min(len(own), draw.randrange(4))) + draw.sample([e for e, *_ in evidence], draw.randrange(3))
            if aims or draw.random() < 0.2:
                said.append((c, name, draw.choice(VALUES), aims, None))
    m = make(spark, claims, said, evidence, members)
    strength = F.when(F.xxhash64("claim_id") % 3 == 0, 0.5).when(F.xxhash64("claim_id") % 5 == 0, 0.0).otherwise(1.0)
    nothing = F.when(F.col("evidence_id") != "e7", F.col("value"))
    from dataclasses import replace

    return replace(m, claims=m.claims.withColumn("init_out", strength), dimensions=m.dimensions.withColumn("value", nothing))


@pytest.mark.parametrize(("seed", "several"), [(1, False), (2, True)])
def test_sums_equal_edges(spark, seed, several):
    m = random_map(spark, seed, several)
    r = SummedRun(m, [])
    made = full(m)
    carried, sq = F.col("is_semantic"), F.col("residual_sq")
    miss = F.pow(F.col("pred_value") - F.col("actual"), 2)
    inner = F.col("regime_tag") == edges.IN
    want = made.groupBy("claim_id").agg(
        F.sum((~carried).cast("long")), F.sum(carried.cast("long")), F.sum((carried & (sq > K.CONTRADICTION_ABOVE)).cast("long")), F.countDistinct(F.when(sq <= K.BACKING_AT_MOST, F.col("ev_paper"))),
        F.round(F.coalesce(F.sum(F.when(carried, sq)), F.lit(0.0)), 9), F.round(F.coalesce(F.sum(F.when(inner, miss)), F.lit(0.0)), 9), F.round(F.coalesce(F.sum(F.when(~inner, miss)), F.lit(0.0)), 9))
    got = r.sums.select("claim_id", "base_edges", "carried", "contradicting", "stature", F.round("carried_sq", 9), F.round("r_in", 9), F.round("r_out", 9))
    # a sum with a value that is not there counts as without it
    assert sorted(map(tuple, got.collect())) == sorted((*r[:3], r[3] or 0, *r[4:]) for r in map(tuple, want.collect()))
    assert sorted(map(tuple, r.hygiene.collect())) == sorted(map(tuple, state.hygiene(m, made).select("claim_id", "status").collect()))


def test_a_map_without_groups_or_claims(spark):
    m = make(spark, [("c", "p", [])], [("c", "x", 0.5, [], None)], [("e", "p", "x", 1)])
    assert [(r.base_edges, r.carried, r.stature, r.r_in) for r in SummedRun(m, []).sums.collect()] == [(1, 0, 0, 0.25)]
    assert SummedRun(make(spark), []).best.count() == 0


def test_prefix_counts(spark):
    draw = random.Random(4)
    points = [(draw.choice("ab"), draw.choice(VALUES) * draw.choice([1, -3, 40]), draw.randrange(1, 4)) for _ in range(200)]
    asked = [(k, a, a + w) for k in "abc" for a in (-120.0, 0.1, 0.25, float("-inf")) for w in (0.0, 0.15, 30.0, float("inf"))]
    asked = [(k, a, b) for k, a, b in asked if b == b]
    found = propagation.counted(spark.createDataFrame(points, "k string, x double, w long"), spark.createDataFrame(asked, "k string, low double, high double"), ["k"]).collect()
    assert {(r.k, r.low, r.high): r.inside for r in found} == {(k, a, b): sum(w for q, x, w in points if q == k and a <= x <= b) for k, a, b in asked}


def test_no_row_for_a_propagated_edge(spark):
    """One group of 3,000 members and 300 claims: no join makes more rows than there are members, targets and papers."""
    n = 3000
    evidence = [(f"e{i}", f"p{i % 300}", "x", VALUES[i % 8]) for i in range(n)]
    m = make(spark, [(f"c{i}", f"p{i}", []) for i in range(300)], [(f"c{i}", "x", VALUES[i % 8], [f"e{i}"], None) for i in range(300)], evidence, [("g", e) for e, *_ in evidence])
    sums = SummedRun(m, []).sums
    assert sums.agg(F.sum("carried")).first()[0] == 300 * (n - 1)
    base = residuals.wired(m, edges.prediction_edges(m))
    assert residuals.scored(base).count() == 300
    one = sums.where("claim_id = 'c4'").first()  # carries 0.5
    assert one.contradicting == sum((0.5 - VALUES[i % 8]) ** 2 > 0.05 for i in range(n) if i != 4)
    assert one.stature == len({i % 300 for i in range(n) if (0.5 - VALUES[i % 8]) ** 2 <= 0.05})


def test_wired_predictions_are_wired_edges(spark):
    m = random_map(spark, 3, True)
    got, want = edges.wired_predictions(m), residuals.wired(m, edges.prediction_edges(m))
    assert sorted(map(repr, map(tuple, got.select(want.columns).collect()))) == sorted(map(repr, map(tuple, want.collect())))


@pytest.mark.parametrize("bind", [bindings.shipped_parts, bindings.labelled_documents])
def test_a_map_does_not_read_the_given_tables_again(spark, bind):
    m = bind(spark, "/root/testdata/sf0.001")
    read = {file for t in (m.claims, m.predictions, m.evidence, m.dimensions, m.members) for file in t.inputFiles()}
    assert read and not any("/testdata/" in file for file in read)
