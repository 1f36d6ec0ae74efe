"""The snapshot store, the map kept in it, and what differs between two maps."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from claimloom.operators import diff, subjects
from claimloom.plans.living_map import LivingMap
from claimloom.plans.run_state import SummedRun
from claimloom.sources.snapshots import Snapshots, Update, fingerprints
from tests.test_claim_map import make

UNITS = "unit string, value long"


def files(folder) -> set[str]:
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}


def rows(df) -> list[tuple]:
    return sorted(map(repr, df.collect()))


def test_generations(spark, tmp_path):
    store, computed = Snapshots(spark, str(tmp_path / "store")), []
    with pytest.raises(FileNotFoundError):
        store.read("t")

    def put(data: list[tuple], fail: bool = False) -> Update:
        df = spark.createDataFrame(data, UNITS)

        def compute(units):
            computed.append(sorted(r.unit or "" for r in units.collect()))
            if fail:
                raise RuntimeError("lost")
            return {"t": df.join(units, df["unit"].eqNullSafe(units["unit"]), "left_semi").select("unit", "value", F.col("value").alias("twice"))}

        return store.update(fingerprints(df, "unit"), compute)

    first = [("a", 1), ("a", 1), ("b", 2), ("c", 3)]
    assert put(first) == Update(1, 3, 0) and store.read("t").count() == 4
    before = files(tmp_path)
    assert put(first[::-1]) == Update(1, 0, 0) and files(tmp_path) == before  # the order of rows says nothing
    assert put([("a", 1), ("b", 2), ("c", 3)]) == Update(2, 1, 0) and computed[-1] == ["a"]  # a repeated row less
    with pytest.raises(RuntimeError):
        put([("a", 9), ("b", 2), ("c", 3)], fail=True)
    assert store.generation() == 2 and sorted(r.value for r in store.read("t").collect()) == [1, 2, 3]
    assert put([("a", 9), ("d", None), ("c", 3)]) == Update(3, 2, 1) and computed[-1] == ["a", "d"]
    assert sorted((r.value or 0, r.twice or 0) for r in store.read("t").collect()) == [(0, 0), (3, 3), (9, 9)]
    assert put([]) == Update(4, 0, 3) and store.manifest().count() == 0
    with pytest.raises(FileExistsError):
        store._commit(4, "rother")


def small_map(spark, new: bool):
    claims = [("c1", "p1", ["k"]), ("c2", "p2", []), ("c3", "p3", [])] + ([("n1", "new", [])] if new else [])
    said = [("c1", "x", 1, ["e1", "e2"], None), ("c2", "x", 0, ["e2"], None), ("c2", "y", 1, ["f1"], None), ("c3", "y", 1, ["f1", "f2"], None), ("c1", "x", 1, ["e3"], None)]
    said += [("n1", "x", 1, ["e3", "e2"], None)] if new else []
    evidence = [("e1", "p1", "x", 1), ("e2", "p2", "x", 0), ("f1", "p2", "y", 1), ("f2", "p3", "y", 0)] + ([("e3", "new", "x", 1)] if new else [])
    return make(spark, claims, said, evidence, [("g", "e1"), ("g", "e2"), ("g", "e3"), ("h", "f1"), ("h", "f2")])


def test_a_new_paper_touches_its_groups_only(spark, tmp_path):
    living = LivingMap(spark, str(tmp_path / "living"))
    prior, whole = small_map(spark, False), small_map(spark, True)
    assert living.update(prior, []) == (Update(1, 2, 0), Update(1, 3, 0))
    old = tuple(spark.createDataFrame(df.collect(), df.schema) for df in living.ideas())
    before = files(tmp_path)
    assert living.update(prior, []) == (Update(1, 0, 0), Update(1, 0, 0)) and files(tmp_path) == before
    by_group, by_claim = living.update(whole, ["new"])
    assert by_group == Update(2, 1, 0)  # h is as it was
    assert by_claim.touched == 3  # c3 neither targets the group nor has an edge in it
    found = subjects.ideas(whole)
    related = subjects.relations(found)
    status = subjects.with_status(found, related, ["new"])
    assert rows(living.groups.read("status").select(status.columns)) == rows(status)
    assert rows(living.groups.read("relations").select(related.columns)) == rows(related)
    r = SummedRun(whole, ["new"])
    assert rows(living.claims.read("sums").select(r.sums.columns)) == rows(r.sums)
    assert rows(living.claims.read("hygiene").select("claim_id", "status")) == rows(r.hygiene)
    changes = {(x.change, x.claims, x.other_claims, x.before, x.after) for x in diff.map_changes(old, living.ideas()).collect()}
    assert changes == {("idea_added", "n1", None, None, "novel"), ("contest_introduced", "n1", "c2", None, "contests"), ("support_introduced", "n1", "c1", None, "supports")}


def test_differences_are_null_safe(spark):
    schema = "idea_id string, group_name string, paper_id string, claim_ids array<string>, status string"
    related = "group_name string, idea_a string, idea_b string, kind string"
    before = spark.createDataFrame([("i1", "g", None, ["a"], "established"), ("i2", "g", "p", ["b", "c"], "established"), ("i3", None, "q", ["d"], "contested")], schema)
    after = spark.createDataFrame([("j9", "g", None, ["a"], "contested"), ("j2", "g", "p", ["b"], "novel"), ("j3", None, "q", ["d"], "contested")], schema)
    old = spark.createDataFrame([("g", "i1", "i2", "supports"), ("g", "i2", "i1", "supports")], related)
    new = spark.createDataFrame([("g", "j9", "j2", "contests"), ("g", "j2", "j9", "contests")], related)
    got = sorted(((r.change, r.claims, r.before, r.after) for r in diff.map_changes((before, old), (after, new)).collect()), key=lambda x: x[0])
    assert got == [("contest_introduced", "a", None, "contests"), ("idea_added", "b", None, "novel"), ("idea_removed", "b,c", "established", None), ("status_changed", "a", "established", "contested"), ("support_gone", "a", "supports", None)]
    same = diff.map_changes((before, old), (before, old))
    assert same.count() == 0


def test_queries_keep_what_they_ask_for(spark, monkeypatch):
    """Groups without claims' sums, claims without ideas; histories and sums without a row for a propagated edge."""
    from claimloom.operators import edges, propagation
    from claimloom.plans.queries import QUERIES

    def never(*_):
        raise AssertionError

    data = "/root/testdata/sf0.001"
    with monkeypatch.context() as patch:
        patch.setattr(propagation, "propagated", never)
        patch.setattr(edges, "wired_predictions", never)
        assert QUERIES["living_status"](spark, data).count() > 0
    with monkeypatch.context() as patch:
        patch.setattr(subjects, "ideas", never)
        patch.setattr(edges, "semantic_edges", never)
        assert QUERIES["living_sums"](spark, data).count() > 0
        assert QUERIES["claim_history"](spark, data).count() > 0


def test_open_predictions_meet_evidence_by_shares(spark):
    m = make(spark, [("c1", "p1", []), ("c2", "p2", [])], [("c1", "x", 1, [], None), ("c2", "x", 0, ["e7", None], None)], [(f"e{i}", "p1", "x", 1) for i in range(200)])
    from claimloom.operators import edges

    found = edges.prediction_edges(m)
    assert sorted(r["count"] for r in found.groupBy("claim_id").count().collect()) == [1, 200]
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "(observable#" in x]
    assert len(joins) == 2 and any("share#" in x for x in joins)


def test_fingerprints_add_up_hashes(spark):
    rows_ = spark.range(1000).selectExpr("'u' as unit", "id", "cast(id as string) as s")
    want = [sum(r[i] for r in rows_.select(F.xxhash64("id", "s"), F.xxhash64(F.lit("second"), "s", "id")).collect()) % 2**62 for i in (0, 1)]
    got = fingerprints(rows_, "unit").first()
    assert (got.h_1, got.h_2, got.n) == (*want, 1000)
