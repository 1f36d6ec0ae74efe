"""A map of 30 claims, 25 observations and 5 groups with known results, read from indented files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import edges, optimize, residuals, state, subjects
from claimloom.plans.run_state import Run, claim_history, state_tables
from claimloom.sources import records, sinks

#: Paper and observed value of each evidence; paper and predictions (evidence, value, in its regime) of each claim; groups.
EVIDENCE = [(0, 0.85), (0, 0), (1, 1), (1, 0), (1, 1), (1, 0), (1, 1), (1, 1), (1, 1), (2, 0), (3, 0), (4, 1), (6, 1), (8, 1), (9, 0), (11, 1), (5, 1), (12, 1), (14, 0), (15, 0), (16, 1), (17, 1), (18, 1), (19, 0), (20, 1)]
CLAIMS = [
    (0, [(1, 0, 1), (6, 0, 0)]), (0, [(0, 0.85, 1)]), (1, [(6, 1, 1), (2, 1, 1), (3, 0, 1), (5, 0, 1)]), (1, [(4, 1, 1), (5, 0, 1), (1, 0, 0)]), (1, [(4, 1, 1)]),
    (1, [(6, 1, 1), (7, 1, 1), (13, 1, 1), (15, 1, 1)]), (1, [(6, 1, 1), (8, 1, 1), (2, 1, 1), (18, 0, 0), (1, 0, 0), (9, 0, 0), (14, 0, 0), (10, 0, 0)]), (1, [(6, 1, 1)]),
    (1, [(4, 1, 1), (6, 1, 1), (11, 1, 1), (17, 1, 1)]), (3, [(10, 0, 1), (14, 0, 0)]), (2, [(9, 0, 1), (6, 0, 0)]), (4, [(11, 1, 1)]), (5, [(16, 1, 1), (10, 0, 0)]),
    (6, [(12, 1, 1), (21, 1, 0)]), (7, [(16, 1, 1)]), (8, [(13, 1, 1), (8, 1, 1)]), (9, [(14, 0, 1)]), (9, [(14, 0, 1), (6, 1, 0)]), (10, [(15, 1, 1)]), (11, [(15, 1, 1), (14, 0, 0)]),
    (13, [(19, 0, 0)]), (12, [(17, 1, 1), (4, 1, 0)]), (14, [(18, 0, 1), (6, 0, 0), (5, 0, 1)]), (14, [(18, 0, 1), (7, 1, 1)]), (15, [(19, 0, 1), (6, 1, 0)]),
    (16, [(20, 1, 1), (6, 1, 0)]), (17, [(21, 1, 1), (0, 0.85, 0)]), (18, [(22, 1, 1)]), (19, [(23, 0, 1)]), (20, [(24, 1, 1)])]
GROUPS = {"beltrami": [11, 17, 4], "continuum": [13, 15], "m0": [0, 12, 21, 22, 24], "m1": [6, 1, 9, 18, 14, 10], "numerical": [16, 2, 8, 7]}
NEW = "paper01"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    for kind in ("claims", "evidence"):
        (folder / kind).mkdir()
    for i, (paper, value) in enumerate(EVIDENCE):
        body = {"evidence_id": f"e{i:02}", "paper_id": f"paper{paper:02}", "label": f"observation {i}", "core": {"dimensions": [{"name": f"e{i:02}", "value": value}]}, "context": {"system": "s"}}
        (folder / f"evidence/e{i:02}.json").write_text(json.dumps(body, indent=2))
    for i, (paper, said) in enumerate(CLAIMS, 1):
        predictions = [{"observable": f"e{e:02}", "value": v, "evidence_ids": [f"e{e:02}"], "regime_tag": "in_regime" if inside else "out_of_regime"} for e, v, inside in said]
        body = {"claim_id": f"c{i:02}", "paper_id": f"paper{paper:02}", "label": f"claim {i}", "x_init": [1.0, 1.0], "home_regime": {"system": "s", "regime_keywords": []}, "predictions": predictions}
        (folder / f"claims/c{i:02}.json").write_text(json.dumps(body, indent=2))
    groups = {g: {"title": g.title(), "members": [f"e{i:02}" for i in members]} for g, members in GROUPS.items()}
    (folder / "groups.json").write_text(json.dumps({"version": 2, "groups": groups}, indent=2))
    return Run(records.read_run(spark, str(folder), str(folder / "groups.json")), [NEW])


def test_edges_residuals_and_rewrites(run):
    row = state.summary(run.map, run.full, run.final, optimize.operations(run.best)).collect()[0]
    assert (row.claims, row.evidence, row.edges, row.semantic_edges) == (30, 25, 151, 88)
    assert (round(row.initial_residual, 4), round(row.final_residual, 4), row.rewrites, row.rewrite_distance) == (26.1575, 6.1575, 4, 4.0)
    done = {r.claim_id: (r.to_in, r.to_out, r["lambda"], r.initial_residual, r.final_residual, round(r.objective, 9), r.distance) for r in optimize.operations(run.best).collect()}
    assert done == {c: (1.0, 0.0, 0.3, 5.0, 0.0, 0.3, 1.0) for c in ("c03", "c06", "c08", "c09")}


def test_standing_and_hygiene(run):
    top = [(r.claim_id, r.stature) for r in run.stature.orderBy(F.desc("stature"), "claim_id").limit(8).collect()]
    assert top == [("c07", 7), ("c18", 6), ("c23", 6), ("c24", 6), ("c01", 5), ("c02", 5), ("c10", 5), ("c11", 5)]
    status = {r.claim_id: r.status for r in state.hygiene(run.map, run.full).collect()}
    assert {c for c, s in status.items() if s == "implicit_headline"} == {"c03", "c06", "c08", "c09"}
    assert sum(s == "consensus_aligned" for s in status.values()) == 20


def test_ideas_and_what_stays_ungrouped(run):
    got = {r.group_name: (r.established, r.contested, r.novel) for r in run.subjects.collect()}
    assert got == {"beltrami": (2, 0, 2), "continuum": (3, 0, 1), "m0": (5, 0, 0), "m1": (5, 7, 2), "numerical": (5, 0, 2)}
    merged = [r.status for r in run.status.where("group_name = 'm1'").collect() if r.claim_ids == ["c03", "c06", "c08", "c09"]]
    assert merged == ["contested"]
    left = {r.id for r in subjects.ungrouped(run.map, run.subjects).where("kind = 'evidence'").collect()}
    assert left == {"e03", "e05", "e19", "e20", "e23"}


def test_the_map_without_the_new_paper(run):
    """Targets that are gone are ignored; nothing is rewritten."""
    prior = Run(run.map.of_papers([NEW], keep=False), [])
    row = state.summary(prior.map, prior.full, prior.final, optimize.operations(prior.best)).collect()[0]
    assert (row.claims, row.evidence, row.edges, row.semantic_edges, row.rewrites) == (23, 18, 77, 49, 0)
    assert round(row.initial_residual, 4) == round(row.final_residual, 4) == 0.1575
    assert {r.group_name: r.established for r in prior.subjects.collect()}["m1"] == 7


def test_history_of_claims_over_two_versions(run):
    """Nothing is rewritten before the new paper comes; a third version that is the second again changes nothing."""
    prior = Run(run.map.of_papers([NEW], keep=False), [])
    got = {(r.claim_id, r.version, r.from_out, r.to_out, r.final_residual) for r in claim_history([prior, run, run]).collect()}
    assert got == {(c, 2, 1.0, 0.0, 0.0) for c in ("c03", "c06", "c08", "c09")}
    back = {(r.claim_id, r.version, r.from_out, r.to_out) for r in claim_history([run, prior]).collect()}
    assert back == {(c, 1, 1.0, 0.0) for c in ("c03", "c06", "c08", "c09")}
    prior.release()


def test_ideas_in_order_and_scope(run):
    status = run.status.persist()
    told = sorted(subjects.in_order(status).collect(), key=lambda r: (r.group_name, r.place))
    want = sorted(status.collect(), key=lambda r: (r.group_name, r.status_rank, r.idea_id))
    assert [r.idea_id for r in told] == [r.idea_id for r in want]
    assert {g: max(r.place for r in told if r.group_name == g) for g in GROUPS} == {g: sum(r.group_name == g for r in want) for g in GROUPS}
    status.unpersist()
    assert {(r.system, r.framework, r.regime) for r in subjects.scope(run.subjects).collect()} == {("s", "", "")}


def test_flat_costs_on_base_edges(run):
    base = residuals.wired(run.map, edges.prediction_edges(run.map))
    assert round(residuals.total(residuals.scored(base)).collect()[0].residual_total, 9) == 3.0
    best = optimize.operations(optimize.rewrites(base, run.map.claims.withColumn("lambda", F.lit(1.0)))).collect()
    assert {r.claim_id: (r.to_out, round(r.final_residual, 9)) for r in best} == {c: (0.6, 0.36) for c in ("c01", "c11", "c23")}


def test_the_state_of_a_run_is_written_once(run, spark, tmp_path):
    tables = {n: df for n, df in state_tables(run).items() if n in ("summary", "operations", "objective")}
    sinks.write_run(tables, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/operations").count() == 4
    with pytest.raises(FileExistsError):
        sinks.write_run(tables, f"{tmp_path}/out")
    (tmp_path / "out/notes").mkdir()
    sinks.write_run({n: tables[n] for n in ("summary", "operations")}, f"{tmp_path}/out", force=True)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"summary", "operations", "notes"}  # what Spark has not written stays
    assert {"claim_vertices", "evidence_vertices", "idea_order", "edges", "tensions", "claims", "evidence", "papers", "hygiene", "subjects", "ideas", "relations", "next_steps", "open_questions"} <= set(state_tables(run))
