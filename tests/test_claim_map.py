"""Operators of the claim map on small hand-made maps: order rules, thresholds, empties, ties."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import cliques, edges, optimize, residuals, situate, stance, state, subjects
from claimloom.sources import records, sinks
from claimloom.sources.model import CLAIM, DIMENSION, EVIDENCE, MEMBER, PREDICTION, ClaimMap
from claimloom.streaming.situate import FINDING, situate_stream


def make(spark, claims=(), predictions=(), evidence=(), members=(), dims=None) -> ClaimMap:
    """claims: (id, paper, keywords); predictions: (claim, observable, value, targets, tag); evidence: (id, paper, name, value); members: (group, evidence)."""
    counts: dict[str, int] = {}

    def nth(key):
        counts[key] = counts.get(key, -1) + 1
        return counts[key]

    c = [(i, p, f"label {i}", n, "sys", "frame", list(k), 1.0, 1.0, 1.0, 1.0, 0.9) for n, (i, p, k) in enumerate(claims)]
    p = [(i, nth("p" + i), o, float(v), None, list(t), tag) for i, o, v, t, tag in predictions]
    e = [(i, q, f"Label {i}", n, "Tokamak", "fluid", "Linear", 0.6) for n, (i, q, _, _) in enumerate(evidence)]
    d = [(i, nth("d" + i), o, float(v), None) for i, _, o, v in evidence] + [(i, nth("d" + i), o, float(v), None) for i, o, v in dims or []]
    m = [(g, g.title(), "", nth("m" + g), i) for g, i in members]
    frame = spark.createDataFrame
    return ClaimMap(frame(c, CLAIM), frame(p, PREDICTION), frame(e, EVIDENCE), frame(d, DIMENSION), frame(m, MEMBER))


def full(m: ClaimMap):
    return residuals.scored(residuals.wired(m, edges.all_edges(m)))


def test_observables_join_and_tags(spark):
    m = make(spark, [("c1", "p1", []), ("c2", "p2", ["LINEAR"]), ("c3", "p3", ["other"])],
             [("c1", "x", 1, [], None), ("c2", "x", 0, [], None), ("c3", "x", 0.5, ["e2"], ""), ("c3", "y", 1, ["e1"], None)],
             [("e1", "p1", "x", 1), ("e2", "p2", "x", 0)])
    got = {r.edge_id: (r.regime_tag, r.confidence) for r in edges.prediction_edges(m).collect()}
    assert got == {"c1__e1": ("in_regime", 0.6), "c1__e2": ("out_of_regime", 0.6), "c2__e1": ("in_regime", 0.6), "c2__e2": ("in_regime", 0.6), "c3__e2": ("out_of_regime", 0.6)}
    assert [tuple(r) for r in edges.observable_groups(m.dimensions).collect()] == [("x", ["e1", "e2"])]


def test_first_edge_wins_and_explicit_tag(spark):
    m = make(spark, [("c", "p", [])], [("c", "x", 0.2, ["e"], "out_of_regime"), ("c", "x", 0.9, ["e"], None), ("c", "y", 0.4, ["e"], None)], [("e", "p", "x", 1)], dims=[("e", "y", 0)])
    rows = edges.prediction_edges(m).collect()
    assert [(r.pred_value, r.regime_tag) for r in rows] == [(0.2, "out_of_regime")]
    assert [r.value for r in subjects.explicit_stance(make(spark, [("c", "p", [])], [("c", "x", 0.2, ["e"], None), ("c", "x", 0.9, ["e"], None)], [("e", "p", "x", 1)], [("g", "e")])).collect()] == [0.9]


def test_semantic_edges(spark):
    m = make(spark, [("c", "p", []), ("d", "q", [])], [("c", "h", 0.3, ["home", "aimed"], None), ("d", "h", 1, ["home"], None)],
             [("home", "p", "h", 0), ("aimed", "q", "k", 1), ("far", "r", "k", 1)], [("g", "home"), ("g", "aimed"), ("g", "far"), ("g", "absent"), ("g2", "far"), ("g2", "home")])
    rows = sorted((r.edge_id, r.group_name, r.pred_value, r.observable, r.regime_tag) for r in edges.semantic_edges(m, edges.prediction_edges(m)).collect())
    assert rows == [("c__far__semantic", "g", 0.3, "k", "out_of_regime"), ("c__far__semantic", "g2", 0.3, "k", "out_of_regime")]
    assert edges.semantic_edges(m, edges.prediction_edges(m), ["q"]).count() == 0


def test_tie_goes_to_the_larger_strength(spark):
    m = make(spark, [("c", "p", [])], [("c", "x", 1, ["e"], None)], [("e", "q", "x", 0)])
    best = optimize.rewrites(residuals.wired(m, edges.all_edges(m)), m.claims.withColumn("lambda", F.lit(1.0))).collect()
    assert [(r.to_out, round(r.objective, 9), r.changed, round(r.distance, 9)) for r in best] == [(0.6, 0.52, True, 0.4)]


def test_costly_claims_stay(spark):
    m = make(spark, [("c", "p", []), ("n", "new", [])], [("c", "x", 1, ["e"], None), ("n", "x", 1, ["e"], None)], [("e", "q", "x", 0)])
    wired = residuals.wired(m, edges.all_edges(m))
    cost = optimize.costs(m.claims, spark.createDataFrame([("c", 3)], "claim_id string, stature long"), ["new"])
    assert {r.claim_id: (r.stature, r["lambda"]) for r in cost.collect()} == {"c": (3, 25.0), "n": (0, 0.3)}
    best = optimize.rewrites(wired, cost)
    assert {r.claim_id: r.to_out for r in best.collect()} == {"c": 1.0, "n": 0.2}
    done = residuals.scored(optimize.apply(wired, best), "final_in", "final_out")
    assert [r.claim_id for r in optimize.operations(best).collect()] == ["n"]
    assert [(r.edge_id, r.residual_sq) for r in state.remaining_tensions(done).collect()] == [("c__e", 1.0)]
    assert optimize.surviving_at(done, m.evidence.where("evidence_id = 'e'")).count() == 2


def test_thresholds(spark):
    root = 0.05**0.5
    m = make(spark, [("c", "p", [])], [("c", "x", 0, ["at"], None), ("c", "y", 0, ["over"], None)], [("at", "q", "x", root - 1e-9), ("over", "r", "y", root + 1e-9)])
    assert [r.stature for r in optimize.stature(full(m)).collect()] == [1]
    assert [r.stature for r in optimize.stature(full(m), agreeing=False).collect()] == [2]
    n = make(spark, [("a", "p", []), ("b", "q", []), ("d", "r", [])], [("a", "x", 0.5, ["e"], None), ("b", "x", 0.56, ["e"], None), ("d", "x", 0.46, ["e"], None)], [("e", "p", "x", 0.5)], [("g", "e")])
    kinds = {(r.idea_a[-1], r.idea_b[-1]): r.kind for r in subjects.relations(subjects.ideas(n)).collect()}
    assert kinds[("1", "2")] == kinds[("2", "1")] == "contests" and kinds[("1", "3")] == "supports" and len(kinds) == 6


def test_ideas_status_and_subjects(spark):
    m = make(spark, [("c2", "old", ["k2"]), ("c1", "old", ["k1"]), ("n1", "new", []), ("n2", "new", []), ("lone", "old", [])],
             [("c2", "x", 1, ["e"], None), ("c1", "x", 1, ["e"], None), ("n1", "x", 0, ["e"], None), ("n2", "x", 1, ["e"], None)],
             [("e", "old", "x", 1), ("f", "old", "x", 1)], [("a_absent", "nowhere"), ("g", "e"), ("g", "f")])
    found = subjects.ideas(m)
    related = subjects.relations(found)
    status = subjects.with_status(found, related, ["new"])
    assert {r.idea_id: (r.claim_ids, r.status) for r in status.collect()} == {"idea_g_001": (["c1", "c2"], "contested"), "idea_g_002": (["n1"], "novel"), "idea_g_003": (["n2"], "contested")}
    assert {r.idea_id: r.title for r in status.collect()}["idea_g_001"] == "old (c1, c2): label c2"
    tension = subjects.tensions(status, related).collect()
    assert sorted((r.idea_one, r.idea_two, r.papers_yes, r.papers_no) for r in tension) == [("idea_g_001", "idea_g_002", "new", "old"), ("idea_g_002", "idea_g_003", "new", "new")]
    rolled = subjects.subjects(m, status)
    row = rolled.collect()[0]
    assert (row.subject_id, row.claims, row.evidence, row.regime, row.novel, row.contested) == ("subject_02_g", ["c1", "c2", "n1", "n2"], ["e"], "k1, k2", 1, 2)
    assert {(r.subject_id, r.kind, r.id) for r in subjects.ungrouped(m, rolled).collect()} == {("subject_02_ungrouped", "evidence", "f"), ("subject_02_ungrouped", "claim", "lone")}
    assert subjects.next_steps(status, related).count() == 9
    assert {(r.priority, r.ideas) for r in subjects.open_questions(rolled).collect()} == {("blocking", 1), ("high", 2), ("exploratory", 3)}


def test_hygiene(spark):
    m = make(spark, [("bad", "p", []), ("fine", "p", []), ("scoped", "p", []), ("none", "p", [])],
             [("bad", "x", 1, ["e"], None), ("fine", "x", 0, ["e"], None), ("scoped", "x", 1, ["e", "f"], None)], [("e", "p", "x", 1), ("f", "q", "y", 0)], [("g", "e"), ("g", "f")])
    got = {r.claim_id: (r.status, r.groups_touched, r.groups_addressed) for r in state.hygiene(m, full(m)).collect()}
    assert got == {"bad": ("implicit_headline", ["g"], []), "fine": ("consensus_aligned", ["g"], []), "scoped": ("scoped_explicit", ["g"], ["g"]), "none": ("not_applicable", [], [])}
    assert {r.claim_id: r.status for r in state.hygiene(m, full(m), compat=True).collect()}["scoped"] == "not_applicable"


def test_empty_maps(spark):
    m = make(spark)
    assert edges.all_edges(m).count() == 0 and residuals.total(full(m)).collect()[0].residual_total == 0.0
    n = make(spark, [("c", "p", [])], [], [("e", "q", "x", 1)])
    found = subjects.subjects(n, subjects.with_status(subjects.ideas(n), subjects.relations(subjects.ideas(n)), []))
    assert found.count() == 0 and subjects.ungrouped(n, found).count() == 2
    best = optimize.rewrites(residuals.wired(n, edges.all_edges(n)), n.claims.withColumn("lambda", F.lit(1.0)))
    row = state.summary(n, full(n), full(n), optimize.operations(best)).collect()[0]
    assert (row.claims, row.edges, row.initial_residual, row.rewrites) == (1, 0, 0.0, 0)


def test_dangling_edge_is_an_error(spark):
    m = make(spark, [("c", "p", [])], [("c", "x", 1, [], None)], [("e", "q", "x", 1)])
    broken = edges.prediction_edges(m).withColumn("claim_id", F.lit("gone"))
    with pytest.raises(Exception, match="edge without its claim"):
        residuals.wired(m, broken).select("actual").collect()


def test_stances_and_coherence(spark):
    m = make(spark, [("a", "p", []), ("b", "p", []), ("c", "q", [])],
             [("a", "x", 1, ["e"], None), ("b", "x", 0.99, ["e", "f"], None), ("c", "x", 0, ["f"], None)], [("e", "p", "x", 1), ("f", "q", "x", 0), ("h", "r", "x", 1)], [("g", "e"), ("g", "f"), ("g", "h")])
    got = {(r.claim_id, r.evidence_id): (r.value, r.explicit) for r in stance.stances(m).collect()}
    assert got[("a", "f")] == (1.0, False) and got[("b", "f")] == (0.99, True) and got[("c", "e")] == (0.0, False) and len(got) == 9
    assert [tuple(r) for r in stance.coherent(stance.stances(m), "claim_id").collect()] == [("a", "b", 3)]
    papers = {(r.paper_id, r.evidence_id): (r.value, r.explicit) for r in stance.paper_stances(m).collect()}
    assert papers[("p", "e")] == (0.99, True) and papers[("p", "h")] == (1.0, False)
    assert {(r.direction, r.n_papers, tuple(r.supporting), tuple(r.contesting)) for r in stance.direction_buckets(m).collect()} == {("positive", 1, ("e",), ("f",)), ("negative", 1, ("f",), ())}
    assert [(r.papers_yes, r.papers_no, r.in_tension) for r in stance.assertions(stance.direction_buckets(m)).collect()] == [(["p"], ["q"], True)]
    assert sorted(r["size"] for r in stance.equivalence(stance.stances(m), "claim_id").collect()) == [1, 1, 1]


def test_cliques(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdz"], "node string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "a string, b string")
    assert sorted(r.clique for r in cliques.maximal_cliques(nodes, pairs).collect()) == ["a|b|c", "c|d", "z"]
    assert [r["size"] for r in cliques.maximal_cliques(nodes.limit(0), pairs.limit(0)).collect()] == [0]
    hub = spark.createDataFrame([("a", x) for x in "bcd"], "a string, b string")
    assert sorted(r.clique for r in cliques.maximal_cliques(nodes, hub).collect()) == ["a|b", "a|c", "a|d", "z"]


def test_cliques_of_random_graphs(spark):
    """Against a plain search over all sets of nodes; twins and nodes without edges included."""
    import itertools
    import random

    draw = random.Random(4)
    for n, share in ((7, 0.3), (9, 0.6), (9, 0.9)):
        names = [f"n{i}" for i in range(n)]
        pairs = {(a, b) for a, b in itertools.combinations(names, 2) if draw.random() < share}
        full_sets = [set(c) for k in range(1, n + 1) for c in itertools.combinations(names, k) if all(p in pairs for p in itertools.combinations(c, 2))]
        expected = sorted("|".join(sorted(c)) for c in full_sets if not any(c < d for d in full_sets))
        got = cliques.maximal_cliques(spark.createDataFrame([(x,) for x in names], "node string"), spark.createDataFrame(list(pairs), "a string, b string"))
        assert sorted(r.clique for r in got.collect()) == expected


def test_coherence_against_all_pairs(spark):
    import itertools
    import random

    draw = random.Random(6)
    rows = [(f"c{i}", draw.choice("gh"), f"e{e}", draw.choice([0.5, 0.53, 0.56])) for i in range(14) for e in range(4) if draw.random() < 0.8]
    rows = list({(c, e): (c, g, e, v) for c, g, e, v in rows}.values()) + [(f"t{i}", "g", f"e{e}", 0.5) for i in range(3) for e in range(3)]
    held: dict = {}
    for c, g, e, v in rows:
        held.setdefault(c, {})[g, e] = v
    expected = set()
    for a, b in itertools.combinations(sorted(held), 2):
        both = held[a].keys() & held[b].keys()
        if len(both) >= 2 and all(abs(held[a][k] - held[b][k]) < 0.05 for k in both):
            expected.add((a, b, len(both)))
    got = stance.coherent(spark.createDataFrame(rows, "claim_id string, group_name string, evidence_id string, value double"), "claim_id").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_situate(spark):
    prior = make(spark, [("c1", "p1", []), ("c2", "p2", [])], [("c1", "x", 1, [], None), ("c2", "x", 1, [], None)], [("e1", "p1", "x", 1)])
    new = make(spark, [("n", "p3", [])], [("n", "x", 0, [], None)], [("odd", "p3", "x", 0), ("mild", "p3", "x", 0.8)])
    rows = situate.situated(prior, new)
    got = {r.evidence_id: (r.independent_papers, r.verdict, r.leans_on) for r in situate.verdicts(rows, prior, new).collect()}
    assert got == {"odd": (2, "suspect", ["n"]), "mild": (0, "credible", ["n"])}
    best, left = situate.accommodation(rows)
    assert best.count() == 3 and left.count() > 0


def test_situate_stream(spark, tmp_path):
    prior = make(spark, [("c1", "p1", []), ("c2", "p2", [])], [("c1", "x", 1, [], None), ("c2", "x", 1, [], None)], [("e1", "p1", "x", 1)])
    finding = [("odd", "p3", "l", "s", "f", "r", 0.5, "x", 0.0, None)]
    spark.createDataFrame(finding, FINDING).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(FINDING).parquet(f"{tmp_path}/in")
    out: dict = {}
    situate_stream(stream, prior, lambda df, n: out.update({n: df.collect()}), f"{tmp_path}/check").awaitTermination(120)
    assert [(r.evidence_id, r.verdict) for r in out[0]] == [("odd", "suspect")]


def test_records_and_sinks(spark, tmp_path):
    for kind in ("claims", "evidence"):
        (tmp_path / kind).mkdir()
    claim = {"claim_id": "c", "paper_id": "p", "label": "l", "x_init": [1.0, 0.8], "home_regime": {"system": "s", "regime_keywords": ["k"]}, "predictions": [{"observable": "x", "value": 1.0, "evidence_ids": ["e"]}], "provenance": {"confidence": 0.7}}
    evidence = {"evidence_id": "e", "paper_id": "p", "core": {"dimensions": [{"name": "x", "value": 0.5}]}, "context": {"system": "s"}}
    (tmp_path / "claims/c.json").write_text(json.dumps(claim, indent=2))
    (tmp_path / "evidence/e.json").write_text(json.dumps(evidence, indent=2))
    (tmp_path / "groups.json").write_text(json.dumps({"version": 1, "groups": {"new": {"title": "T", "members": ["e", "f"]}, "old": ["e"]}}, indent=2))
    m = records.read_run(spark, str(tmp_path), str(tmp_path / "groups.json"))
    assert [(r.edge_id, r.confidence, r.regime_tag) for r in edges.all_edges(m).where("not is_semantic").collect()] == [("c__e", 0.5, "in_regime")]
    assert {(r.group_name, r.title, r.member_seq, r.evidence_id) for r in m.members.collect()} == {("new", "T", 0, "e"), ("new", "T", 1, "f"), ("old", "old", 0, "e")}
    assert records.read_registry(spark, None).count() == 0
    (tmp_path / "broken.json").write_text('{"groups": [')
    with pytest.raises(Exception, match="no groups can be read"):
        records.read_registry(spark, str(tmp_path / "broken.json")).collect()
    sinks.write_tables({"edges": edges.all_edges(m)}, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/edges").count() == 1
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_tables({"edges": edges.all_edges(m)}, f"{tmp_path}/out")
    sinks.write_tables({"edges": edges.all_edges(m)}, f"{tmp_path}/out", force=True, as_json=True)


def test_extract_and_scan(spark, tmp_path):
    for name in ("Known Paper.PDF", "other_eigen.pdf", "x.txt"):
        (tmp_path / name).write_bytes(b"-")
    files = records.scan_files(spark, str(tmp_path))
    assert sorted((r.stem, r.file_seq) for r in files.collect()) == [("known_paper", 0), ("other_eigen", 1)]
    seeds = make(spark, [("k1", "known", []), ("k2", "known", [])])
    rules = spark.createDataFrame([("known_paper", "known", 1)], "pattern string, paper_id string, priority int")
    got = {(r.stem, r.claim_id, r.confidence) for r in records.extract(files.select("stem"), seeds, rules).collect()}
    assert got == {("known_paper", "k1", 0.9), ("known_paper", "k2", 0.9), ("other_eigen", "other_eigen_C01", 0.25)}


def test_seeded_records_of_files(spark):
    seeds = make(spark, [("a1", "A", ["x"]), ("b1", "B", []), ("b2", "B", [])], [("a1", "o", 1, ["e1"], "in_regime"), ("b2", "o", 0, ["e2"], None)], [("e1", "A", "o", 1), ("e2", "B", "o", 0), ("e3", "C", "o", 0)], [("g", "e1")])
    rules = spark.createDataFrame([("alpha", "A", 1), ("beta", "B", 1), ("gamma", "C", 1)], "pattern string, paper_id string, priority int")
    files = spark.createDataFrame([("beta_one", 0), ("new", 5), ("beta_two", 2), ("new", 3), ("gamma", 4), (None, 6), ("", 7)], "stem string, file_seq int")
    m = records.extract_map(files, seeds, rules)
    got = sorted((r.claim_id, r.paper_id, r.claim_seq, r.confidence, r.keywords) for r in m.claims.collect())
    assert got == [("b1", "B", 1, 0.9, []), ("b2", "B", 2, 0.9, []), ("gamma_C01", "gamma", 7, 0.25, []), ("new_C01", "new", 6, 0.25, [])]
    assert [r.claim_id for r in m.predictions.collect()] == ["b2"] and [r.evidence_id for r in m.evidence.collect()] == ["e2"]
    assert [r.edge_id for r in edges.prediction_edges(m).collect()] == ["b2__e2"]
    none = records.extract_map(files.limit(0), seeds, rules)
    assert none.claims.count() == none.evidence.count() == 0
    alone = records.extract_map(files, make(spark), rules.limit(0))
    assert sorted((r.claim_id, r.claim_seq) for r in alone.claims.collect()) == [("beta_one_C01", 0), ("beta_two_C01", 2), ("gamma_C01", 4), ("new_C01", 3)]


def test_result_does_not_depend_on_row_order(spark):
    args = ([("a", "p", []), ("b", "q", [])], [("a", "x", 1, ["e", "f"], None), ("b", "x", 0, ["f"], None), ("a", "x", 0.4, ["f"], None)], [("e", "p", "x", 1), ("f", "q", "x", 0)], [("g", "e"), ("g", "f")])
    m = make(spark, *args)
    shuffled = ClaimMap(*(getattr(m, t).repartition(3).orderBy(F.rand(1)) for t in ("claims", "predictions", "evidence", "dimensions", "members")))
    rows = lambda x: sorted((r.edge_id, r.residual_sq) for r in full(x).collect())
    assert rows(m) == rows(shuffled)
