"""A run: a map, what is derived from it, and the named tables of its state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import constants as K
from claimloom.operators import edges, history, optimize, propagation, residuals, state, subjects, views
from claimloom.sources.model import ClaimMap
from claimloom.sources.scratch import settle


class Run:
    """A map and what is derived from it, each made when asked for; the wired edges are kept, as most others read them."""

    def __init__(self, m: ClaimMap, incoming: list[str]):
        self.map, self.incoming = m, incoming
        self.base = edges.prediction_edges(m)
        self.wired = residuals.wired(m, edges.all_edges(m)).persist()
        self.full = residuals.scored(self.wired)

    def release(self) -> None:
        """Give up the kept edges; what still reads them makes them again."""
        self.wired.unpersist()

    @property
    def stature(self) -> DataFrame:
        return optimize.stature(self.full)

    @property
    def costs(self) -> DataFrame:
        return optimize.costs(self.map.claims, self.stature, self.incoming)

    @property
    def best(self) -> DataFrame:
        return optimize.rewrites(self.wired, self.costs)

    @property
    def final(self) -> DataFrame:
        return residuals.scored(optimize.apply(self.wired, self.best), "final_in", "final_out")

    @property
    def ideas(self) -> DataFrame:
        return subjects.ideas(self.map)

    @property
    def relations(self) -> DataFrame:
        return subjects.relations(self.ideas)

    @property
    def status(self) -> DataFrame:
        return subjects.with_status(self.ideas, self.relations, self.incoming)

    @property
    def subjects(self) -> DataFrame:
        return subjects.subjects(self.map, self.status)


class SummedRun:
    """What claims add up to, for maps whose propagated edges are too many to make: no property has a row for such an edge."""

    def __init__(self, m: ClaimMap, incoming: list[str]):
        self.map, self.incoming = m, incoming
        # read by several steps: written once
        self.base = settle(edges.wired_predictions(m).select(*propagation.USED), "base-edges")
        self.sums = settle(propagation.propagated(m, self.base), "claim-sums")

    @property
    def stature(self) -> DataFrame:
        return self.sums.where("stature > 0").select("claim_id", "stature")

    @property
    def costs(self) -> DataFrame:
        return optimize.costs(self.map.claims, self.stature, self.incoming)

    @property
    def best(self) -> DataFrame:
        states = self.map.claims.select("claim_id", "init_in", "init_out", "final_in", "final_out")
        return optimize.cheapest(self.sums.select("claim_id", "r_in", "r_out").join(states, "claim_id"), self.costs)

    @property
    def hygiene(self) -> DataFrame:
        return state.hygiene_of_sums(self.map, self.sums)


def claim_history(versions: list[Run] | list[SummedRun]) -> DataFrame:
    """claim_id, version (from 1), from_in, from_out, to_in, to_out, final_residual, lambda: how claims' states changed from version to version.

    versions: a map as it changed. Claims start from the initial states of their first version; a version that has no edge of a claim, or leaves its
    state, has no row for it.
    """
    begun = told = None
    for n, run in enumerate(versions, 1):
        claims = run.map.claims.select("claim_id", F.struct(F.lit(n).alias("version"), "init_in", "init_out").alias("init"))
        states = run.best.select("claim_id", F.lit(n).alias("version"), "to_in", "to_out", "final_residual", "lambda")
        begun, told = (claims, states) if begun is None else (begun.unionByName(claims), told.unionByName(states))
    start = begun.groupBy("claim_id").agg(F.min("init").alias("init")).select("claim_id", F.lit(0).alias("version"), F.col("init.init_in").alias("to_in"), F.col("init.init_out").alias("to_out"))
    log = start.unionByName(told, allowMissingColumns=True)
    changed = history.changes(log, "claim_id", "version", "version", ["to_in", "to_out"]).where("version > 0")
    return changed.select("claim_id", "version", F.col("was_to_in").alias("from_in"), F.col("was_to_out").alias("from_out"), "to_in", "to_out", "final_residual", "lambda")


def state_tables(r: Run) -> dict[str, DataFrame]:
    """What a run leaves behind, a table each."""
    hygiene = state.hygiene(r.map, r.full)
    settings = [(K.LAMBDA_FLAT, K.LAMBDA_BASE, K.ALPHA, K.INCOMING_DISCOUNT, 0.0, ",".join(sorted(r.incoming)))]
    return {
        "summary": state.summary(r.map, r.full, r.final, optimize.operations(r.best)),
        "objective": r.map.claims.sparkSession.createDataFrame(settings, "lambda_claim double, lambda_base double, alpha double, incoming_discount double, context_fill_distance double, incoming string"),
        "claim_vertices": r.map.claims.select("claim_id", "claim_seq"), "evidence_vertices": r.map.evidence.select("evidence_id", "ev_seq"), "idea_order": subjects.in_order(r.status),
        "observable_groups": edges.observable_groups(r.map.dimensions),
        "edges": r.final, "initial_residuals": r.full.select("edge_id", "group_name", "strength", "predicted", "residual", "residual_sq"),
        "operations": optimize.operations(r.best), "tensions": state.remaining_tensions(r.final),
        "hygiene": hygiene, "claims": views.claims(r.map, r.stature, hygiene, r.best, r.incoming), "evidence": views.evidence(r.map, r.final), "papers": views.papers(r.map, r.incoming),
        "subjects": r.subjects, "ideas": r.status, "relations": r.relations, "subject_tensions": subjects.tensions(r.status, r.relations),
        "next_steps": subjects.next_steps(r.status, r.relations), "open_questions": subjects.open_questions(r.subjects), "ungrouped": subjects.ungrouped(r.map, r.subjects),
    }
