"""Stature, costs of rewriting and the cheapest narrowing of each claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import constants as K


def stature(full: DataFrame, agreeing: bool = True) -> DataFrame:
    """Distinct papers that back each claim at full strength. full: edges scored at the initial state.

    agreeing=False counts the papers of any wired evidence. Claims without backing have no row.
    """
    backed = full.where(F.col("residual_sq") <= K.BACKING_AT_MOST) if agreeing else full
    return backed.groupBy("claim_id").agg(F.countDistinct("ev_paper").alias("stature"))


def costs(claims: DataFrame, standing: DataFrame, incoming: list[str], base: float = K.LAMBDA_BASE, alpha: float = K.ALPHA, discount: float = K.INCOMING_DISCOUNT) -> DataFrame:
    """claim_id, stature and lambda: a discount for incoming papers, else more for each backing paper."""
    n = F.coalesce("stature", F.lit(0))
    new = F.col("paper_id").isin(incoming) if incoming else F.lit(False)
    return claims.join(standing, "claim_id", "left").select("claim_id", "paper_id", n.alias("stature"), F.when(new, F.lit(discount)).otherwise(base * (1.0 + alpha * n)).alias("lambda"))


def rewrites(edges: DataFrame, cost: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The best state of every claim that has an edge, and what it costs. edges: wired; cost: claim_id, lambda and keys.

    The residual at strengths (i, o) is i^2 R_in + o^2 R_out, so two sums for each claim settle all candidates; they are
    folded in order, and a later one wins only if better by more than the tolerance.
    """
    miss = F.pow(F.col("pred_value") - F.col("actual"), 2)
    inside = F.col("regime_tag") == "in_regime"
    sums = edges.groupBy("claim_id", "init_in", "init_out", "final_in", "final_out").agg(
        F.sum(F.when(inside, miss).otherwise(0.0)).alias("r_in"), F.sum(F.when(inside, 0.0).otherwise(miss)).alias("r_out"))
    return cheapest(sums, cost, keys)


def cheapest(sums: DataFrame, cost: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """As rewrites(), from the sums of each claim's edges: claim_id, its states, r_in, r_out."""
    rows = sums.join(cost.select("claim_id", "lambda", *keys), "claim_id")

    def residual(i: Column, o: Column) -> Column:
        return i * i * F.col("r_in") + o * o * F.col("r_out")

    def score(i: Column, o: Column) -> Column:
        away = (i - F.col("init_in")) * (i - F.col("init_in")) + (o - F.col("init_out")) * (o - F.col("init_out"))
        return residual(i, o) + F.col("lambda") * away

    start = F.struct(score(F.col("final_in"), F.col("final_out")).alias("objective"), F.col("final_in").alias("i"), F.col("final_out").alias("o"))
    one = F.lit(1.0)
    best = F.aggregate(
        F.array(*[F.lit(s) for s in K.OUT_STRENGTHS]), start,
        lambda acc, o: F.when(score(one, o) < acc["objective"] - K.IMPROVES_BY, F.struct(score(one, o).alias("objective"), one.alias("i"), o.alias("o"))).otherwise(acc))
    done = rows.withColumn("best", best)
    i, o = F.col("best.i"), F.col("best.o")
    return done.select(
        *keys, "claim_id", F.col("final_in").alias("from_in"), F.col("final_out").alias("from_out"), i.alias("to_in"), o.alias("to_out"),
        F.sqrt(F.pow(i - F.col("init_in"), 2) + F.pow(o - F.col("init_out"), 2)).alias("distance"),
        residual(F.col("final_in"), F.col("final_out")).alias("initial_residual"), residual(i, o).alias("final_residual"),
        F.col("best.objective").alias("objective"), "lambda", ((i != F.col("final_in")) | (o != F.col("final_out"))).alias("changed"))


def operations(best: DataFrame) -> DataFrame:
    """The log of claims whose state changed."""
    return best.where("changed").drop("changed")


def apply(edges: DataFrame, best: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Wired edges with the claims' states after rewriting."""
    after = best.select("claim_id", *keys, F.col("to_in").alias("after_in"), F.col("to_out").alias("after_out"))
    return edges.drop("final_in", "final_out").join(after.withColumnRenamed("after_in", "final_in").withColumnRenamed("after_out", "final_out"), "claim_id")


def sweep(edges: DataFrame, claims: DataFrame, standing: DataFrame, incoming: list[str]) -> DataFrame:
    """For each alpha: narrowing of prior and of incoming claims, and the residual left. All values in one job."""
    alphas = F.explode(F.array(*[F.lit(a) for a in K.SWEEP])).alias("alpha")
    priced = claims.select("claim_id", "paper_id", alphas).join(standing, "claim_id", "left")
    n = F.coalesce("stature", F.lit(0))
    new = F.col("paper_id").isin(incoming)
    cost = priced.select("claim_id", "alpha", new.alias("new"), F.when(new, F.lit(K.INCOMING_DISCOUNT)).otherwise(K.LAMBDA_BASE * (1.0 + F.col("alpha") * n)).alias("lambda"))
    narrowed = F.col("from_out") - F.col("to_out")
    best = rewrites(edges, cost, ("alpha", "new"))
    return best.groupBy("alpha").agg(
        F.sum(F.when(F.col("new"), 0.0).otherwise(narrowed)).alias("prior_narrowing"), F.sum(F.when(F.col("new"), narrowed).otherwise(0.0)).alias("incoming_narrowing"),
        F.sum("final_residual").alias("residual"))


def compare(edges: DataFrame, claims: DataFrame, standing: DataFrame, incoming: list[str]) -> DataFrame:
    """Flat against stature-weighted costs on the same map: a row for each model, and the verdict on the flat one."""
    weighted = costs(claims, standing, incoming).select("claim_id", "paper_id", "lambda", F.lit("stature").alias("model"))
    flat = claims.select("claim_id", "paper_id", F.lit(K.LAMBDA_FLAT).alias("lambda"), F.lit("flat").alias("model"))
    cost = weighted.unionByName(flat).withColumn("new", F.col("paper_id").isin(incoming))
    best = rewrites(edges, cost, ("model", "new"))
    narrowed = F.col("from_out") - F.col("to_out")
    by = best.groupBy("model").agg(
        F.sum(F.when(F.col("new"), 0.0).otherwise(narrowed)).alias("prior_narrowing"), F.sum(F.when(F.col("new"), narrowed).otherwise(0.0)).alias("incoming_narrowing"),
        F.sum("final_residual").alias("residual"))
    flat_row = by.where("model = 'flat'").select(F.col("prior_narrowing").alias("flat_prior"), F.col("residual").alias("flat_residual"))
    both = by.crossJoin(F.broadcast(flat_row))  # one row
    more = F.col("residual") - F.col("flat_residual")
    verdict = F.when((F.col("prior_narrowing") == 0) & (more > 0.5), "refused").when((F.col("flat_prior") - F.col("prior_narrowing") > 0.01) & (more > 0.1), "softened").otherwise("unchanged")
    return both.select("model", "prior_narrowing", "incoming_narrowing", "residual", verdict.alias("verdict"))


def surviving_at(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims whose base edge (not a propagated one) still misses at this evidence. edges: scored at the final state."""
    missed = edges.where(~F.col("is_semantic") & (F.col("residual_sq") > K.SURVIVES_ABOVE))
    return missed.join(evidence.select("evidence_id"), "evidence_id", "left_semi").select("evidence_id", "claim_id", "residual_sq")
