"""A contribution set into a map: what contradicts it, and what the map would do about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import constants as K
from claimloom.operators.edges import prediction_edges
from claimloom.operators.optimize import apply, rewrites
from claimloom.operators.residuals import scored, wired
from claimloom.operators.state import remaining_tensions
from claimloom.sources.model import ClaimMap


def situated(prior: ClaimMap, new: ClaimMap) -> DataFrame:
    """Base edges of the spliced map, wired and scored at full strength."""
    m = prior.splice(new)
    return scored(wired(m, prediction_edges(m)))


def contradictors(edges: DataFrame, prior: ClaimMap, new: ClaimMap) -> DataFrame:
    """evidence_id, claim_id, claim_paper, residual: prior claims that clearly miss a new finding."""
    at = edges.join(new.evidence.select("evidence_id"), "evidence_id", "left_semi").join(prior.claims.select("claim_id"), "claim_id", "left_semi")
    return at.where(F.abs("residual") > K.DISAGREES_ABOVE).select("evidence_id", "claim_id", "claim_paper", F.bround("residual", 3).alias("residual"))


def verdicts(edges: DataFrame, prior: ClaimMap, new: ClaimMap) -> DataFrame:
    """A row for each new finding: independent contradicting papers, verdict, and the new claims that lean on it."""
    against = contradictors(edges, prior, new).groupBy("evidence_id").agg(F.countDistinct("claim_paper").alias("papers"), F.count(F.lit(1)).alias("claims"))
    leaning = edges.join(new.claims.select("claim_id"), "claim_id", "left_semi").groupBy("evidence_id").agg(F.array_sort(F.collect_set("claim_id")).alias("leans_on"))
    rows = new.evidence.select("evidence_id", "ev_seq").join(against, "evidence_id", "left").join(leaning, "evidence_id", "left")
    n = F.coalesce("papers", F.lit(0))
    verdict = F.when(n >= K.SUSPECT_FROM_PAPERS, "suspect").when(F.coalesce("claims", F.lit(0)) > 0, "contested").otherwise("credible")
    return rows.select("evidence_id", "ev_seq", n.alias("independent_papers"), verdict.alias("verdict"), F.coalesce("leans_on", F.array().cast("array<string>")).alias("leans_on"))


def accommodation(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rewrites at flat cost, and the tensions that survive them."""
    cost = edges.select("claim_id").distinct().withColumn("lambda", F.lit(K.LAMBDA_FLAT))
    best = rewrites(edges, cost)
    return best, remaining_tensions(scored(apply(edges, best), "final_in", "final_out"))
