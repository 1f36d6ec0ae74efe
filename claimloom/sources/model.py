"""The tables of a claim map."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAIM = "claim_id string, paper_id string, label string, claim_seq long, system string, framework string, keywords array<string>, init_in double, init_out double, final_in double, final_out double, confidence double"
PREDICTION = "claim_id string, pred_seq int, observable string, value double, scale string, evidence_ids array<string>, regime_tag string"
EVIDENCE = "evidence_id string, paper_id string, label string, ev_seq long, system string, framework string, regime string, confidence double"
DIMENSION = "evidence_id string, dim_seq int, name string, value double, scale string"
MEMBER = "group_name string, title string, description string, member_seq int, evidence_id string"


@dataclass(frozen=True)
class ClaimMap:
    """Order that matters is in columns: claim_seq, pred_seq, ev_seq, dim_seq, member_seq. Evidence is never changed."""

    claims: DataFrame
    predictions: DataFrame
    evidence: DataFrame
    dimensions: DataFrame
    members: DataFrame

    def splice(self, other: ClaimMap) -> ClaimMap:
        """This map and a contribution, whose claims and evidence come after; final states start anew."""
        def after(a: DataFrame, b: DataFrame, seq: str) -> DataFrame:
            last = a.agg(F.coalesce(F.max(seq) + 1, F.lit(0)).alias("__last"))
            return a.unionByName(b.crossJoin(F.broadcast(last)).withColumn(seq, F.col(seq) + F.col("__last")).drop("__last"))  # one row

        claims = after(self.claims, other.claims, "claim_seq").withColumn("final_in", F.col("init_in")).withColumn("final_out", F.col("init_out"))
        return ClaimMap(
            claims, self.predictions.unionByName(other.predictions), after(self.evidence, other.evidence, "ev_seq"),
            self.dimensions.unionByName(other.dimensions), self.members)

    def of_papers(self, papers: list[str], keep: bool = True) -> ClaimMap:
        """The part of the map from these papers (or, with keep=False, from all others)."""
        mine = F.col("paper_id").isin(papers)
        mine = mine if keep else ~mine
        claims, evidence = self.claims.where(mine), self.evidence.where(mine)
        return replace(
            self, claims=claims, evidence=evidence,
            predictions=self.predictions.join(claims.select("claim_id"), "claim_id", "left_semi"),
            dimensions=self.dimensions.join(evidence.select("evidence_id"), "evidence_id", "left_semi"))


def first_dimensions(dimensions: DataFrame) -> DataFrame:
    """The first dimension of each evidence: evidence_id, name, value, scale."""
    best = dimensions.groupBy("evidence_id").agg(F.min(F.struct("dim_seq", "name", "value", "scale")).alias("d"))
    return best.select("evidence_id", "d.name", "d.value", "d.scale")
