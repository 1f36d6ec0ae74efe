"""A map's derived state kept between runs: only groups and claims whose records changed are worked out again."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import edges, propagation, state, subjects
from claimloom.sources.model import ClaimMap
from claimloom.sources.scratch import settle
from claimloom.sources.snapshots import Snapshots, Update, fingerprints

CLAIM = ["paper_id", "claim_seq", "label", "system", "framework", "keywords"]

#: What is read of base edges: by their sums, and by their fingerprints.
WIRED = [*propagation.USED, "observable"]


def group_records(m: ClaimMap, incoming: list[str]) -> DataFrame:
    """All that a group's ideas are derived from: a row for each explicit stance, with its claim, and each member."""
    new = F.col("paper_id").isin(incoming) if incoming else F.lit(False)
    said = subjects.explicit_stance(m).join(m.claims.select("claim_id", *CLAIM), "claim_id").withColumn("new", new)
    held = m.members.join(m.evidence.select("evidence_id"), "evidence_id", "left_semi")
    return said.unionByName(held.select("group_name", "title", "description", "evidence_id", "member_seq"), allowMissingColumns=True)


def claim_records(m: ClaimMap, base: DataFrame) -> DataFrame:
    """All that a claim's sums are derived from: its base edges, its targets and homes, and what its homes' groups hold."""
    groups = fingerprints(propagation.carried_values(m), "group_name").select(F.col("unit").alias("group_name"), "h_1", "h_2", "n")
    home = edges.home_predictions(m).join(groups, "group_name").join(m.claims.select("claim_id", "init_in", "init_out"), "claim_id")
    aimed = edges.targets(m).select("claim_id", F.col("evidence_id").alias("target"))
    wired = base.select("claim_id", F.concat("claim_id", F.lit("__"), "evidence_id").alias("edge_id"), "observable", "pred_value", "regime_tag", "actual", "ev_paper", "init_in", "init_out")
    return home.drop("paper_id", "claim_seq").unionByName(aimed, allowMissingColumns=True).unionByName(wired, allowMissingColumns=True)


class LivingMap:
    """Ideas with their status and relations by group, and sums and hygiene by claim; either part can be kept without the other."""

    def __init__(self, spark: SparkSession, folder: str):
        self.groups, self.claims = Snapshots(spark, f"{folder}/groups"), Snapshots(spark, f"{folder}/claims")

    def update(self, m: ClaimMap, incoming: list[str]) -> tuple[Update, Update]:
        return self.update_groups(m, incoming), self.update_claims(m)

    def update_groups(self, m: ClaimMap, incoming: list[str]) -> Update:
        def ideas(units: DataFrame) -> dict[str, DataFrame]:
            some = replace(m, members=m.members.join(units, F.col("group_name").eqNullSafe(F.col("unit")), "left_semi"))
            found = settle(subjects.ideas(some), "touched-ideas")
            related = settle(subjects.relations(found), "touched-relations")
            unit = F.col("group_name").alias("unit")
            return {"status": subjects.with_status(found, related, incoming).select("*", unit), "relations": related.select("*", unit)}

        return self.groups.update(fingerprints(group_records(m, incoming), "group_name"), ideas)

    def update_claims(self, m: ClaimMap) -> Update:
        base = settle(edges.wired_predictions(m).select(*WIRED), "base-edges")

        def sums(units: DataFrame) -> dict[str, DataFrame]:
            mine = lambda df: df.join(units.withColumnRenamed("unit", "claim_id"), "claim_id", "left_semi")
            some = replace(m, claims=mine(m.claims), predictions=mine(m.predictions))
            found = settle(propagation.propagated(some, mine(base)), "touched-sums")
            hygiene = state.hygiene_of_sums(some, found)
            return {"sums": found.select("*", F.col("claim_id").alias("unit")), "hygiene": hygiene.select("*", F.col("claim_id").alias("unit"))}

        return self.claims.update(fingerprints(claim_records(m, base), "claim_id"), sums)

    def ideas(self) -> tuple[DataFrame, DataFrame]:
        """Ideas with their status, and their relations."""
        return self.groups.read("status"), self.groups.read("relations")
