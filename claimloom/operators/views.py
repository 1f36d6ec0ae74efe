"""What a viewer needs of claims, evidence and papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import constants as K
from claimloom.sources.model import ClaimMap, first_dimensions


def is_incoming(incoming: list[str]) -> Column:
    return F.col("paper_id").isin(incoming) if incoming else F.lit(False)


def claims(m: ClaimMap, standing: DataFrame, hygiene: DataFrame, best: DataFrame, incoming: list[str]) -> DataFrame:
    """Each claim with its paper, standing, hygiene and a label that says how far its scope was narrowed."""
    after = best.where("changed").select("claim_id", "to_in", "to_out")
    rows = m.claims.join(standing, "claim_id", "left").join(hygiene.select("claim_id", F.col("status").alias("hygiene")), "claim_id", "left").join(after, "claim_id", "left")
    narrowed = F.when(F.col("to_out").isNotNull(), F.format_string(" (outside its regime at %.1f)", "to_out")).otherwise(F.lit(""))
    return rows.select(
        "claim_id", "paper_id", "claim_seq", "system", "framework", F.coalesce("stature", F.lit(0)).cast("long").alias("stature"), "hygiene", is_incoming(incoming).alias("incoming"),
        F.coalesce("to_in", "init_in").alias("state_in"), F.coalesce("to_out", "init_out").alias("state_out"), F.concat("label", narrowed).alias("scoped_label"))


def evidence(m: ClaimMap, final: DataFrame) -> DataFrame:
    """Each evidence with the value of its first dimension, its edges and those still in tension. final: edges scored at the final state."""
    by = final.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("edges"), F.sum((F.col("residual_sq") > K.TENSION_ABOVE).cast("long")).alias("tensions"))
    rows = m.evidence.select("evidence_id", "paper_id").join(first_dimensions(m.dimensions).select("evidence_id", "value"), "evidence_id").join(by, "evidence_id", "left")
    return rows.select("evidence_id", "paper_id", "value", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("edges", "tensions")])


def papers(m: ClaimMap, incoming: list[str]) -> DataFrame:
    """Each paper with a readable label and whether it is incoming."""
    every = m.claims.select("paper_id").unionByName(m.evidence.select("paper_id")).distinct()
    return every.select("paper_id", F.initcap(F.replace("paper_id", F.lit("_"), F.lit(" "))).alias("label"), is_incoming(incoming).alias("incoming"))
