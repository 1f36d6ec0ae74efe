"""Residuals of edges under a claim's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.sources.model import ClaimMap


def strength(state_in: Column, state_out: Column) -> Column:
    return F.when(F.col("regime_tag") == "in_regime", state_in).otherwise(state_out)


def wired(m: ClaimMap, edges: DataFrame) -> DataFrame:
    """Edges with the actual value of their observable and both papers. An edge without its claim, evidence or dimension is an error."""
    actual = m.dimensions.groupBy("evidence_id", "name").agg(F.min_by("value", "dim_seq").alias("actual"))
    ev = m.evidence.select(F.col("evidence_id").alias("__ev"), F.col("paper_id").alias("ev_paper"))
    cl = m.claims.select(F.col("claim_id").alias("__cl"), F.col("paper_id").alias("claim_paper"), "init_in", "init_out", "final_in", "final_out")
    named = actual.select(F.col("evidence_id").alias("__at"), F.col("name").alias("__name"), "actual")
    joined = edges.join(ev, F.col("evidence_id") == F.col("__ev"), "left").join(cl, F.col("claim_id") == F.col("__cl"), "left")
    joined = joined.join(named, (F.col("evidence_id") == F.col("__at")) & (F.col("observable") == F.col("__name")), "left")
    whole = F.col("__ev").isNotNull() & F.col("__cl").isNotNull() & F.col("__at").isNotNull()
    checked = F.when(whole, F.col("actual")).otherwise(F.raise_error(F.concat(F.lit("edge without its claim, evidence or dimension: "), "edge_id")).cast("double"))
    return joined.withColumn("actual", checked).drop("__ev", "__cl", "__at", "__name")


def scored(edges: DataFrame, state_in: str = "init_in", state_out: str = "init_out") -> DataFrame:
    """strength, predicted, residual and residual_sq of wired edges under the state in these columns."""
    s = strength(F.col(state_in), F.col(state_out))
    out = edges.withColumn("strength", s).withColumn("predicted", F.col("strength") * F.col("pred_value") + (1.0 - F.col("strength")) * F.col("actual"))
    out = out.withColumn("residual", F.col("predicted") - F.col("actual"))
    return out.withColumn("residual_sq", F.col("residual") * F.col("residual"))


def total(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.sum("residual_sq"), F.lit(0.0)).alias("residual_total"))
