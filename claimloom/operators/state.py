"""What the map says after rewriting: tensions, claim hygiene, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import constants as K
from claimloom.operators.edges import targets
from claimloom.sources.model import ClaimMap


def remaining_tensions(final: DataFrame) -> DataFrame:
    """final: edges scored at the final state."""
    return final.where(F.col("residual_sq") > K.TENSION_ABOVE).select("edge_id", "claim_id", "evidence_id", "group_name", "residual_sq")


def resolved_tensions(initial: DataFrame, final: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges of rewritten claims that missed before and (nearly) fit now."""
    after = final.select("edge_id", F.col("group_name").alias("__g"), F.col("residual_sq").alias("final_sq"))
    both = initial.join(after, (initial["edge_id"] == after["edge_id"]) & initial["group_name"].eqNullSafe(after["__g"])).select(initial["edge_id"], "claim_id", "evidence_id", F.col("residual_sq").alias("initial_sq"), "final_sq")
    return both.where((F.col("initial_sq") > K.TENSION_ABOVE) & (F.col("final_sq") < K.RESOLVED_BELOW)).join(changed.select("claim_id"), "claim_id", "left_semi")


def hygiene(m: ClaimMap, full: DataFrame, compat: bool = False) -> DataFrame:
    """Status of every claim from its propagated edges at full strength and the groups that it addresses.

    compat=True leaves the two lists of groups empty.
    """
    carried = full.where("is_semantic")
    wrong = F.col("residual_sq") > K.CONTRADICTION_ABOVE
    by = carried.groupBy("claim_id").agg(
        F.sort_array(F.collect_list("evidence_id")).alias("propagated"), F.sort_array(F.collect_list(F.when(wrong, F.col("evidence_id")))).alias("contradicting"))
    # an evidence that contradicts in one group is not consistent in another
    by = by.withColumn("consistent", F.array_except("propagated", "contradicting"))
    aimed = targets(m).select("claim_id", "evidence_id").distinct()
    sizes = m.members.groupBy("group_name").agg(F.countDistinct("evidence_id").alias("size"))
    hit = aimed.join(m.members.select("group_name", "evidence_id").distinct(), "evidence_id").groupBy("claim_id", "group_name").agg(F.count(F.lit(1)).alias("hit")).join(sizes, "group_name")
    groups = hit.groupBy("claim_id").agg(
        F.sort_array(F.collect_list("group_name")).alias("groups_touched"), F.sort_array(F.collect_list(F.when(F.col("hit") == F.col("size"), F.col("group_name")))).alias("groups_addressed"))
    if compat:
        groups = groups.where(F.lit(False))
    none = F.array().cast("array<string>")
    rows = m.claims.select("claim_id").join(by, "claim_id", "left").join(groups, "claim_id", "left")
    lists = {c: F.coalesce(c, none) for c in ("propagated", "contradicting", "consistent", "groups_touched", "groups_addressed")}
    rows = rows.select("claim_id", *[e.alias(c) for c, e in lists.items()])
    kept = F.size(F.filter("propagated", lambda x: ~F.array_contains("contradicting", x)))
    status = (F.when((F.size("contradicting") > 0) & (F.size("contradicting") > kept), "implicit_headline").when(F.size("propagated") > 0, "consensus_aligned")
              .when(F.size("groups_touched") > 0, "scoped_explicit").otherwise("not_applicable"))
    return rows.withColumn("status", status)


def hygiene_of_sums(m: ClaimMap, sums: DataFrame) -> DataFrame:
    """claim_id, status of every claim as hygiene() has it, from propagation.propagated(): counts, no lists."""
    touched = targets(m).select("claim_id", "evidence_id").distinct().join(m.members.select("evidence_id").distinct(), "evidence_id", "left_semi").select("claim_id").distinct().withColumn("touches", F.lit(True))
    rows = m.claims.select("claim_id").join(sums.select("claim_id", "carried", "contradicting", "kept"), "claim_id", "left").join(touched, "claim_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("carried", "contradicting", "kept")}
    status = (F.when((n["contradicting"] > 0) & (n["contradicting"] > n["kept"]), "implicit_headline").when(n["carried"] > 0, "consensus_aligned")
              .when(F.col("touches"), "scoped_explicit").otherwise("not_applicable"))
    return rows.select("claim_id", status.alias("status"))


def summary(m: ClaimMap, initial: DataFrame, final: DataFrame, changed: DataFrame) -> DataFrame:
    """One row: counts, residuals, rewriting. Each part is an aggregate of its own."""
    parts = [
        m.claims.agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("paper_id").alias("claim_papers")),
        m.evidence.agg(F.count(F.lit(1)).alias("evidence")),
        initial.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum(F.col("is_semantic").cast("long")), F.lit(0)).alias("semantic_edges"), F.coalesce(F.sum("residual_sq"), F.lit(0.0)).alias("initial_residual")),
        final.agg(F.coalesce(F.sum("residual_sq"), F.lit(0.0)).alias("final_residual"), F.coalesce(F.sum((F.col("residual_sq") > K.TENSION_ABOVE).cast("long")), F.lit(0)).alias("tensions")),
        changed.agg(F.count(F.lit(1)).alias("rewrites"), F.coalesce(F.sum("distance"), F.lit(0.0)).alias("rewrite_distance")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # rows of one
    return out.withColumn("context_fill_distance", F.lit(0.0))
