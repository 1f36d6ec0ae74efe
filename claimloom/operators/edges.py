"""Edges: which claim predicts what at which evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.model import ClaimMap, first_dimensions

IN, OUT = "in_regime", "out_of_regime"
#: Evidence is dealt to so many shares, so that an open prediction meets the evidence of its observable in as many tasks.
SHARES = 64


def observable_groups(dimensions: DataFrame) -> DataFrame:
    """Evidence by observable name; an evidence with the name twice is listed twice."""
    return dimensions.groupBy("name").agg(F.sort_array(F.collect_list("evidence_id")).alias("evidence_ids")).withColumnRenamed("name", "observable")


def regime(explicit: Column, same_paper: Column, keywords: Column, haystack: Column) -> Column:
    """An explicit tag, else in regime for the claim's own paper or where a keyword occurs, else out of regime."""
    named = F.exists(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.contains(haystack, F.lower(k)))
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(same_paper | named, F.lit(IN)).otherwise(F.lit(OUT)))


BASE = ["edge_id", "claim_id", "evidence_id", "observable", "pred_value", "scale", "regime_tag", "confidence", "group_name", "home_evidence", "is_semantic", "claim_seq", "pred_seq", "ev_seq"]


def wired_predictions(m: ClaimMap) -> DataFrame:
    """prediction_edges() with the actual value, both papers and the claim's states, as residuals.wired() adds them.

    Claims join their predictions before targets are exploded, and evidence its dimensions before these meet: edges
    move twice, to their evidence and to the choice of the first.
    """
    open_ = F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0
    claim = m.claims.select("claim_id", F.col("paper_id").alias("claim_paper"), "keywords", F.col("confidence").alias("c_confidence"), "claim_seq", "init_in", "init_out", "final_in", "final_out")
    said = m.predictions.select("claim_id", "pred_seq", "observable", F.col("value").alias("pred_value"), "scale", F.col("regime_tag").alias("explicit"), "evidence_ids").join(claim, "claim_id")
    haystack = F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in ("paper_id", "label", "system", "framework", "regime")]))
    evidence = m.evidence.select("evidence_id", F.col("paper_id").alias("ev_paper"), haystack.alias("haystack"), F.col("confidence").alias("e_confidence"), "ev_seq")
    actual = m.dimensions.groupBy("evidence_id", "name").agg(F.min_by("value", "dim_seq").alias("actual"), F.min("dim_seq").alias("dim_seq"))
    seen = actual.join(evidence, "evidence_id")
    # targets are rows: they meet their own evidence only, not all of their observable
    aimed = said.where(~open_).withColumn("target", F.explode(F.array_distinct("evidence_ids"))).drop("evidence_ids")
    same = F.col("observable") == F.col("name")
    met = aimed.join(seen, same & (F.col("target") == F.col("evidence_id"))).drop("target").unionByName(
        said.where(open_).drop("evidence_ids").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).join(seen.withColumn("of", F.pmod(F.xxhash64("evidence_id"), F.lit(SHARES)).cast("int")), same & (F.col("share") == F.col("of"))).drop("share", "of"))
    rows = met.select(
        "claim_id", "evidence_id", "observable", "pred_value", F.coalesce("scale", F.lit("normalized_binary")).alias("scale"),
        regime(F.col("explicit"), F.col("claim_paper") == F.col("ev_paper"), F.col("keywords"), F.col("haystack")).alias("regime_tag"),
        F.least(F.coalesce("c_confidence", F.lit(0.5)), F.coalesce("e_confidence", F.lit(0.5))).alias("confidence"),
        "claim_seq", "pred_seq", "ev_seq", "dim_seq", "actual", "ev_paper", "claim_paper", "init_in", "init_out", "final_in", "final_out")
    first = Window.partitionBy("claim_id", "evidence_id").orderBy("pred_seq", "ev_seq", "dim_seq")
    kept = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "dim_seq")
    none = F.lit(None).cast("string")
    named = kept.withColumns({"edge_id": F.concat("claim_id", F.lit("__"), "evidence_id"), "group_name": none, "home_evidence": none, "is_semantic": F.lit(False)})
    return named.select(*BASE, "ev_paper", "claim_paper", "init_in", "init_out", "final_in", "final_out", "actual")


def prediction_edges(m: ClaimMap) -> DataFrame:
    """Predictions joined to evidence by observable, restricted to explicit targets where there are any.

    Of several for one claim and evidence the first wins, by prediction, then evidence order.
    """
    return wired_predictions(m).select(*BASE)


def targets(m: ClaimMap) -> DataFrame:
    """Explicit targets: claim_id, pred_seq, place, evidence_id, value."""
    return m.predictions.select("claim_id", "pred_seq", "value", F.posexplode("evidence_ids").alias("place", "evidence_id"))


def home_predictions(m: ClaimMap) -> DataFrame:
    """For each claim and group the first target, by prediction then place, that is a member and of the claim's own paper."""
    own = targets(m).join(m.claims.select("claim_id", "paper_id", "claim_seq"), "claim_id").join(m.evidence.select("evidence_id", F.col("paper_id").alias("ev_paper")), "evidence_id").where("paper_id = ev_paper")
    placed = own.join(m.members.select("group_name", "evidence_id").distinct(), "evidence_id")
    least = placed.groupBy("claim_id", "group_name").agg(F.min(F.struct("pred_seq", "place", "evidence_id", "value")).alias("h"), F.first("paper_id").alias("paper_id"), F.first("claim_seq").alias("claim_seq"))
    return least.select("claim_id", "group_name", F.col("h.evidence_id").alias("home_evidence"), F.col("h.value").alias("home_value"), "paper_id", "claim_seq")


def semantic_edges(m: ClaimMap, base: DataFrame, only_papers: list[str] | None = None) -> DataFrame:
    """A claim's home value carried to the other members of the group that it neither targets nor is wired to already.

    An evidence in two groups gets an edge from each.
    """
    homes = home_predictions(m)
    if only_papers is not None:
        homes = homes.where(F.col("paper_id").isin(only_papers))
    carried = homes.join(m.members.select("group_name", "member_seq", "evidence_id"), "group_name").where("evidence_id <> home_evidence")
    carried = carried.join(targets(m).select("claim_id", "evidence_id").distinct(), ["claim_id", "evidence_id"], "left_anti")
    carried = carried.join(base.select("claim_id", "evidence_id"), ["claim_id", "evidence_id"], "left_anti")
    at = carried.join(m.evidence.select("evidence_id", "ev_seq"), "evidence_id").join(first_dimensions(m.dimensions), "evidence_id")
    return at.select(
        F.concat("claim_id", F.lit("__"), "evidence_id", F.lit("__semantic")).alias("edge_id"), "claim_id", "evidence_id", F.col("name").alias("observable"),
        F.col("home_value").alias("pred_value"), F.coalesce("scale", F.lit("normalized_binary")).alias("scale"), F.lit(OUT).alias("regime_tag"), F.lit(0.5).alias("confidence"),
        "group_name", "home_evidence", F.lit(True).alias("is_semantic"), "claim_seq", F.lit(0).alias("pred_seq"), "ev_seq")


def all_edges(m: ClaimMap, only_papers: list[str] | None = None) -> DataFrame:
    base = prediction_edges(m)
    return base.unionByName(semantic_edges(m, base, only_papers))
