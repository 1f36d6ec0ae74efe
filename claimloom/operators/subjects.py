"""Subjects, one for each group of comparable evidence, and the ideas that papers hold within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom import constants as K
from claimloom.operators.edges import targets
from claimloom.sources.model import ClaimMap, first_dimensions


def explicit_stance(m: ClaimMap) -> DataFrame:
    """claim_id, group_name, evidence_id, value: a claim's explicit value at each present member; the last prediction wins."""
    present = m.members.select("group_name", "evidence_id").distinct().join(m.evidence.select("evidence_id"), "evidence_id", "left_semi")
    at = targets(m).join(present, "evidence_id")
    last = at.groupBy("claim_id", "group_name", "evidence_id").agg(F.max(F.struct("pred_seq", "place", "value")).alias("last"))
    return last.select("claim_id", "group_name", "evidence_id", F.col("last.value").alias("value"))


def signature(values: DataFrame, *keys: str) -> DataFrame:
    """The sorted (evidence, value to two digits) vector of each key."""
    return values.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("evidence_id", F.bround("value", 2).alias("value")))).alias("signature"))


def ideas(m: ClaimMap) -> DataFrame:
    """Claims of one paper with the same stance in a group are one idea.

    Numbered within the group by the first claim of the paper, then of the stance.
    """
    held = signature(explicit_stance(m), "claim_id", "group_name").join(m.claims.select("claim_id", "paper_id", "claim_seq", "label", "system", "framework", "keywords"), "claim_id")
    one = held.groupBy("group_name", "paper_id", "signature").agg(
        F.sort_array(F.collect_list("claim_id")).alias("claim_ids"), F.min("claim_seq").alias("first_seq"), F.min_by("label", "claim_seq").alias("label"),
        F.array_sort(F.collect_set(F.nullif("system", F.lit("")))).alias("systems"), F.array_sort(F.collect_set(F.nullif("framework", F.lit("")))).alias("frameworks"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("keywords", F.array().cast("array<string>")))))).alias("keywords"))
    papers = one.groupBy("group_name", "paper_id").agg(F.min("first_seq").alias("paper_seq"))
    order = Window.partitionBy("group_name").orderBy("paper_seq", "first_seq")  # the ideas of one group, which are merged claims
    numbered = one.join(papers, ["group_name", "paper_id"]).withColumn("idea_no", F.row_number().over(order))
    numbered = numbered.withColumn("idea_id", F.format_string("idea_%s_%03d", "group_name", "idea_no"))
    title = F.concat("paper_id", F.lit(" ("), F.array_join("claim_ids", ", "), F.lit(")"))
    return numbered.withColumn("title", F.when(F.coalesce("label", F.lit("")) != "", F.concat(title, F.lit(": "), "label")).otherwise(title)).drop("paper_seq", "first_seq", "label")


def stance_of(found: DataFrame) -> DataFrame:
    return found.select("group_name", "idea_id", "idea_no", F.explode("signature").alias("s")).select("group_name", "idea_id", "idea_no", "s.evidence_id", "s.value")


def against_evidence(found: DataFrame, m: ClaimMap) -> DataFrame:
    """supporting and contesting evidence of each idea, by the evidence's first dimension."""
    at = stance_of(found).join(first_dimensions(m.dimensions).select("evidence_id", F.col("value").alias("actual")), "evidence_id")
    fits = F.abs(F.col("value") - F.col("actual")) < K.AGREE_BELOW
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("evidence_id"))))
    return at.groupBy("idea_id").agg(pick(fits).alias("supporting"), pick(~fits).alias("contesting"))


def relations(found: DataFrame) -> DataFrame:
    """group_name, idea_a, idea_b, kind, at: both ways for each two ideas of a group with evidence in common.

    They contest each other where any shared value differs, else they support each other. Joined on the evidence, so
    ideas without common evidence never meet.
    """
    a, b = stance_of(found).alias("a"), stance_of(found).alias("b")
    met = a.join(b, (F.col("a.group_name") == F.col("b.group_name")) & (F.col("a.evidence_id") == F.col("b.evidence_id")) & (F.col("a.idea_no") < F.col("b.idea_no")))
    agree = F.abs(F.col("a.value") - F.col("b.value")) < K.AGREE_BELOW
    pairs = met.groupBy(F.col("a.group_name").alias("group_name"), F.col("a.idea_id").alias("idea_a"), F.col("b.idea_id").alias("idea_b")).agg(
        F.array_sort(F.collect_set(F.when(agree, F.col("a.evidence_id")))).alias("agree_at"), F.array_sort(F.collect_set(F.when(~agree, F.col("a.evidence_id")))).alias("contest_at"))
    contest = F.size("contest_at") > 0
    one = pairs.select("group_name", "idea_a", "idea_b", F.when(contest, "contests").otherwise("supports").alias("kind"), F.when(contest, F.col("contest_at")).otherwise(F.col("agree_at")).alias("at"))
    return one.unionByName(one.select("group_name", F.col("idea_b").alias("idea_a"), F.col("idea_a").alias("idea_b"), "kind", "at"))


def with_status(found: DataFrame, related: DataFrame, incoming: list[str]) -> DataFrame:
    """novel: of an incoming paper and alone in its group with its stance; else contested if contested; else established."""
    contested = related.where("kind = 'contests'").select(F.col("idea_a").alias("idea_id")).distinct().withColumn("contested", F.lit(True))
    alike = found.groupBy("group_name", "signature").agg(F.count(F.lit(1)).alias("alike"))
    rows = found.join(contested, "idea_id", "left").join(alike, ["group_name", "signature"])
    new = F.col("paper_id").isin(incoming) if incoming else F.lit(False)
    status = F.when(new & (F.col("alike") == 1), "novel").when(F.coalesce("contested", F.lit(False)), "contested").otherwise("established")
    return rows.withColumn("status", status).withColumn("status_rank", F.when(status == "novel", 0).when(status == "contested", 1).otherwise(2)).drop("alike", "contested")


def in_order(status: DataFrame) -> DataFrame:
    """group_name, place (from 1), idea_id, status: the ideas of each group as they are told, by status, then id.

    Ranked inside each status, after those of the statuses before it (three rows at most for each group).
    """
    ahead = Window.partitionBy("group_name").orderBy("status_rank").rowsBetween(Window.unboundedPreceding, -1)
    before = status.groupBy("group_name", "status_rank").agg(F.count(F.lit(1)).alias("n")).select("group_name", "status_rank", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("group_name", "status_rank").orderBy("idea_id"))
    placed = status.withColumn("inside", inside).join(before, ["group_name", "status_rank"])
    return placed.select("group_name", (F.col("inside") + F.col("before")).alias("place"), "idea_id", "status")


def scope(found: DataFrame) -> DataFrame:
    """Where each subject holds: its systems, frameworks and regimes, sorted and joined; empty if no idea of it names any."""
    return found.select("subject_id", "system", "framework", "regime")


def tensions(status: DataFrame, related: DataFrame) -> DataFrame:
    """Contesting pairs once, named from the one that comes first by status, then id."""
    rank = status.select("idea_id", "status_rank", "paper_id")
    a, b = rank.alias("a"), rank.alias("b")
    pairs = related.where("kind = 'contests'").join(a, F.col("idea_a") == F.col("a.idea_id")).join(b, F.col("idea_b") == F.col("b.idea_id"))
    first = F.struct("a.status_rank", "a.idea_id") < F.struct("b.status_rank", "b.idea_id")
    return pairs.where(first).select("group_name", F.least("idea_a", "idea_b").alias("idea_one"), F.greatest("idea_a", "idea_b").alias("idea_two"), F.col("a.paper_id").alias("papers_yes"), F.col("b.paper_id").alias("papers_no"), "at")


def subjects(m: ClaimMap, status: DataFrame) -> DataFrame:
    """A row for each group with a present member, numbered over all groups by name, and what its ideas add up to."""
    names = m.members.select("group_name", "title", "description").groupBy("group_name").agg(F.min("title").alias("title"), F.min("description").alias("description"))
    numbered = names.withColumn("number", F.row_number().over(Window.orderBy("group_name")))  # a row for each group
    present = m.members.join(m.evidence.select("evidence_id"), "evidence_id", "left_semi").select("group_name").distinct()
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    rolled = status.groupBy("group_name").agg(
        flat("claim_ids").alias("claims"), flat(F.transform("signature", lambda s: s["evidence_id"])).alias("evidence"), F.array_sort(F.collect_set("paper_id")).alias("papers"),
        flat("systems").alias("systems"), flat("frameworks").alias("frameworks"), flat("keywords").alias("keywords"),
        *[F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("novel", "contested", "established")])
    none = F.array().cast("array<string>")
    rows = numbered.join(present, "group_name", "left_semi").join(rolled, "group_name", "left")
    lists = [F.coalesce(c, none).alias(c) for c in ("claims", "evidence", "papers")]
    scope = [F.array_join(F.coalesce(c, none), sep).alias(name) for c, sep, name in (("systems", "; ", "system"), ("frameworks", "; ", "framework"), ("keywords", ", ", "regime"))]
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("novel", "contested", "established")]
    return rows.select(F.format_string("subject_%02d_%s", "number", "group_name").alias("subject_id"), "group_name", "title", "description", *lists, *scope, *counts)


def ungrouped(m: ClaimMap, found: DataFrame) -> DataFrame:
    """Evidence in no stance and claims in no subject: subject_id (numbered after the subjects found), kind, id."""
    evidence = m.evidence.select("evidence_id").join(found.select(F.explode("evidence").alias("evidence_id")), "evidence_id", "left_anti").select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id"))
    claims = m.claims.select("claim_id").join(found.select(F.explode("claims").alias("claim_id")), "claim_id", "left_anti").select(F.lit("claim").alias("kind"), F.col("claim_id").alias("id"))
    count = found.agg((F.count(F.lit(1)) + 1).alias("number"))  # one row
    return evidence.unionByName(claims).crossJoin(F.broadcast(count)).select(F.format_string("subject_%02d_ungrouped", "number").alias("subject_id"), "kind", "id")


#: The kinds of step that each status asks for, in order. The first of a novel idea only if it is contested.
STEPS = [("novel", 0, "literature", True), ("novel", 1, "experiment", False), ("novel", 2, "simulation", False), ("contested", 0, "theory", False), ("contested", 1, "simulation", False),
         ("contested", 2, "literature", False), ("established", 0, "experiment", False), ("established", 1, "theory", False), ("established", 2, "simulation", False)]


def next_steps(status: DataFrame, related: DataFrame) -> DataFrame:
    """idea_id, step_seq, kind: a row for each step that an idea's status asks for."""
    rules = status.sparkSession.createDataFrame(STEPS, "status string, step_seq int, kind string, needs_contest boolean")
    disputed = related.where("kind = 'contests'").select(F.col("idea_a").alias("idea_id")).distinct().withColumn("disputed", F.lit(True))
    rows = status.select("idea_id", "status").join(disputed, "idea_id", "left").join(F.broadcast(rules), "status")
    return rows.where(~F.col("needs_contest") | F.coalesce("disputed", F.lit(False))).select("idea_id", "status", "step_seq", "kind")


def open_questions(found: DataFrame) -> DataFrame:
    """subject_id, priority, ideas: blocking if any idea is novel, high if any is contested, exploratory if there is any."""
    total = F.col("novel") + F.col("contested") + F.col("established")
    asked = F.array(*[F.struct(F.lit(p).alias("priority"), n.alias("ideas")) for p, n in (("blocking", F.col("novel")), ("high", F.col("contested")), ("exploratory", total))])
    return found.select("subject_id", F.explode(F.filter(asked, lambda x: x["ideas"] > 0)).alias("q")).select("subject_id", "q.priority", "q.ideas")
