"""Stances of claims and papers, their coherence, and what can be discovered from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom import constants as K
from claimloom.operators.edges import home_predictions, targets
from claimloom.sources.model import ClaimMap, first_dimensions
from claimloom.sources.scratch import settle


def present_members(m: ClaimMap) -> DataFrame:
    return m.members.select("group_name", "member_seq", "evidence_id").join(m.evidence.select("evidence_id"), "evidence_id", "left_semi")


def last_targets(m: ClaimMap) -> DataFrame:
    """A claim's value at each explicit target; the last prediction wins."""
    return targets(m).groupBy("claim_id", "evidence_id").agg(F.max_by("value", F.struct("pred_seq", "place")).alias("value"))


def stances(m: ClaimMap) -> DataFrame:
    """claim_id, group_name, evidence_id, value, explicit: the explicit value, else the home value carried to the member."""
    members = present_members(m).select("group_name", "evidence_id").distinct()
    said = last_targets(m).join(members, "evidence_id").select("claim_id", "group_name", "evidence_id", "value", F.lit(True).alias("explicit"))
    homes = home_predictions(m).select("claim_id", "group_name", F.col("home_value").alias("value"))
    carried = homes.join(members, "group_name").join(said.select("claim_id", "group_name", "evidence_id"), ["claim_id", "group_name", "evidence_id"], "left_anti")
    return said.unionByName(carried.select("claim_id", "group_name", "evidence_id", "value", F.lit(False).alias("explicit")))


def coherent_classes(stance: DataFrame, key: str, least_shared: int = K.COHERENT_FROM_SHARED) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (class_a, class_b, shared) that share enough positions and agree at all of them, and members (member, class, n).

    Holders of equal stances are one class, known by a hash of 128 bits. Positions stand in one order, rare ones first; two
    classes that share k positions share one even if each leaves out its k - 1 commonest. So classes meet on the others
    only, where they must agree, and what all hold is not joined on; the pairs found are then checked at all positions.
    """
    at = ["group_name", "evidence_id", "value"]
    stance = settle(stance.select(key, *at), "stances")
    of = stance.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*at)).alias("h_1"), F.bit_xor(F.xxhash64(*reversed(at), F.lit("second"))).alias("h_2"))
    same = Window.partitionBy("n", "h_1", "h_2")
    members = settle(of.select(F.col(key).alias("member"), F.min(key).over(same).alias("class"), "n"), "stance-classes")
    own = stance.join(members.where("member = class").select(F.col("member").alias(key)), key, "left_semi").withColumnRenamed(key, "class")
    place = ["group_name", "evidence_id"]
    common = own.groupBy(*place).agg(F.count(F.lit(1)).alias("held"))
    commonest = Window.partitionBy("class").orderBy(F.desc("held"), *place)
    own = settle(own.join(common, place).withColumn("from_commonest", F.row_number().over(commonest)), "class-stances")
    side = lambda df, s: df.select(*place, F.col("class").alias(f"class_{s}"), F.col("value").alias(f"value_{s}"))
    rare = own.where(F.col("from_commonest") >= least_shared).where("held > 1")
    gap = F.abs(F.col("value_a") - F.col("value_b"))
    met = side(rare, "a").join(side(rare, "b"), place).where((F.col("class_a") < F.col("class_b")) & (gap < K.AGREE_BELOW)).select("class_a", "class_b").distinct()
    both = met.join(side(own, "a"), "class_a").join(side(own, "b"), ["class_b", *place])
    pairs = both.groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("shared"), F.max(gap).alias("gap"))
    pairs = pairs.where((F.col("shared") >= least_shared) & (F.col("gap") < K.AGREE_BELOW)).select("class_a", "class_b", "shared")
    return pairs, members


def coherent(stance: DataFrame, key: str, least_shared: int = K.COHERENT_FROM_SHARED) -> DataFrame:
    """a, b, shared: the same for the members, pair by pair."""
    pairs, members = coherent_classes(stance, key, least_shared)
    within = members.where((F.col("member") == F.col("class")) & (F.col("n") >= least_shared)).select(F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.col("n").alias("shared"))
    side = lambda s: members.select(F.col("class").alias(f"class_{s}"), F.col("member").alias(s))
    spread = pairs.unionByName(within).join(side("a"), "class_a").join(side("b"), "class_b")
    inside = F.col("class_a") == F.col("class_b")
    return spread.where(~inside | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared")


def equivalence(stance: DataFrame, key: str) -> DataFrame:
    """members and size of each class of equal stances (values to two digits)."""
    vector = F.sort_array(F.collect_list(F.struct("group_name", "evidence_id", F.bround("value", 2).alias("value"))))
    return stance.groupBy(key).agg(vector.alias("v")).groupBy("v").agg(F.sort_array(F.collect_list(key)).alias("members")).select("members", F.size("members").alias("size"))


def paper_stances(m: ClaimMap) -> DataFrame:
    """paper_id, group_name, evidence_id, value, explicit: an explicit value of the paper's last such claim, else the value carried by its first.

    The value carried is the last one said at the first target of the claim that is its own paper's member of the group.
    """
    c = m.claims.select("claim_id", "paper_id", "claim_seq")
    members = present_members(m).select("group_name", "evidence_id").distinct()
    said = last_targets(m).join(members, "evidence_id").join(c, "claim_id")
    explicit = said.groupBy("paper_id", "group_name", "evidence_id").agg(F.max_by("value", "claim_seq").alias("value"))
    homes = home_predictions(m).select("claim_id", "group_name", F.col("home_evidence").alias("evidence_id"))
    home_values = homes.join(last_targets(m), ["claim_id", "evidence_id"]).select("claim_id", "group_name", F.col("value").alias("home_value"))
    carried = home_values.join(members, "group_name").join(last_targets(m).select("claim_id", "evidence_id"), ["claim_id", "evidence_id"], "left_anti").join(c, "claim_id")
    carried = carried.groupBy("paper_id", "group_name", "evidence_id").agg(F.min_by("home_value", "claim_seq").alias("value"))
    keys = ["paper_id", "group_name", "evidence_id"]
    return explicit.withColumn("explicit", F.lit(True)).unionByName(carried.join(explicit, keys, "left_anti").withColumn("explicit", F.lit(False)))


def direction(value) -> F.Column:
    return F.when(value >= K.POSITIVE_FROM, "positive").otherwise("negative")


def _contributions(m: ClaimMap) -> DataFrame:
    """group_name, direction, paper_id, claim_id, evidence_id, value of explicit targets; an evidence in several groups counts in the last by name."""
    last = m.members.groupBy("evidence_id").agg(F.max("group_name").alias("group_name"))
    return targets(m).join(last, "evidence_id").join(m.claims.select("claim_id", "paper_id", "keywords"), "claim_id").withColumn("direction", direction(F.col("value")))


def direction_buckets(m: ClaimMap) -> DataFrame:
    """Each group and direction that any paper predicts: how many papers, and evidence that is so or is not."""
    said = _contributions(m)
    actual = first_dimensions(m.dimensions).select("evidence_id", direction(F.col("value")).alias("is"))
    in_group = m.members.select("group_name", "evidence_id").distinct()
    touched = said.join(in_group, ["group_name", "evidence_id"], "left_semi").join(actual, "evidence_id")
    fits = F.col("is") == F.col("direction")
    found = touched.groupBy("group_name", "direction").agg(F.array_sort(F.collect_set(F.when(fits, F.col("evidence_id")))).alias("supporting"), F.array_sort(F.collect_set(F.when(~fits, F.col("evidence_id")))).alias("contesting"))
    papers = said.groupBy("group_name", "direction").agg(F.array_sort(F.collect_set("paper_id")).alias("papers"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords")))).alias("keywords"), F.array_sort(F.collect_set(F.bround("value", 2))).alias("values"))
    none = F.array().cast("array<string>")
    return papers.join(found, ["group_name", "direction"], "left").select("group_name", "direction", "papers", F.size("papers").alias("n_papers"), "keywords", "values", F.coalesce("supporting", none).alias("supporting"), F.coalesce("contesting", none).alias("contesting"))


def assertions(buckets: DataFrame) -> DataFrame:
    """A row for each group: papers for and against, and what the two sides share."""
    side = lambda d, c: F.coalesce(F.first(F.when(F.col("direction") == d, F.col(c)), ignorenulls=True), F.array().cast("array<string>"))
    rows = buckets.groupBy("group_name").agg(side("positive", "papers").alias("papers_yes"), side("negative", "papers").alias("papers_no"), side("positive", "keywords").alias("__ky"), side("negative", "keywords").alias("__kn"))
    both = (F.size("papers_yes") > 0) & (F.size("papers_no") > 0)
    return rows.select("group_name", "papers_yes", "papers_no", F.array_sort(F.array_intersect("__ky", "__kn")).alias("shared_keywords"), F.array_sort(F.array_intersect("papers_yes", "papers_no")).alias("shared_papers"), both.alias("in_tension"))


def clique_stance(cliques: DataFrame, stance: DataFrame, key: str) -> DataFrame:
    """clique, group_name, evidence_id, value: the union of the members' stances; of several values that of the first member by name."""
    at = cliques.select("clique", F.explode("members").alias(key)).join(stance, key)
    return at.groupBy("clique", "group_name", "evidence_id").agg(F.min_by("value", key).alias("value"))


def clique_titles(cliques: DataFrame, m: ClaimMap) -> DataFrame:
    """clique, title (the label of its first claim in input order), papers, keywords."""
    at = cliques.select("clique", F.explode("members").alias("claim_id")).join(m.claims.select("claim_id", "claim_seq", "paper_id", "label", "keywords"), "claim_id")
    return at.groupBy("clique").agg(
        F.min_by("label", "claim_seq").alias("title"), F.array_sort(F.collect_set("paper_id")).alias("papers"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords")))).alias("keywords"))


def clique_residual(union: DataFrame, m: ClaimMap) -> DataFrame:
    """Squared misses of a clique's stance, summed."""
    at = union.join(first_dimensions(m.dimensions).select("evidence_id", F.col("value").alias("actual")), "evidence_id")
    return at.groupBy("clique").agg(F.sum(F.pow(F.col("value") - F.col("actual"), 2)).alias("residual_sq"))


def ranked_cliques(cliques: DataFrame) -> DataFrame:
    """rank by size, then members: inside each size, after the cliques of greater sizes (a row for each size)."""
    ahead = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    before = cliques.groupBy("size").agg(F.count(F.lit(1)).alias("n")).select("size", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("size").orderBy("members"))
    return cliques.withColumn("rank", inside).join(before, "size").withColumn("rank", F.col("rank") + F.col("before")).drop("before")
