"""What a contribution changes in a map's ideas: a structured difference of two versions.

An idea is known by its group, paper and claims, as its number may change from one version to the next. Versions meet in
null-safe full outer joins on these; relations, which hold both ways, are compared once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = ["group_name", "paper_id", "claims"]
CHANGE = ["change", *NAME, "other_paper", "other_claims", "before", "after"]


def _named(status: DataFrame) -> DataFrame:
    return status.select("idea_id", "group_name", "paper_id", F.array_join("claim_ids", ",").alias("claims"), "status")


def _meet(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, old, new: the value in either version, null where it is not there."""
    b, a = before.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col(value).alias("old")), after.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col(value).alias("new"))
    same = reduce(lambda x, y: x & y, [F.col(f"b_{k}").eqNullSafe(F.col(f"a_{k}")) for k in keys])
    return b.join(a, same, "full").select(*[F.when(F.col("new").isNotNull(), F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")).alias(k) for k in keys], "old", "new")


def idea_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ideas added, removed or of another status. before, after: ideas with their status."""
    met = _meet(_named(before), _named(after), NAME, "status").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "idea_added").when(F.col("new").isNull(), "idea_removed").otherwise("status_changed")
    none = F.lit(None).cast("string")
    return met.select(kind.alias("change"), *NAME, none.alias("other_paper"), none.alias("other_claims"), F.col("old").alias("before"), F.col("new").alias("after"))


def _pairs(status: DataFrame, related: DataFrame) -> DataFrame:
    names = _named(status)
    a, b = (names.select(F.col("idea_id").alias(f"idea_{s}"), F.col("paper_id").alias(f"paper_{s}"), F.col("claims").alias(f"claims_{s}")) for s in "ab")
    pairs = related.select("group_name", "idea_a", "idea_b", "kind").join(a, "idea_a").join(b, "idea_b")
    return pairs.where(F.struct("paper_a", "claims_a") < F.struct("paper_b", "claims_b"))


def relation_changes(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Contests and supports introduced or gone. before, after: ideas with their status, and their relations.

    A pair that supported and contests now is a contest introduced, with what it was before.
    """
    met = _meet(_pairs(*before), _pairs(*after), ["group_name", "paper_a", "claims_a", "paper_b", "claims_b"], "kind").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("new") == "contests", "contest_introduced").when(F.col("new") == "supports", "support_introduced").when(F.col("old") == "contests", "contest_gone").otherwise("support_gone")
    return met.select(kind.alias("change"), "group_name", F.col("paper_a").alias("paper_id"), F.col("claims_a").alias("claims"), F.col("paper_b").alias("other_paper"), F.col("claims_b").alias("other_claims"), F.col("old").alias("before"), F.col("new").alias("after"))


def map_changes(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """All changes, a row each: change, the idea, the other idea of a relation, before and after."""
    return idea_changes(before[0], after[0]).unionByName(relation_changes(before, after)).select(CHANGE)
