"""A Merkle manifest of a dataset by slot pivots: every row a leaf, every eight nodes in a run one parent, with proofs.

A leaf is the digest of a row's fields. The leaves of a language stand in order of doc_id; every eight consecutive nodes
become the digest of their digests, until one node (the subroot) is left, and the subroots give the root the same way. A
parent's children are spread into eight slot columns by conditional aggregates: the columns joined and hashed are the
parent, and the columns without a child's own slot are that child's siblings.

Only leaves go through shuffles, never texts: one to number them (by ranges of doc_id, with offsets from counts of the
ranges) and one for the first pivot; each level above has an eighth of the rows of the one below. On the way back the
siblings above a node are joined to its slot columns, level by level, and the leaves come out of their parents' slots
without a further join. Number of rounds: the logarithm to base 8 of the largest language. The langs are ranked in one
window, a row each.

Defined cases: a null field counts as `-`; null languages are a language of their own, first of all; rows with a null
doc_id come first in their language; rows of one doc_id are ordered by leaf, so repeated rows are repeated leaves; a
language with one row has its leaf for subroot; an empty text is `0:`. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialize, range_buckets

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The letters that tampering changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` if null, else its length in UTF-8 bytes, a colon and the value."""
    said = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf(text: Column) -> Column:
    return digest(*[field(F.col(c)) for c in FIELDS[:-1]], field(text))


def tampered(doc_id: Column) -> Column:
    """Whether the query changes this row: 3 divides the CRC of its doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame, rows_each: int = 256) -> DataFrame:
    """doc_id, key (of the language: sorts as it does, null first), n (rows of the language), idx (place there, from 0), leaf, other.

    other: the leaf after tampering, null for rows that are not tampered with.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in FIELDS[1:]])
    plain = plain.withColumn("key", F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "lang"))).withColumn("order_id", F.coalesce("doc_id", F.lit(-(2**63))))
    placed = range_buckets(plain, "order_id", "range", rows_each)
    counts = placed.groupBy("key", "range").agg(F.count(F.lit(1)).alias("rows"))
    of_key = Window.partitionBy("key")
    offsets = counts.select("key", "range", F.sum("rows").over(of_key).alias("n"), (F.sum("rows").over(of_key.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"))
    hashed = placed.select("key", "range", "doc_id", leaf(F.col("text")).alias("leaf"), F.when(tampered(F.col("doc_id")), leaf(F.translate("text", UPPER, LOWER))).alias("other"))
    inside = Window.partitionBy("key", "range").orderBy(F.col("doc_id").asc_nulls_first(), "leaf")
    numbered = hashed.withColumn("place", F.row_number().over(inside))
    return numbered.join(offsets, ["key", "range"]).select("doc_id", "key", "n", (F.col("before") + F.col("place") - 1).alias("idx"), "leaf", "other")


def pivot(nodes: DataFrame, slot: Column) -> DataFrame:
    """nodes: key, n, idx and what slot reads. A row for each parent: key, n (nodes below), idx and a column for each slot."""
    own = F.col("idx") % FANOUT
    return nodes.groupBy("key", "n", F.expr(f"idx div {FANOUT}").alias("parent")).agg(*[F.max(F.when(own == j, slot)).alias(f"s{j}") for j in range(FANOUT)]).withColumnRenamed("parent", "idx")


def _hash(j: int) -> Column:
    return F.col(f"s{j}.hash")


def parent_hash() -> Column:
    """Of a row of slots; a node that is alone on its level is what it was."""
    return F.when(F.col("n") == 1, _hash(0)).otherwise(F.sha2(F.concat_ws("", *map(_hash, range(FANOUT))).cast("binary"), 256))


def _above(slots: DataFrame) -> DataFrame:
    """The parents of a level as nodes of the next."""
    return slots.select("key", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), "idx", F.struct(parent_hash().alias("hash")).alias("node"))


def rise(first: DataFrame, most: int, name: str) -> list[DataFrame]:
    """Tables of slots, from the first (given, written) to the one whose parents are alone. most: nodes of the largest tree."""
    levels, left = [first], -(-most // FANOUT)
    while left > 1:
        levels.append(materialize(pivot(_above(levels[-1]), F.col("node")), name))
        left = -(-left // FANOUT)
    return levels


SIDES = "array<struct<l:string, r:string>>"


def children(slots: DataFrame, above: DataFrame, *more: str) -> DataFrame:
    """key, idx, slot and path of each child. slots: a level; above: key, idx, path and more of its parents.

    path: what stands left and right of a node and of each of its ancestors. A node alone on its level adds nothing.
    """
    def sides(j: int) -> Column:
        left, right = ([_hash(i) for i in some] for some in (range(j), range(j + 1, FANOUT)))
        own = F.array(F.struct((F.concat_ws("", *left) if left else F.lit("")).alias("l"), (F.concat_ws("", *right) if right else F.lit("")).alias("r")))
        return F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(own, "path"))

    each = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"s{j}").alias("slot"), sides(j).alias("path")) for j in range(FANOUT)])
    there = slots.join(above, ["key", "idx"]).select("key", "idx", *more, F.explode(F.filter(each, lambda c: c["slot"].isNotNull())).alias("c"))
    return there.select("key", (F.col("idx") * FANOUT + F.col("c.j")).alias("idx"), *more, F.col("c.slot").alias("slot"), F.col("c.path").alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["l"], node, s["r"]))


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row."""
    slot = F.struct(F.col("leaf").alias("hash"), "doc_id", "other")
    first = materialize(pivot(leaves(docs), slot), "merkle-leaves")
    most = first.agg(F.max("n")).first()[0] or 0
    trees = rise(first, most, "merkle-level")
    # the subroots, one for each language, are the leaves of a last tree
    roots = _above(trees[-1]).select("key", "node")
    ranked = roots.select(F.lit("").alias("key"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"), (F.row_number().over(Window.orderBy("key")) - 1).alias("idx"), F.struct("node.hash", F.col("key").alias("of")).alias("node"))
    top = materialize(pivot(ranked, F.col("node")), "merkle-subroots")
    tops = rise(top, top.agg(F.max("n")).first()[0] or 0, "merkle-top")
    above = _above(tops[-1]).select("key", "idx", F.col("node.hash").alias("root"), F.array().cast(SIDES).alias("path"))
    for level in reversed(tops[1:]):
        above = children(level, above, "root").drop("slot")
    above = children(top, above, "root").select(F.col("slot.of").alias("key"), F.lit(0).cast("long").alias("idx"), "root", F.col("slot.hash").alias("subroot"), "path")
    for level in reversed(trees[1:]):
        above = children(level, above, "root", "subroot").drop("slot")
    out = children(first, above, "root", "subroot").select("slot.doc_id", F.col("slot.hash").alias("leaf"), "subroot", "root", "path", F.coalesce("slot.other", "slot.hash").alias("now"))
    out = out.withColumn("folded_root", fold(F.col("now"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


