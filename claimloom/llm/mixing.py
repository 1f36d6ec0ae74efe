"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

A source with weight w of a total W gets blocks; its j-th block (from 0) is released at slot floor(j * W / w) and due at
slot ceil((j + 1) * W / w). Earliest-deadline-first over the released blocks puts exactly one into each slot, and after
any number of slots each source is less than one block off its target. Weights are whole numbers, so the schedule
repeats after W slots, when every source has had exactly w.

Sources of equal weight are one class, with their weights' sum as its weight: the classes are scheduled, as many as there
are unlike weights in the parameters, and a class deals its blocks to its sources in turn, by name. If the class is less
than one block off, so is each of its sources. The m * w blocks of a class in one period are a sorted queue by release
and deadline, so a fold over the period's slots needs only how many blocks each class has had.

When a source runs out, its slots stay empty and the others go on in theirs; positions close the gaps, so the others go on
with their own weights. All rows are kept, each once.

The position of a row follows from three numbers: the row's rank in its source, its block, and the slot of that block.
Ranks come from counts of hash buckets and a window inside each bucket, so a source that holds a third of all rows is
ranked by many tasks. Nothing is broadcast by hint: a period's slots (W rows, at least one for each source) are a table
of their own, joined by class and turn, and Spark picks the join by its size.

Defined cases: a source without a weight, also a null one, gets `default`; a weight of 0 or less is an error; repeated
rows are rows of their own, in an arbitrary but fixed order; a null text counts like any other; an empty table gives an
empty table. Other columns are kept by in_mixed_order().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialize

NONE = "\x00none"
#: Slots of a period that one list holds while it is filled.
STRETCH = 512


def schedule(classes: DataFrame) -> DataFrame:
    """classes: weight, share (of the whole class). One period: slot, weight, turn (the class's how manieth block).

    A fold over the slots, whose state is how many blocks each class has had: a number for each unlike weight.
    """
    ranked = classes.groupBy().agg(F.sort_array(F.collect_list(F.struct("weight", "share"))).alias("s"), F.sum("share").alias("total")).where("total > 0")
    total = F.col("total")

    def due(had: Column, share: Column) -> Column:
        return F.ceil((had + 1) * total / share).cast("long")

    def pick(had: Column, slot: Column) -> Column:
        """Place of the released class with the earliest deadline; of equal ones the first by weight."""
        open_ = F.transform(had, lambda h, i: F.when(F.floor(h * total / F.get(F.col("s"), i)["share"]) <= slot, F.struct(due(h, F.get(F.col("s"), i)["share"]).alias("due"), i.alias("at"), h.alias("turn"))))
        return F.array_min(F.filter(open_, lambda x: x.isNotNull()))

    def step(acc: Column, slot: Column) -> Column:
        chosen = F.transform(F.array(pick(acc["had"], slot)), lambda b: F.struct(
            F.transform(acc["had"], lambda h, i: h + F.when(i == b["at"], F.lit(1)).otherwise(F.lit(0)).cast("long")).alias("had"),
            F.concat(acc["out"], F.array(F.struct(b["at"].alias("at"), b["turn"].alias("turn")))).alias("out")))
        return F.get(chosen, F.lit(0))

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("had"), F.array().cast("array<struct<at:int,turn:bigint>>").alias("out"))
    # stretches of the period, so that no stretch's list of slots is copied more often than the stretch is long
    bounds = F.sequence(F.lit(0).cast("long"), total - 1, F.lit(STRETCH).cast("long"))

    def stretch(acc: Column, lo: Column) -> Column:
        slots = F.sequence(lo, F.least(lo + STRETCH, total) - 1)
        made = F.aggregate(slots, F.struct(acc["had"].alias("had"), F.array().cast("array<struct<at:int,turn:bigint>>").alias("out")), step)
        return F.get(F.transform(F.array(made), lambda m: F.struct(m["had"].alias("had"), F.concat(acc["all"], F.array(m["out"])).alias("all"))), F.lit(0))

    whole = F.struct(start["had"].alias("had"), F.array().cast("array<array<struct<at:int,turn:bigint>>>").alias("all"))
    filled = F.flatten(F.aggregate(bounds, whole, stretch, lambda acc: acc["all"]))
    return ranked.select("s", F.posexplode(filled).alias("slot", "x")).select(F.col("slot").cast("long").alias("slot"), F.get(F.col("s"), F.col("x.at"))["weight"].alias("weight"), F.col("x.turn").alias("turn"))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, default: int = 1, block: int = 32, seed: str = "mix", bucket_rows: int = 4096) -> DataFrame:
    """doc_id, text_key, source, source_rank, block, slot, position: the place of each row in the mix, from 0."""
    if any(w <= 0 for w in [default, *(weights or {}).values()]):
        raise ValueError("weights must be positive whole numbers")
    source = F.coalesce(F.col("source").cast("string"), F.lit(NONE))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), source.alias("source"))
    row = F.xxhash64("doc_id", "text_key", F.lit(seed))
    buckets = max(1, -(-docs.count() // bucket_rows))
    dealt = materialize(named.withColumn("drawn", row).withColumn("bucket", F.pmod(F.xxhash64("drawn"), F.lit(buckets)).cast("int")), "mix-rows")
    inside = Window.partitionBy("source", "bucket").orderBy("drawn", "doc_id", "text_key")
    counts = dealt.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # a row for each source and bucket: as many as buckets, whatever they hold
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(default)) if weights else F.lit(default)
    # a row for each source: its place among those of its weight, and how many they are
    sources = counts.select("source").distinct().withColumn("weight", weight.cast("long"))
    like = Window.partitionBy("weight")
    sources = materialize(sources.withColumn("nth", F.row_number().over(like.orderBy("source")) - 1).withColumn("like", F.count(F.lit(1)).over(like)), "mix-sources")
    classes = sources.groupBy("weight").agg((F.col("weight") * F.count(F.lit(1))).alias("share"))
    total = sources.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    turns = materialize(schedule(classes), "mix-schedule").withColumnRenamed("slot", "in_period")
    ranked = dealt.withColumn("r", F.row_number().over(inside) - 1).join(before.select("source", "bucket", "before"), ["source", "bucket"]).join(sources, "source")
    ranked = ranked.select("doc_id", "text_key", "source", "weight", "nth", "like", (F.col("r") + F.col("before")).cast("long").alias("source_rank")).withColumn("block", F.floor(F.col("source_rank") / block).cast("long"))
    # the class's block, its turn within the period and the period
    placed = ranked.withColumn("of_class", F.col("block") * F.col("like") + F.col("nth")).withColumn("turn", F.col("of_class") % (F.col("weight") * F.col("like")))
    placed = placed.withColumn("period", F.floor(F.col("of_class") / (F.col("weight") * F.col("like"))).cast("long"))
    slotted = placed.join(turns, ["weight", "turn"]).select("doc_id", "text_key", "source", "source_rank", "block", (F.col("period") * total + F.col("in_period")).cast("long").alias("slot"))
    slotted = materialize(slotted, "mix-slots")
    # positions: rows before the slot, from counts by ranges of slots; a range is summed by one task, ranges by a small window
    filled = slotted.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.floor(F.col("slot") / 4096))
    ranges = filled.groupBy("range").agg(F.sum("n").alias("n"))
    ahead = ranges.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = filled.withColumn("within", F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = within.join(ahead, "range").select("slot", (F.col("within") + F.col("ahead")).alias("offset"))
    position = (F.col("offset") + F.col("source_rank") - F.col("block") * block).cast("long")
    real = F.when(F.col("source") != NONE, F.col("source")).alias("source")
    return slotted.join(offsets, "slot").select("doc_id", "text_key", real, "source_rank", "block", "slot", position.alias("position"))


def in_mixed_order(docs: DataFrame, **how) -> DataFrame:
    """docs with their columns, all rows, sorted by their place in the mix."""
    placed = mix(docs, **how).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("position").alias("__position"))
    placed = placed.withColumn("__copy", F.row_number().over(Window.partitionBy("__id", "__key").orderBy("__position")))
    keyed = docs.withColumn("__text_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    alike = Window.partitionBy(F.col("doc_id").cast("long"), "__text_key").orderBy("__text_key")
    numbered = keyed.withColumn("__nth", F.row_number().over(alike))
    joined = numbered.join(placed, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")) & (F.col("__nth") == F.col("__copy")))
    return joined.orderBy("__position").select(*docs.columns)
