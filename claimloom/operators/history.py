"""What stood at a time: logs of states, their changes, and the last state before each question.

A log is merged with questions in ranges of time, so that no task needs the whole history of a key: inside a range a window
carries the last state on, and the last states of ranges, one row for each key and range, carry it from range to range.

Defined cases: of states of one key and time the greatest `order` comes last; a state at the time of a question already
stands; rows of the log without key or time tell nothing; a question without them, or before the first state, has null
states and is kept. Repeated questions are answered each. Rows of one key *and* one time are not split.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges are numbered by at most this many bounds; beyond it they only get larger.
MOST_RANGES = 20_000


def _number(rows: DataFrame, at: str) -> Column:
    """A number that never falls as time goes on. Times without zone are taken as written, so clock changes do not fold them."""
    t = F.col(at)
    if rows.schema[at].dataType.typeName() != "timestamp_ntz":
        return t.cast("double")
    return (F.unix_date(t.cast("date")) * F.lit(86_400.0) + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("double")


def _ranged(rows: DataFrame, at: str, rows_each: int) -> DataFrame:
    """rows with __range: ranges of time, ascending, of about rows_each rows."""
    n = min(MOST_RANGES, -(-rows.count() // rows_each))
    timed = rows.withColumn("__at", _number(rows, at))
    bounds = timed.select(F.percentile_approx("__at", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0] if n > 1 else []
    splits = sorted(set(bounds or []))
    if not splits:
        return timed.withColumn("__range", F.lit(0.0)).drop("__at")
    return Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="__at", outputCol="__range").transform(timed).drop("__at")


def _carried(rows: DataFrame, key: str, at: str, order: list[str], rows_each: int) -> DataFrame:
    """rows (with __state, null where a row has none) and __before: the last state of the key among the rows before."""
    ranged = _ranged(rows, at, rows_each)
    inside = Window.partitionBy(key, "__range").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy(key, "__range").agg(F.max_by("__state", F.when(F.col("__state").isNotNull(), F.struct(at, *order))).alias("__end"))
    across = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select(key, "__range", F.last("__end", ignorenulls=True).over(across).alias("__earlier"))
    near = ranged.withColumn("__near", F.last("__state", ignorenulls=True).over(inside))
    return near.join(earlier, [key, "__range"]).withColumn("__before", F.coalesce("__near", "__earlier")).drop("__near", "__earlier", "__range")


def as_of(log: DataFrame, questions: DataFrame, key: str, at: str, order: str, states: list[str], rows_each: int = 1_000_000) -> DataFrame:
    """questions with the columns `state_<name>` of the last row of the log at or before them."""
    asked = questions.select(key, at, F.struct(*questions.columns).alias("__question"))
    whole = F.col(key).isNotNull() & F.col(at).isNotNull()
    told = log.where(whole).select(key, at, F.lit(0).alias("__kind"), F.col(order).alias("__order"), F.struct(*states).alias("__state"))
    both = told.unionByName(asked.where(whole).withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    answered = _carried(both, key, at, ["__kind", "__order"], rows_each).where("__kind = 1").select("__question", "__before")
    unanswered = asked.where(~whole).select("__question")
    return answered.unionByName(unanswered, allowMissingColumns=True).select("__question.*", *[F.col(f"__before.{s}").alias(f"state_{s}") for s in states])


def changes(log: DataFrame, key: str, at: str, order: str, states: list[str], rows_each: int = 1_000_000) -> DataFrame:
    """The rows of the log whose states are not those of the key's row before, with the older ones as `was_<name>`; the first row of a key is one."""
    told = log.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__state", F.struct(*states))
    before = _carried(told, key, at, [order], rows_each)
    changed = before.where(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(F.col("__state")))
    return changed.select(*log.columns, *[F.col(f"__before.{s}").alias(f"was_{s}") for s in states])
