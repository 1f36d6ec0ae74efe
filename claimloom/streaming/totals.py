"""A living map as a stream: what each claim's edges add up to is state, brought up to date as findings arrive.

A finding meets the stored predictions in a stream-static join; its edges go to their claim, whose state is a number of
edges, the two sums that a rewrite needs, and its backing papers, a key each. A finding that is older than the watermark
is late and is not counted; findings of one id count once within the watermark's delay. After all findings the last row of
each claim is what the batch operators give for its base edges. Findings made in 1970 or before are late for Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimloom import constants as K
from claimloom.operators.edges import SHARES, regime
from claimloom.sources.model import ClaimMap

#: What arrives: a finding with its dimensions, in order, and when it was made.
FINDING = "evidence_id string, paper_id string, label string, system string, framework string, regime string, at timestamp, dims array<struct<name string, value double>>"
TOTALS = "claim_id string, edges long, r_in double, r_out double, stature long, seen timestamp"


def findings(m: ClaimMap, at: F.Column) -> DataFrame:
    """A map's evidence as findings. at: when each was made, from columns of evidence."""
    dims = m.dimensions.groupBy("evidence_id").agg(F.sort_array(F.collect_list(F.struct("dim_seq", "name", "value"))).alias("d")).select("evidence_id", F.transform("d", lambda d: F.struct(d["name"].alias("name"), d["value"].alias("value"))).alias("dims"))
    return m.evidence.join(dims, "evidence_id").select("evidence_id", "paper_id", "label", "system", "framework", "regime", at.cast("timestamp").alias("at"), "dims")


def arriving_edges(arriving: DataFrame, m: ClaimMap) -> DataFrame:
    """claim_id, evidence_id, ev_paper, at, miss, inside, pred_seq, dim_seq, init_out of findings and the predictions of m, batch or stream."""
    each = arriving.select("evidence_id", F.col("paper_id").alias("ev_paper"), "label", F.col("system").alias("s"), F.col("framework").alias("f"), "regime", "at", F.posexplode("dims").alias("dim_seq", "d"))
    # one join on equal keys: by its own name a finding meets what is aimed at it, by its share of all findings what is open
    share = F.pmod(F.xxhash64("evidence_id"), F.lit(SHARES)).cast("string")
    each = each.withColumn("key", F.explode(F.array(*[F.struct(F.lit(aimed).alias("aimed"), k.alias("of")) for aimed, k in ((True, F.col("evidence_id")), (False, share))])))
    open_ = F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0
    said = m.predictions.select("claim_id", "pred_seq", "observable", F.col("value").alias("pred_value"), "regime_tag", "evidence_ids", (~open_).alias("aimed"))
    said = said.join(m.claims.select("claim_id", "paper_id", "keywords", "init_in", "init_out"), "claim_id")
    shares = F.array(*[F.lit(str(i)) for i in range(SHARES)])
    said = said.withColumn("of", F.explode(F.when(~F.col("aimed"), shares).otherwise(F.array_distinct("evidence_ids")))).drop("evidence_ids")
    met = each.join(said, (F.col("d.name") == F.col("observable")) & (F.col("key.aimed") == F.col("aimed")) & (F.col("key.of") == F.col("of")))
    haystack = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("ev_paper", "label", "s", "f", "regime")]))
    tag = regime(F.col("regime_tag"), F.col("paper_id") == F.col("ev_paper"), F.col("keywords"), haystack)
    inside = tag == "in_regime"
    return met.select("claim_id", "evidence_id", "ev_paper", "at", F.pow(F.col("pred_value") - F.col("d.value"), 2).alias("miss"), inside.alias("inside"), "pred_seq", "dim_seq", F.when(inside, F.col("init_in")).otherwise(F.col("init_out")).alias("strength"))


class ClaimTotals(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "edges long, r_in double, r_out double, stature long")
        self.papers = handle.getMapState("papers", "paper string", "edges long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the rows of one finding come together; of several edges at one evidence the first prediction counts
        met = pd.concat(rows).sort_values(["evidence_id", "pred_seq", "dim_seq"]).drop_duplicates("evidence_id")
        edges, r_in, r_out, stature = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0, 0)
        for paper, n in met[met.miss * met.strength**2 <= K.BACKING_AT_MOST].groupby("ev_paper").size().items():
            known = self.papers.containsKey((paper,))
            self.papers.updateValue((paper,), ((self.papers.getValue((paper,))[0] if known else 0) + int(n),))
            stature += not known
        edges += len(met)
        r_in, r_out = r_in + float(met.miss[met.inside].sum()), r_out + float(met.miss[~met.inside].sum())
        self.sums.update((edges, r_in, r_out, stature))
        yield pd.DataFrame({"claim_id": [key[0]], "edges": [edges], "r_in": [r_in], "r_out": [r_out], "stature": [stature], "seen": [met["at"].max()]})

    def close(self) -> None:
        pass


def totals_stream(arriving: DataFrame, m: ClaimMap, delay: str = "1 hour") -> DataFrame:
    """A row of TOTALS for each claim that a micro-batch of findings changes."""
    once = arriving.withWatermark("at", delay).dropDuplicatesWithinWatermark(["evidence_id"])
    return arriving_edges(once, m).groupBy("claim_id").transformWithStateInPandas(ClaimTotals(), TOTALS, "Update", "None")


def follow(arriving: DataFrame, m: ClaimMap, out: str, checkpoint: str, delay: str = "1 hour") -> DataFrame:
    """Runs over what has arrived, appends the changed totals to out, and returns the last row of each claim."""
    spark = arriving.sparkSession
    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind, None)
    spark.conf.set(kind, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        def append(batch: DataFrame, number: int) -> None:
            # by number, so that a batch that is run again replaces its rows
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

        totals_stream(arriving, m, delay).writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(kind, before) if before else spark.conf.unset(kind)
    rows = spark.read.schema(TOTALS + ", batch long").option("recursiveFileLookup", True).parquet(out)
    last = rows.groupBy("claim_id").agg(F.max_by(F.struct("edges", "r_in", "r_out", "stature"), F.struct("batch", "edges")).alias("t"))
    return last.select("claim_id", "t.*")
