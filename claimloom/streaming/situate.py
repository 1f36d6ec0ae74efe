"""An extension beyond batch: contributions that arrive as a stream are set into a stored map, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimloom.operators.situate import situated, verdicts
from claimloom.sources.model import ClaimMap

#: What arrives: a finding with its one dimension.
FINDING = "evidence_id string, paper_id string, label string, system string, framework string, regime string, confidence double, name string, value double, scale string"


def as_map(batch: DataFrame, prior: ClaimMap) -> ClaimMap:
    seen = batch.dropDuplicates(["evidence_id"])
    evidence = seen.select("evidence_id", "paper_id", "label", F.xxhash64("evidence_id").alias("ev_seq"), "system", "framework", "regime", "confidence")
    dimensions = seen.select("evidence_id", F.lit(0).alias("dim_seq"), "name", "value", "scale")
    return ClaimMap(prior.claims.limit(0), prior.predictions.limit(0), evidence, dimensions, prior.members.limit(0))


def situate_stream(findings: DataFrame, prior: ClaimMap, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each micro-batch of findings the verdicts against the map; sink(verdicts, batch number) writes them, idempotently by number."""

    def one(batch: DataFrame, number: int) -> None:
        new = as_map(batch, prior)
        sink(verdicts(situated(prior, new), prior, new).drop("ev_seq"), number)

    return findings.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
