"""The stream of totals against the batch operators, over two runs, with late and repeated findings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from claimloom.operators import edges, optimize, residuals
from claimloom.streaming import totals
from tests.test_claim_map import make

START = datetime(2020, 1, 1)


def test_two_runs_equal_the_batch(spark, tmp_path):
    evidence = [(f"e{i}", f"p{i % 4}", "x" if i % 3 else "y", i % 2) for i in range(12)]
    m = make(spark, [("c1", "p1", []), ("c2", "p2", ["linear"]), ("c3", "p3", [])],
             [("c1", "x", 1, [], None), ("c1", "y", 0.5, ["e3", "e6"], None), ("c1", "z", 0.5, ["e1"], None), ("c2", "x", 0.2, ["e1", "e2", "gone"], None), ("c3", "none", 1, [], None)], evidence, dims=[("e1", "z", 1), ("e2", "x", 0.2)])
    found = totals.findings(m, F.lit(START) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("ev_seq").cast("int")))
    folder = str(tmp_path / "arriving")
    arriving = lambda: spark.readStream.schema(totals.FINDING).option("maxFilesPerTrigger", 1).parquet(folder)
    follow = lambda: totals.follow(arriving(), m, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "10 minutes").collect()
    found.where("at < timestamp'2020-01-01 00:06:00'").coalesce(1).write.mode("append").parquet(folder)
    follow()
    rest = found.where("at >= timestamp'2020-01-01 00:06:00'")
    again = found.where("evidence_id = 'e5'")  # the same finding once more
    rest.unionByName(again).coalesce(1).write.mode("append").parquet(folder)
    got = {r.claim_id: (r.edges, round(r.r_in, 9), round(r.r_out, 9), r.stature) for r in follow()}
    full = residuals.scored(residuals.wired(m, edges.prediction_edges(m)))
    sums = optimize.rewrites(full, m.claims.withColumn("lambda", F.lit(1.0)))
    stature = {r.claim_id: r.stature for r in optimize.stature(full).collect()}
    inner = F.col("regime_tag") == "in_regime"
    want = {r.claim_id: (r.n, round(r.i, 9), round(r.o, 9), stature.get(r.claim_id, 0)) for r in full.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(inner, F.col("residual_sq")).otherwise(0.0)).alias("i"), F.sum(F.when(inner, 0.0).otherwise(F.col("residual_sq"))).alias("o")).collect()}
    assert got == want and sums.count() == len(want)
    # a later finding moves the watermark; one from before it is late then and changes nothing
    late = found.where("evidence_id = 'e0'").withColumn("evidence_id", F.lit("e9")).withColumn("dims", F.array(F.struct(F.lit("x").alias("name"), F.lit(0.0).alias("value"))))
    far = late.withColumn("evidence_id", F.lit("far")).withColumn("at", F.lit(START + timedelta(days=1))).withColumn("dims", F.array(F.struct(F.lit("other").alias("name"), F.lit(0.0).alias("value"))))
    far.coalesce(1).write.mode("append").parquet(folder)
    follow()
    late.withColumn("evidence_id", F.lit("late")).coalesce(1).write.mode("append").parquet(folder)
    assert {r.claim_id: r.edges for r in follow()} == {c: v[0] for c, v in want.items()}


def test_findings_meet_what_is_aimed_at_them(spark):
    """No row is made for a finding and a prediction that is aimed at others, and a null target aims at none."""
    n = 300
    evidence = [(f"e{i}", f"p{i % 4}", "x", i % 2) for i in range(n)]
    m = make(spark, [("c1", "p1", []), ("c2", "p2", []), ("c3", "p3", [])], [("c1", "x", 1, [f"e{i}" for i in range(n)], None), ("c2", "x", 0.2, [], None), ("c3", "x", 0.5, [None, "e1"], None)], evidence)
    met = totals.arriving_edges(totals.findings(m, F.lit(START)), m)
    assert sorted(r["count"] for r in met.groupBy("claim_id").count().collect()) == [1, n, n]
    joins = [x for x in met._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and " = of#" in x]
    assert len(joins) == 1 and " OR " not in joins[0].upper()
