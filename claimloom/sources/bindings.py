"""The claim map's tables derived from general ones: labelled documents, or parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources.model import ClaimMap
from claimloom.sources.scratch import settle


def hundredths(total: F.Column, count: F.Column) -> F.Column:
    """A mean of whole numbers, rounded half up to two digits by whole-number arithmetic."""
    return F.floor((200 * total + count) / (2 * count)).cast("double") / 100.0


def labelled_documents(spark: SparkSession, sf_dir: str) -> ClaimMap:
    """Sources are papers, labelled documents are evidence of quality in their language, languages are groups.

    A source claims, for each language, its mean quality at its own documents, the same to one digit at the language's
    first labelled document, and, if it has toxic ones there, its mean toxicity wherever that is observed.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    seen = settle(docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id"), "labelled")  # all tables of the map are made of it
    ev = F.concat(F.lit("ev_"), F.col("doc_id").cast("string"))
    evidence = seen.select(
        ev.alias("evidence_id"), F.col("source").alias("paper_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("label"), F.col("doc_id").alias("ev_seq"), F.col("lang").alias("system"),
        F.lit("text").alias("framework"), F.when(F.col("n_chars") >= 2000, "extended").otherwise("brief").alias("regime"), F.when(F.col("n_chars") >= 500, 0.9).otherwise(0.4).alias("confidence"))
    scale = F.lit("normalized_binary")
    dimensions = seen.select(ev.alias("evidence_id"), F.lit(0).alias("dim_seq"), F.col("lang").alias("name"), F.col("quality").cast("double").alias("value"), scale.alias("scale")).unionByName(
        seen.select(ev.alias("evidence_id"), F.lit(1).alias("dim_seq"), F.concat(F.lit("toxic_"), "lang").alias("name"), F.col("toxic").cast("double").alias("value"), scale.alias("scale")))
    members = seen.select(F.col("lang").alias("group_name"), F.concat(F.lit("Quality in "), "lang").alias("title"), F.lit("").alias("description"), F.col("doc_id").cast("int").alias("member_seq"), ev.alias("evidence_id"))
    by = settle(seen.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").alias("q"), F.sum("toxic").alias("t"), F.sum("n_chars").alias("c"), F.min("doc_id").alias("first_doc"),
        F.transform(F.sort_array(F.collect_list("doc_id")), lambda d: F.concat(F.lit("ev_"), d.cast("string"))).alias("own")), "labelled-claims")
    claim_id = F.concat("source", F.lit("_"), "lang")
    claims = by.select(
        claim_id.alias("claim_id"), F.col("source").alias("paper_id"), F.concat("source", F.lit(" in "), "lang").alias("label"), F.col("first_doc").alias("claim_seq"), F.col("lang").alias("system"), F.lit("text").alias("framework"),
        F.array(F.when(F.col("c") >= 2000 * F.col("n"), "extended").otherwise("brief")).alias("keywords"), F.lit(1.0).alias("init_in"), F.lit(1.0).alias("init_out"), F.lit(1.0).alias("final_in"), F.lit(1.0).alias("final_out"),
        (0.5 + hundredths(F.col("q"), F.col("n")) / 4).alias("confidence"))
    quality = by.select(claim_id.alias("claim_id"), F.lit(0).alias("pred_seq"), F.col("lang").alias("observable"), hundredths(F.col("q"), F.col("n")).alias("value"), scale.alias("scale"), F.col("own").alias("evidence_ids"), F.lit(None).cast("string").alias("regime_tag"))
    toxic = by.where("t > 0").select(claim_id.alias("claim_id"), F.lit(1).alias("pred_seq"), F.concat(F.lit("toxic_"), "lang").alias("observable"), hundredths(F.col("t"), F.col("n")).alias("value"), scale.alias("scale"), F.array().cast("array<string>").alias("evidence_ids"), F.lit(None).cast("string").alias("regime_tag"))
    lead = seen.groupBy("lang").agg(F.concat(F.lit("ev_"), F.min("doc_id").cast("string")).alias("lead"))
    led = by.join(lead, "lang").select(claim_id.alias("claim_id"), F.lit(2).alias("pred_seq"), F.col("lang").alias("observable"), (F.floor(10 * F.col("q") / F.col("n")).cast("double") / 10.0).alias("value"), scale.alias("scale"), F.array("lead").alias("evidence_ids"), F.lit(None).cast("string").alias("regime_tag"))
    return ClaimMap(claims, quality.unionByName(toxic).unionByName(led), evidence, dimensions, members)


def shipped_parts(spark: SparkSession, sf_dir: str) -> ClaimMap:
    """Suppliers are papers, parts are evidence of whether they are returned often, brands are groups: a large map.

    A part belongs to the first supplier that ships it. A supplier claims, for each brand, its own share of returned
    lines, at the parts of the brand that it ships.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").cast("long").alias("r"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    whole = lines.agg(F.sum("r").alias("all_r"), F.count(F.lit(1)).alias("all_n"))
    by_part = lines.groupBy("l_partkey").agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("n"), F.min("l_suppkey").alias("first_supplier")).join(parts, F.col("l_partkey") == F.col("p_partkey")).crossJoin(F.broadcast(whole))  # one row
    # lines are read for two tables, of which all others are made
    by_part = settle(by_part, "shipped-parts")
    ev, paper = F.concat(F.lit("part_"), F.col("l_partkey").cast("string")), F.concat(F.lit("supplier_"), F.col("first_supplier").cast("string"))
    evidence = by_part.select(ev.alias("evidence_id"), paper.alias("paper_id"), F.lit("").alias("label"), F.col("l_partkey").alias("ev_seq"), F.col("p_brand").alias("system"), F.lit("parts").alias("framework"), F.lit("").alias("regime"), F.lit(0.9).alias("confidence"))
    scale = F.lit("normalized_binary").alias("scale")
    dimensions = by_part.select(ev.alias("evidence_id"), F.lit(0).alias("dim_seq"), F.col("p_brand").alias("name"), F.when(F.col("r") * F.col("all_n") >= F.col("all_r") * F.col("n"), 1.0).otherwise(0.0).alias("value"), scale)
    members = by_part.select(F.col("p_brand").alias("group_name"), F.col("p_brand").alias("title"), F.lit("").alias("description"), F.col("l_partkey").cast("int").alias("member_seq"), ev.alias("evidence_id"))
    shipped = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("l_partkey")).alias("own"))
    shipped = settle(shipped, "shipped-claims")
    claim_id = F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string"), F.lit("_"), "p_brand")
    one = F.lit(1.0)
    claims = shipped.select(
        claim_id.alias("claim_id"), F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("paper_id"), F.lit("").alias("label"), F.col("l_suppkey").alias("claim_seq"), F.col("p_brand").alias("system"), F.lit("parts").alias("framework"),
        F.array().cast("array<string>").alias("keywords"), one.alias("init_in"), one.alias("init_out"), one.alias("final_in"), one.alias("final_out"), F.lit(0.8).alias("confidence"))
    predictions = shipped.select(claim_id.alias("claim_id"), F.lit(0).alias("pred_seq"), F.col("p_brand").alias("observable"), hundredths(F.col("r"), F.col("n")).alias("value"), scale, F.transform("own", lambda p: F.concat(F.lit("part_"), p.cast("string"))).alias("evidence_ids"), F.lit(None).cast("string").alias("regime_tag"))
    return ClaimMap(claims, predictions, evidence, dimensions, members)

