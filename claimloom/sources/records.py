"""Readers: record folders, group registries, text documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions.needles import hits
from claimloom.sources.model import ClaimMap

PROVENANCE = "struct<extractor:string, confidence:double, review_status:string, source_span:string>"
PAPER_JSON = f"paper_id string, title string, year int, authors array<string>, pdf_path string, provenance {PROVENANCE}"
CLAIM_JSON = (
    "claim_id string, paper_id string, label string, x_init array<double>, x_final array<double>, home_regime struct<system:string, framework:string, regime_keywords:array<string>>, "
    "strengths array<string>, weaknesses array<string>, "
    f"predictions array<struct<observable:string, value:double, scale:string, evidence_ids:array<string>, regime_tag:string>>, provenance {PROVENANCE}")
EVIDENCE_JSON = (
    "evidence_id string, paper_id string, label string, core struct<dimensions:array<struct<name:string, value:double, scale:string, uncertainty:double>>, locked:boolean>, "
    f"context struct<system:string, framework:string, regime:string, explicit_in_source:boolean, filled_by_pipeline:boolean>, provenance {PROVENANCE}")


def _folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files with one record each, numbered in order of path."""
    read = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("__path", F.input_file_name())
    # paths alone are ranked, a short string for each record of a map
    ranks = read.select("__path").distinct().withColumn("__seq", F.row_number().over(Window.orderBy("__path")).cast("long") - 1)
    return read.join(ranks, "__path").drop("__path")


def read_run(spark: SparkSession, run: str, registry: str | None = None) -> ClaimMap:
    """A run folder with claims/*.json and evidence/*.json, and a registry of comparable evidence."""
    claims = _folder(spark, f"{run}/claims/*.json", CLAIM_JSON)
    evidence = _folder(spark, f"{run}/evidence/*.json", EVIDENCE_JSON)
    x = lambda c, i: F.get(c, F.lit(i))
    flat = claims.select(
        "claim_id", "paper_id", "label", F.col("__seq").alias("claim_seq"), F.col("home_regime.system").alias("system"), F.col("home_regime.framework").alias("framework"), F.col("home_regime.regime_keywords").alias("keywords"),
        x("x_init", 0).alias("init_in"), x("x_init", 1).alias("init_out"), x("x_init", 0).alias("final_in"), x("x_init", 1).alias("final_out"), F.coalesce("provenance.confidence", F.lit(0.5)).alias("confidence"))
    predictions = claims.select("claim_id", F.posexplode("predictions").alias("pred_seq", "p")).select("claim_id", "pred_seq", "p.observable", "p.value", "p.scale", "p.evidence_ids", "p.regime_tag")
    observed = evidence.select(
        "evidence_id", "paper_id", "label", F.col("__seq").alias("ev_seq"), F.col("context.system").alias("system"), F.col("context.framework").alias("framework"), F.col("context.regime").alias("regime"),
        F.coalesce("provenance.confidence", F.lit(0.5)).alias("confidence"))
    dimensions = evidence.select("evidence_id", F.posexplode("core.dimensions").alias("dim_seq", "d")).select("evidence_id", "dim_seq", "d.name", "d.value", "d.scale")
    return ClaimMap(flat, predictions, observed, dimensions, read_registry(spark, registry))


def read_papers(spark: SparkSession, run: str) -> DataFrame:
    return spark.read.schema(PAPER_JSON).option("multiLine", True).json(f"{run}/papers/*.json")


MEMBER_COLUMNS = "group_name string, title string, description string, member_seq int, evidence_id string"


def read_registry(spark: SparkSession, path: str | None) -> DataFrame:
    """group_name, title, description, member_seq, evidence_id. A group's body is an object with members, or a bare list.

    The file is JSON, over any number of lines; one without readable groups is an error.
    """
    if path is None:
        return spark.createDataFrame([], MEMBER_COLUMNS)
    groups = F.from_json(F.get_json_object("value", "$.groups"), "map<string,string>")
    known = F.coalesce(groups, F.raise_error(F.concat(F.lit("no groups can be read from "), F.input_file_name())).cast("map<string,string>"))
    raw = spark.read.text(path, wholetext=True).select(F.explode(known).alias("group_name", "body"))
    listed = F.from_json("body", "array<string>")
    bare = F.ltrim(F.col("body")).startswith("[")
    rich = F.from_json("body", "struct<title:string, description:string, members:array<string>>")
    named = raw.select("group_name", F.when(~bare, rich).alias("r"), F.when(bare, listed).alias("l"))
    members = F.coalesce("r.members", "l", F.array().cast("array<string>"))
    return named.select("group_name", F.coalesce("r.title", "group_name").alias("title"), F.coalesce("r.description", F.lit("")).alias("description"), F.posexplode(members).alias("member_seq", "evidence_id"))


def scan_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """Paths of files by suffix, whatever its case, with their stem and order; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path").where(F.lower("path").endswith(f".{suffix}"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select("path", F.replace(F.lower(stem), F.lit(" "), F.lit("_")).alias("stem"), (F.row_number().over(Window.orderBy("path")) - 1).alias("file_seq"))


def _named(stems: DataFrame, rules: DataFrame) -> DataFrame:
    """stem, paper_id: the paper that the rules give to each stem, if any."""
    patterns = rules.withColumn("needle", F.lower("pattern"))
    hit = hits(stems.select("stem").distinct(), "stem", "stem", patterns, "needle").join(patterns, "needle")
    rank = F.struct((F.col("stem") != F.col("pattern")).alias("inexact"), "priority", "paper_id")
    return hit.where("paper_id is not null").groupBy("stem").agg(F.min(rank).alias("r")).select("stem", "r.paper_id")


def extract(stems: DataFrame, seeds: ClaimMap, rules: DataFrame) -> DataFrame:
    """stem, paper_id, claim_id, confidence: the seeded claims of each document, or one bare claim for an unknown one.

    rules: pattern, paper_id, priority. An exact stem comes before a substring, then the least priority. An empty pattern
    matches nothing. All patterns are looked for in one reading of a stem.
    """
    known = _named(stems, rules).join(seeds.claims.select("paper_id", "claim_id", "confidence"), "paper_id").select("stem", "paper_id", "claim_id", "confidence")
    unknown = stems.join(known.select("stem").distinct(), "stem", "left_anti").select("stem", F.col("stem").alias("paper_id"), F.concat("stem", F.lit("_C01")).alias("claim_id"), F.lit(0.25).alias("confidence"))
    return known.unionByName(unknown)


def extract_map(files: DataFrame, seeds: ClaimMap, rules: DataFrame) -> ClaimMap:
    """The map that files tell (stem, file_seq): all seeded records of the papers that they are of, and a bare claim for each other stem.

    Papers are found as in extract(). A paper with several files comes once, with its claims, predictions and evidence; one
    without seeded claims counts as unknown. A bare claim has its stem as paper and label, no scope, no predictions, a
    confidence of 0.25, and comes after all seeded claims, by the stem's first file. Files without a stem tell nothing.
    """
    first = files.where("stem <> ''").groupBy("stem").agg(F.min("file_seq").alias("file_seq"))
    known = _named(first, rules).join(seeds.claims.select("paper_id").distinct(), "paper_id", "left_semi")
    papers = known.select("paper_id").distinct()
    told, observed = (df.join(papers, "paper_id", "left_semi") for df in (seeds.claims, seeds.evidence))
    after = seeds.claims.agg(F.coalesce(F.max("claim_seq") + 1, F.lit(0)).alias("__after"))  # one row
    bare = first.join(known, "stem", "left_anti").crossJoin(F.broadcast(after)).select(
        F.concat("stem", F.lit("_C01")).alias("claim_id"), F.col("stem").alias("paper_id"), F.col("stem").alias("label"), (F.col("__after") + F.col("file_seq")).alias("claim_seq"), F.lit("").alias("system"), F.lit("").alias("framework"),
        F.array().cast("array<string>").alias("keywords"), *[F.lit(1.0).alias(c) for c in ("init_in", "init_out", "final_in", "final_out")], F.lit(0.25).alias("confidence"))
    return ClaimMap(
        told.select(*bare.columns).unionByName(bare), seeds.predictions.join(told.select("claim_id"), "claim_id", "left_semi"), observed,
        seeds.dimensions.join(observed.select("evidence_id"), "evidence_id", "left_semi"), seeds.members)
