"""The registered queries of the text operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import bitpack, divergence, fingerprints, langid, line_dedup, line_quality, lm_score, merkle, mixing, ngram_join, packing, substring, vector_neighbours
from claimloom.llm.common import documents
from claimloom.llm.oracle import ORACLE_SQL


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(documents(spark, sf_dir))


def op2_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.read_packed(bitpack.write_packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op3_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_report(documents(spark, sf_dir)).drop("text_key")


def op4_cuckoo_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op5_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


#: The target weights of the mix, in parts; a source that is not named has one.
WEIGHTS = {"src0": 4, "src1": 3, "src2": 3, "src3": 2, "src4": 2}


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), WEIGHTS, default=1, block=32).drop("text_key")


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir))


def op8_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_host_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(documents(spark, sf_dir))


def op10_winnowed_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir))


def op11_slot_pivot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def op12_p_stable_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neighbours.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


__all__ = ["ORACLE_SQL", "QUERIES"]
QUERIES = {f.__name__: f for f in (op1_order_minhash, op2_bit_packed_ids, op3_lsh_forest_join, op4_cuckoo_line_dedup, op5_residual_packing, op6_pfair_mix, op7_stupid_backoff, op8_word_first_language, op9_host_line_frequency, op10_winnowed_repeats, op11_slot_pivot_manifest, op12_p_stable_neighbours, op13_source_divergence)}
