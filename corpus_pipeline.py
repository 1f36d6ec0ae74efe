"""A corpus from raw documents to packed sequences: language, line dedup, near-duplicate documents, mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result as Parquet into the shared folder and reads it back as the next one's docs.

Defined cases: a null or empty text, or one without a letter, has no language and goes in the first stage; a row without
a doc_id keeps its lines, can be a near duplicate and is mixed and packed like others; repeated rows of one text are near
duplicates of one another, so one stays; ties of deadlines in the mix go to the lesser weight; other columns are kept until
packing; an empty table gives no piece.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import langid, line_dedup, mixing, ngram_join, packing
from claimloom.llm.common import documents, shared_dir
from claimloom.llm.queries import WEIGHTS

#: The order of the mix, which the mix stage writes and the packing stage follows.
MIX = {"weights": WEIGHTS, "default": 1, "block": 32}


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or with an unclear language go."""
    return langid.keep_identified(docs, langid.learn(docs.where(langid.learned_from(F.col("doc_id")))))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds leave the text; a document of which nothing is left goes."""
    return line_dedup.clean(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; unlike documents of the same id stay."""
    return ngram_join.keep_classes(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix. Readers of the files need not keep it: packed() finds it again from the rows."""
    return mixing.in_mixed_order(docs, **MIX)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and the sequence that holds each; sequences follow the mix, up to groups of 4096 pieces."""
    return packing.pack_mixed(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024, group=4096, **MIX)


STAGES = [("language", identified), ("line_dedup", lines_once), ("near_duplicates", one_of_each), ("mix", mixed), ("packing", packed)]

#: Tokenizer ids and MinHash groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
