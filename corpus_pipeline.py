"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) with the columns of documents and works on all that the stage before kept;
all but the last return the columns of documents. ``run`` writes each stage's rows as Parquet in the folder that
spark.checkpoint.dir names and reads them back, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import bpe, line_dedup, mixing, quality_rules, simhash
from tabulon.llm.common import documents
from tabulon.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated line runs."""
    return line_dedup.cleaned(docs, count=None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded of every document of the mix."""
    return bpe.encode_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_dedup), ("mixing", mix), ("bpe", encode)]

#: SQL can express neither the perplexity bands nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
