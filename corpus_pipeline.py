"""The corpus pipeline: quality rules, near-duplicate removal, secret masking, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesmill.llm import bpe, jaccard, mixing, quality, secrets
from seriesmill.llm.common import settle
from seriesmill.session import share_code, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    share_code(spark)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group stays, the one with the least id."""
    share_code(spark)
    return jaccard.keep_one(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets become asterisks; lengths and all documents stay."""
    share_code(spark)
    return secrets.mask(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that each source comes near its target."""
    share_code(spark)
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each remaining row, with the digests of ids and of what they decode to. The executors' JVMs
    still hold what the stages before needed, so its workers remember less than the operator does alone, and nothing from task to task."""
    share_code(spark)
    return bpe.encode_documents(docs, keep_ids=True, states=40_000, most=20 << 20, forgetful=True)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secret_masking), ("mixing", source_mixing), ("tokens", tokens)]

#: The divergence verdict, the draws of the mix and the merges can't all be put in SQL; tests/llm holds each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
