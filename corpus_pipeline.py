"""The corpus pipeline: language, exact copies, near copies, benchmark leaks, tokens; each stage on what the last one kept."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskbridge.functions.durable import durable
from riskbridge.llm import bpe, decontaminate, exact_dedup, language_id, simhash
from riskbridge.llm.common import table
from riskbridge.llm.queries import vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.with_language(docs)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def _leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenize(docs, vocabulary_path(), decoded=False)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", _language), ("exact dedup", _exact), ("near dedup", _near), ("benchmark decontamination", _leaks), ("BPE", _tokens),
]

ORACLE_SQL = None  # SQL can't express language models, fingerprints or merges


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs
