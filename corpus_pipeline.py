"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

quality      documents that the classifier scores under 0.5 go (learned from the whole labels table)
exact        of documents with equal text (white space apart) the longest stays
near         of each class of near duplicates one document stays
benchmark    documents that hold a window of a benchmark item go
tokens       byte-level BPE ids of what is left: doc_id, n_tokens, ids, and digests of the ids and the decoded bytes

All stages but the last return the columns of documents.  SQL cannot express the classifier, the alignment or the
merges, so ORACLE_SQL is None; tests hold the stages against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkwarden.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from sparkwarden.llm.common import save, table
from sparkwarden.llm.queries import VOCABULARIES


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, f"{VOCABULARIES}/byte_bpe_multi_50k.tiktoken")


STAGES = [
    ("quality", keep_quality),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("benchmark", drop_contaminated),
    ("tokens", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
