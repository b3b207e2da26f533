"""A corpus cleaned in stages; each reads what the one before kept, written as a table.

quality classifier -> near-dedup -> benchmark decontamination -> PII masking -> packing into token sequences

Documents are rows of doc_id, text and any further columns, which all stages but the last pass on, whatever their names. A null text is an empty
one (the PII stage leaves it null). Rows with a null doc_id are judged like any other and take no part in near-dedup, where they all stay; of
rows that repeat a doc_id near-dedup keeps one. An empty table gives empty results. Very long texts are read whole in every stage.
The stage tables lie in the shared folder (spark.checkpoint.dir) and are left there: the result is read from the last one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import classifier, decontamination, near_copies, packing, pii
from tidelog.llm.shared import folder

#: Training and several token-level stages have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more. It learns from the labels of the documents at hand; without any, all score 0.5 and stay."""
    machine = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.keep(docs, machine)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of documents whose 5-word shingles are similar by 0.8 or more.

    Pairs are proposed by SimHash (covering masks of radius 3), those too far apart for it by MinHash bands, and verified (see near_copies)."""
    return near_copies.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item (a window as long as the item that is similar to it by 0.8)."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data masked."""
    return pii.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; see packing.SCHEMA."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", mask_pii), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what lies between two stages is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
