"""A training corpus from raw documents: rules, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm.decontaminate import decontaminate_stage
from kerbline.llm.near_dedup import dedup_stage
from kerbline.llm.quality_rules import quality_stage
from kerbline.llm.secret_scan import secret_stage
from kerbline.llm.sentencepiece_codec import encode_stage
from kerbline.plans.lineage import scratch

STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("secret scan", secret_stage),
    ("sentencepiece encoding", encode_stage),
]

#: SentencePiece encoding is beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the session's shared checkpoint folder."""
    folder = scratch(spark, f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
