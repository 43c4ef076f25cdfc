"""The corpus pipeline: judged, near-deduplicated, decontaminated, mixed and tokenised documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelmill.llm.common import read, stored
from voxelmill.llm.decontaminate import clean_documents
from voxelmill.llm.mixing import mixed_documents
from voxelmill.llm.near_dedup import distinct_documents
from voxelmill.llm.quality import accepted_documents
from voxelmill.llm.token_files import pipeline_files

#: (name, function of the session, the documents so far and the folder of the tables).
STAGES = [
    ("quality classifier", accepted_documents),
    ("MinHash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("mixing sources", mixed_documents),
    ("token files", pipeline_files),
]
#: Kneser-Ney perplexities and pivotal rounding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
