"""The training-data pipeline: quality, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next one. All but the last return the columns of documents, extra ones
included whatever their names.

Null texts count as empty ones throughout: the classifier scores them like any text, all of them are one
group of the exact dedup, they are near no other text, hold no benchmark words, and pack as an end id.
Rows that share an id are judged each for itself but in the near dedup, where they are one document:
they stay or go together. Of ties the largest id stays in the exact dedup and the least in the near
dedup. Texts of any length are worked on whole. An empty table, of documents, labels or benchmark items,
gives empty results, scores of 0.5 (below the threshold, so no document stays), or no contaminated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxmode.llm import decontamination, exact_dedup, near_dedup, packing, quality
from fluxmode.llm.common import stored, table
from fluxmode.llm.queries import TOKENIZER


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id; five-word shingles."""
    return near_dedup.dedup(docs, k=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: Scores and token ids are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
