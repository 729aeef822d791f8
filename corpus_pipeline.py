"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return docs' columns.
Stages are kept apart by Parquet: run() and the check tool write each result and read it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import mixing, near_dedup, packing, secrets, toxicity
from strandlake.llm.catalog import table, vocabulary
from strandlake.llm.common import stored

#: Documents from this score on are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that a model fitted to the labelled ones rejects."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.kept_documents(spark, docs, model, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: that of the smallest doc_id. Each row is judged by its own text."""
    return near_dedup.distinct_documents(spark, docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts; every document stays."""
    return secrets.redacted_documents(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put all documents in the order of the mix: sources by the square root of their size."""
    return mixing.mixed_documents(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of 4096."""
    return packing.best_fit_packing(spark, docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix), ("packing", pack)]

#: A trained model and trees aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
    return docs
