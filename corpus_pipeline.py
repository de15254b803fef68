"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination, BPE; counts as part of cloudsift.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloudsift.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from cloudsift.llm.store import Store

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("bpe", bpe.stage),
]

#: Toxicity and near duplicates are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written, and read again by the next."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store.put(docs, name)
            if i:
                store.drop(STAGES[i - 1][0])
    return docs
