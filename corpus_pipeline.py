"""A corpus from raw documents: STAGES in order, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from weftline.llm.common import materialize, table

STAGES = [
    ("quality classifier", quality.stage),
    ("exact dedup", exact_dedup.stage),
    ("MinHash near-dedup", near_dedup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("best-fit packing", packing.stage),
]

#: A trained classifier, signatures, tiling and packing are beyond SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
