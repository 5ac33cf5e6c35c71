"""The corpus pipeline: language ID, quality rules, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again for the next; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waypath.llm import pipeline as p
from waypath.llm.shared import drop, materialize

STAGES = [
    ("language_id", p.known_language),
    ("quality_rules", p.good_quality),
    ("exact_dedup", p.distinct_texts),
    ("near_dedup", p.distinct_content),
    ("packing", p.packed),
]

#: Language profiles, quality weights, near-duplicate sets and tokenizer ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return docs
