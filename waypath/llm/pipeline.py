"""Stages of the corpus pipeline: each applies one operator and acts on what it decides.

A decision belongs to a row, not to its doc_id: rows that share an id are judged each, a row
with a null doc_id is judged as any other by its text (near_dedup alone keeps it, as it links
with nothing). An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm import exact, language, minhash, packing, quality
from waypath.llm.shared import drop, materialize, with_row, without

#: Below this share of the largest rank distance a text looks like none of the languages.
LEAST_LANGUAGE = 0.1


def _carried(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with all its columns once more under other names, to go along with what is decided."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    return docs.select(*(c for c in ("doc_id", "text", "lang") if c in docs.columns), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True))), names


def _back(docs: DataFrame, found: DataFrame) -> DataFrame:
    return found.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without letters or like none of them go."""
    rows, names = _carried(docs)
    found = language.languages(rows, *names)
    return _back(docs, found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    rows, names = _carried(docs)
    return _back(docs, quality.judge(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), *names).where("kept"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of rows that repeat its doc_id and text the first in the table."""
    docs, key = with_row(docs)
    index = exact.DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    judged = materialize(exact.deduplicate(docs, index, *key).select("text_sha256", "kept", *key), "judged")
    index.drop()
    first = judged.where("kept").groupBy("text_sha256").agg(F.min(F.struct(*key)).alias("first")).select("first.*")
    rejected = materialize(judged.select(*key).join(first, key, "left_anti"), "rejected")
    drop(judged)
    return without(docs, key, rejected).drop(*key)


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; of rows that repeat it the first in the table."""
    docs, key = with_row(docs)
    near = minhash.NearDuplicates(docs, *key)
    linked = materialize(near.result().where("part is not null").select("part", "kept", *key), "linked")
    near.clear()
    first = linked.where("kept").groupBy("part").agg(F.min(F.struct(*key)).alias("first")).select("first.*")
    rejected = materialize(linked.select(*key).join(first, key, "left_anti"), "rejected")
    drop(linked)
    return without(docs, key, rejected).drop(*key)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
