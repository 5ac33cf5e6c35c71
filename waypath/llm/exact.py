"""Exact duplicates by a persistent digest index.

The index is a table bucketed and sorted by digest: one row per distinct normalised text.
A batch of documents is reduced to one row per digest, which a sort-merge anti join checks
against the index; what is new is appended. The table's side of that join is read bucket by
bucket, without a shuffle, so a batch costs its own size and not the index's.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``;
null counts as empty, and all empty texts are equal. Of equal texts in a batch the row with
the most code points stays, then the one with the smallest doc_id (a null id comes last).
A text that an earlier batch brought keeps the row it had. Copies are counted before the
shuffle, so a text with a third of all rows is one row from each task.

Everything is built-in functions. An append that is cut off leaves whole or no files of a
task; ``add`` may be run again, as rows that are there already aren't added twice.

Rows meet the index again by digest, which AQE can't split where the index is read bucket by
bucket. So the digests of at least one row in HOT are broadcast (there are no more than HOT of
them), and only the others go through the merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.shared import materialize

#: A digest is hot if it has more than one row in so many.
HOT = 4096

SPACES = (" ", "\t", "\n", "\v", "\f", "\r")


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for s in SPACES:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, lower-case hex."""
    return F.sha2(normalised(text), 256)


def _rows(docs: DataFrame, *keep: str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("text_sha256"), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("size"), *keep)


def groups(rows: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, copies) of (doc_id, text_sha256, size)."""
    best = F.struct(-F.col("size"), F.col("doc_id").isNull(), F.col("doc_id"))
    return rows.groupBy("text_sha256").agg(F.min(best).getField("doc_id").alias("keep_id"), F.count("*").alias("copies"))


class DigestIndex:
    """The index table; it is made, empty, when it isn't there.

    ``buckets`` is fixed for the table's life; a new one has as many as the session has shuffle
    partitions, or as told: an index of ten billion digests wants some 10,000 (a million, 100 MB, each).
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):
            self._append(spark.createDataFrame([], "text_sha256 string, keep_id long, copies long"))
        else:
            self.buckets = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"])

    def _append(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, "text_sha256").write.mode("append").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def new(self, found: DataFrame) -> DataFrame:
        """The rows of :func:`groups` whose digest the index lacks: a sort-merge anti join."""
        return found.join(self.table().select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def add(self, docs: DataFrame) -> None:
        """Append the texts of ``docs`` that are new."""
        self._append(self.new(groups(_rows(docs))))


def deduplicate(docs: DataFrame, index: DigestIndex, *keep: str) -> DataFrame:
    """Add ``docs`` (doc_id, text) to the index; doc_id, keep_id, group_size, kept, text_sha256 of each row, with its columns ``keep``.

    group_size is the number of rows with that text in the batch that brought it. A row is
    kept if it is the one that stays; of rows that repeat its doc_id and text all are.
    """
    rows = materialize(_rows(docs, *keep), "digests")
    counted = materialize(groups(rows), "groups")
    index._append(index.new(counted))
    limit = (rows.count() // HOT) + 1
    hot = materialize(counted.where(F.col("copies") > limit).select("text_sha256"), "hot")
    seen = index.table().select("text_sha256", "keep_id", F.col("copies").alias("group_size"))
    few = materialize(seen.join(F.broadcast(hot), "text_sha256", "left_semi"), "hot")
    often = rows.join(F.broadcast(few), "text_sha256")
    others = rows.join(F.broadcast(hot), "text_sha256", "left_anti").join(seen.hint("merge"), "text_sha256")
    return often.unionByName(others).select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256", *keep)


SQL = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS size
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
