"""Reading files: CSV strict, lenient and raw, archives, JSON arrays, years of Parquet, block lists."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that stands for null. Fixed values of the sources.
NULLS = ("", "NA", "NULL", "null")


def _nulled(df: DataFrame, schema: T.StructType) -> DataFrame:
    """All-text columns as those of ``schema``; null marks are null, other text that doesn't fit raises."""
    return df.select(*(F.when(~F.col(f"`{f.name}`").isin(*NULLS), F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema))


def _text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def csv_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every row and value must fit ``schema``; columns without a name in it are not read."""
    named = T.StructType([f for f in schema if f.name.strip()])
    raw = spark.read.schema(_text(schema)).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return _nulled(raw.select(*(f"`{f.name}`" for f in named)), named)


def csv_lenient(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """Those of ``wanted`` that the file has, as text; rows that can't be read are dropped."""
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return raw.select(*(c for c in wanted if c in raw.columns))


def csv_filtered(spark: SparkSession, path: str, schema: T.StructType, condition: Column, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """A lazy scan with a condition; with ``recursive`` of all folders below, with ``glob`` of matching names."""
    read = spark.read.schema(schema).option("header", True)
    if recursive:
        read = read.option("recursiveFileLookup", True)
    if glob:
        read = read.option("pathGlobFilter", glob)
    return read.csv(path).where(condition)


def csv_text(spark: SparkSession, text: str, schema: T.StructType) -> DataFrame:
    """CSV that was fetched as one text; small by nature."""
    return spark.createDataFrame(pd.read_csv(io.StringIO(text), dtype=str, keep_default_na=False), _text(schema)).transform(_nulled, schema)


def padded_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Padded all-text records in Latin-1 without quoting; short rows get nulls, surplus values go, pads are stripped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    read = spark.read.schema(schema).option("header", True).option("quote", "").option("encoding", "ISO-8859-1")
    rows = read.option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.select(*(F.trim(c).alias(c) for c in columns))


MEMBERS = "archive string, member string, content binary"


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            blob = io.BytesIO(content)
            if zipfile.is_zipfile(blob):
                with zipfile.ZipFile(blob) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pd.DataFrame([(path, name, z.read(name))], columns=["archive", "member", "content"])
            else:
                blob.seek(0)
                with tarfile.open(fileobj=blob, mode="r:*") as t:
                    for m in t:
                        if m.isfile():
                            yield pd.DataFrame([(path, m.name, t.extractfile(m).read())], columns=["archive", "member", "content"])


def members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, content) of all ZIP and TAR archives at ``path``, an archive to a task at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(_unpack, MEMBERS).where(F.col("member").endswith(suffix))


def member_lines(rows: DataFrame, columns: list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Comma-separated lines of archive members as text columns: the first line is a header and left out,
    rows are padded or cut to ``columns``."""
    lines = rows.select("member", F.posexplode(F.split(F.decode("content", encoding), "\r?\n")).alias("n", "line"))
    parts = F.split("line", ",")
    return lines.where((F.col("n") > 0) & (F.trim("line") != "")).select("member", *(F.trim(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(columns)))


def partitions(df: DataFrame, column: str) -> list[int]:
    """The whole numbers that name partitions of a table by ``column``, from the paths of its files: no data is read."""
    found = {part.partition("=")[2] for f in df.inputFiles() for part in f.split("/") if part.startswith(f"{column}=")}
    return sorted(int(x) for x in found if x.lstrip("-").isdigit())


def years(spark: SparkSession, path: str, wanted: list[int], snake: bool = True) -> DataFrame:
    """Years of one table partitioned by ``year``: other years aren't read. A missing year raises."""
    from waypath.functions.text import snake_columns

    df = spark.read.parquet(path).where(F.col("year").isin(*wanted))
    if missing := sorted(set(wanted) - set(partitions(spark.read.parquet(path), "year"))):
        raise FileNotFoundError(f"no data for {missing}")
    return snake_columns(df) if snake else df


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON arrays, a file to an array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def dataset(spark: SparkSession, name: str, places: dict[str, str], cache: str, refresh: bool = False) -> DataFrame:
    """The Parquet dataset that ``places`` has under ``name``, or under ``*`` with ``{name}`` in its address.

    The first load copies it below ``cache`` (a shared folder); later ones read the copy. A copy that was
    cut off has no mark of success and is made again.
    """
    address = places.get(name) or places.get("*", "").replace("{name}", name)
    if not address:
        raise KeyError(f"no dataset {name}; known: {sorted(places)}")
    copy = f"{cache}/{name}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{copy}/_SUCCESS")
    if refresh or not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        spark.read.parquet(address).write.mode("overwrite").parquet(copy)
    return spark.read.parquet(copy)


def block_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct upper-case stripped values of a CSV's column; a missing file gives an empty list."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{column} string")
    return spark.read.option("header", True).csv(path).select(F.upper(F.trim(column)).alias(column)).where(F.col(column) != "").distinct()


def avro(spark: SparkSession, path: str) -> DataFrame:
    """Avro files; needs Spark's avro module (``--packages org.apache.spark:spark-avro``), which isn't part of the base distribution."""
    return spark.read.format("avro").load(path)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made and written first if it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
