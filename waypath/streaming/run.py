"""Starting and ending streams: what is there now, flushed in batches, with counters."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from waypath.session import having, scratch


def source(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def finished(stream: DataFrame, label: str, mode: str = "append", path: str | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """All that is there now, run to its end through a checkpointed Parquet sink (whole files, each once).

    With the ``path`` of an earlier run it goes on from there. The session has the settings ``conf`` while the query starts
    (a query keeps those it started with), and its own again afterwards.
    """
    spark, path = stream.sparkSession, path or scratch(stream.sparkSession, label)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{path}/rows")
    else:
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows"))
    with having(spark, conf or {}):
        query = writer.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def closed(stream: DataFrame, made: Callable[[DataFrame], DataFrame], end: DataFrame, label: str, conf: dict[str, str] | None = None) -> DataFrame:
    """As ``finished`` for ``made(stream)``, and then once more from the same checkpoint with the rows ``end``.

    Those come after everything else and move the watermark past it, so that what still waits is given out.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession, label)
    last = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/end")
    last.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(last)
    whole = made(stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{path}/end")))
    finished(whole, label, path=path, conf=conf)
    end.write.mode("append").parquet(f"{path}/end")
    return finished(whole, label, path=path, conf=conf)


def counted(stream: DataFrame, label: str, **metrics) -> tuple[DataFrame, DataFrame]:
    """As ``finished``, and one row with ``metrics`` over all batches.

    A batch's rows and its counters are written together, counters under the batch's number: a batch
    that is run again replaces them. They are added up from what was written, however many batches there were.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession, label)
    counters = {n: c.alias(n) for n, c in metrics.items()}

    def keep(df: DataFrame, batch: int) -> None:
        df = df.persist()
        df.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        df.agg(*counters.values()).write.mode("overwrite").parquet(f"{path}/counters/batch={batch}")
        df.unpersist()

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    totals = spark.read.parquet(f"{path}/counters").agg(*(F.sum(n).alias(n) for n in metrics))
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(stream.columns), totals


def flushed(stream: DataFrame, label: str, flush: int, most: int | None = None, seconds: float | None = None) -> tuple[DataFrame, str]:
    """Files of at most ``flush`` rows until all is read (``read``), ``most`` rows are through (``records``) or
    ``seconds`` have passed (``time``); and which of them ended it.

    Limits are looked at between batches, so a batch is always whole and the checkpoint lets a later
    run go on with the next one.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession, label)
    through, why = [0], ["read"]
    began = time.monotonic()

    def keep(df: DataFrame, batch: int) -> None:
        if why[0] != "read":  # told to stop: this batch stays for the next run
            raise _Ended
        seen = Observation()
        df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("maxRecordsPerFile", flush).parquet(f"{path}/rows/batch={batch}")
        through[0] += seen.get["n"]
        if most is not None and through[0] >= most:
            why[0] = "records"
        elif seconds is not None and time.monotonic() - began >= seconds:
            why[0] = "time"

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if why[0] == "read":
            raise
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(stream.columns), why[0]


class _Ended(Exception):
    """A limit of :func:`flushed` was reached."""


def dumped(stream: DataFrame, label: str, first: int) -> DataFrame:
    """The first rows of each batch, for a look: a debugging sink."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, label)

    def keep(df: DataFrame, batch: int) -> None:
        df.limit(first).withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/rows")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def each_batch(stream: DataFrame, label: str, fn: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.foreachBatch(fn).option("checkpointLocation", f"{scratch(stream.sparkSession, label)}/checkpoint").trigger(availableNow=True).start().awaitTermination()
