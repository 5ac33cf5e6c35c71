"""Where corpus operators keep intermediate tables, and how they take text apart.

Intermediate results are Parquet tables below ``spark.checkpoint.dir``, which driver and
executors share. Only where that setting is absent (tests, notebooks) a folder of this
machine is used, and set for the session.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many keys are broadcast as they are, some 100 bytes each on the driver; of more only bits are: so many for a key,
#: and 4 MB at most. Beyond, more rows pass that needn't.
BROADCAST_KEYS, KEY_BITS, MOST_BITS = 50_000, 16, 1 << 25
#: Text that one step of a Python operator handles at a time, in bytes; a longer text is a step of its own.
STEP_BYTES = 4 << 20
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; else the context's own, else a new one, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    made = "file://" + tempfile.mkdtemp(prefix="waypath-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no one has used; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/waypath/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and return the table written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote and no later step reads."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/waypath/" in f:
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage. Until then ended queries keep their broadcasts, and their shuffles on the
    executors' disks, and the driver's heap grows; a long operator calls this between its phases."""
    gc.collect()  # frames that Python holds
    spark._jvm.System.gc()


def with_row(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns that together name each row, also rows that are equal, and these columns' names.

    They are the file (hashed) and the place in it, which don't change when a task is repeated;
    a table that isn't read straight from Parquet is written first.
    """
    names = ["_file", "_row"]
    while set(names) & set(docs.columns):
        names = ["_" + n for n in names]

    def named(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(at.getField("file_path")).alias(names[0]), at.getField("row_index").alias(names[1]))

    try:
        out = named(docs)
        out.schema  # noqa: B018  unresolved columns show here
    except AnalysisException:
        out = named(materialize(docs, "docs"))
    return out, names


def steps(batch: pa.RecordBatch, text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, so that what a step builds stays bounded."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def sieve(rows: DataFrame, names: list[str], keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The rows that may have one of ``n`` keys (all that do, and some 6 % of the others), and those that surely don't.

    ``keys`` has the columns ``names``. Neither it nor the rows go through the driver or a shuffle; a bitmap of hashes does.
    """
    bits, page = max(min(KEY_BITS * n, MOST_BITS), 1), 1 << 15  # a page is what bitmap_construct_agg fills
    at = F.pmod(F.xxhash64(*names), F.lit(bits))
    pages = keys.select(at.alias("_at")).select(F.expr(f"_at div {page}").alias("_page"), F.expr(f"_at % {page}").alias("_at")).repartition("_page")
    pages = F.broadcast(materialize(pages.groupBy("_page").agg(F.bitmap_construct_agg("_at").alias("_bits")), "sieve"))
    bit = F.pmod(at, F.lit(page))
    octet = F.conv(F.hex(F.substring(pages["_bits"], F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = (F.floor(at / page) == pages["_page"]) & (F.floor(octet / F.pow(F.lit(2), bit % 8)) % 2 == 1)
    return rows.join(pages, there, "left_semi"), rows.join(pages, there, "left_anti")


def without(rows: DataFrame, names: list[str], gone: DataFrame) -> DataFrame:
    """The rows whose keys (columns ``names``) aren't in ``gone``, a written table; only rows that may be are shuffled."""
    n = gone.count()
    if n <= BROADCAST_KEYS:
        return rows.join(F.broadcast(gone), names, "left_anti")
    maybe, others = sieve(rows, names, gone, n)
    return others.unionByName(maybe.join(gone, names, "left_anti").select(*rows.columns))


#: What a worker calls at the end of a task to drop what it remembers from batch to batch.
FORGET: list[Callable[[], None]] = []


def end_task() -> None:
    """Give memory back: a Python worker lives on for other tasks, and shares its executor's memory."""
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can do so
        ctypes.CDLL(None).malloc_trim(0)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let batches to Python hold no more than BATCH_BYTES, where the session allows more: rows may be
    texts of any length, and both sides of the pipe keep a whole batch."""
    now = spark.conf.get(BATCH, None)
    size = int(now) if now and now.lstrip("-").isdigit() else -1
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def by_steps(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most: int = STEP_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``fn`` over the rows, a bounded slice of an Arrow batch at a time; columns ``keep`` of the rows go along."""

    small_batches(df.sparkSession)
    if keep:
        schema = T.StructType([*T._parse_datatype_string(schema).fields, *(df.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text, most):
                out = fn(part)
                yield pa.RecordBatch.from_arrays([*out.columns, *(part.column(c) for c in keep)], names=[*out.schema.names, *keep]) if keep else out
        end_task()

    return df.mapInArrow(run, schema)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a column of texts, as codes into their distinct values.

    codes: one per word, in order; starts: where each text's words begin (one more than texts);
    distinct: the words as bytes. A null text has no word.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        if pa.types.is_string(texts.type) is False and pa.types.is_large_string(texts.type) is False:
            texts = texts.cast(pa.string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat = lists.flatten()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        seen = np.concatenate(([0], np.cumsum(full)))
        self.starts = seen[bounds]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.distinct: list[bytes] = coded.dictionary.cast(pa.binary()).to_pylist()

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owners(self) -> np.ndarray:
        """The text (0, 1, ...) of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """64 bits of each distinct word."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct), np.uint64, len(self.distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def runs(h: np.ndarray, starts: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n neighbouring values inside each text, and where each text's runs begin."""
    with np.errstate(over="ignore"):
        total = len(h)
        lengths = np.maximum(np.diff(starts) - (n - 1), 0)
        out = np.concatenate(([0], np.cumsum(lengths)))
        if total < n:
            return np.zeros(0, np.uint64), out
        mult = seeds(n, seed)
        acc = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            acc += h[k : total - n + 1 + k] * mult[k]
        keep = np.repeat(starts[:-1] - out[:-1], lengths) + np.arange(out[-1])
        return mixed(acc[keep]), out
