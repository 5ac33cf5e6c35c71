"""Session defaults: UTC, ANSI on, adaptive execution; size settings stay with the cluster."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),  # rows to Python may be texts of any length
}


def builder(app: str = "waypath", **conf: str) -> SparkSession.Builder:
    """A session builder with the defaults above; further settings win over them."""
    b = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "6g", **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    own = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder("waypath-local", **(own | conf)).master(f"local[{cpus}]").getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the folder may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For tables that learners read: they hold a task's rows unpacked, many times their size in a file, so row groups and splits
#: are small. With a split's size fixed in bytes, a task holds as much of a large table as of a small one.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20)}
SMALL_SPLITS = {"spark.sql.files.maxPartitionBytes": str(16 << 20)}


def cut(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The rows without their lineage: written to the shared folder (with the writer's ``options``) and read again."""
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uncut(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote and no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/waypath/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir`` (this machine's where that is unset);
    it is deleted when the driver ends."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and own.isDefined():
        base = own.get()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="waypath-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/waypath/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


@contextmanager
def having(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the executors' Python (once for an application), so that none needs it installed."""
    import tempfile
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="waypath-")) / "waypath.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        context.addPyFile(str(path))
        _SHIPPED.add(context.applicationId)
    return spark
