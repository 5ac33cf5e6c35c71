"""Sources (S) and sinks (K): tables written in a format and read back by the operator."""

from __future__ import annotations

import io
import tarfile
import zipfile
from datetime import date, timedelta

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypath.plans.legs import Registry
from waypath.session import scratch, table
from waypath.sources import fetch, readers, writers
from waypath.sources.snapshots import Snapshots

query = Registry()
QUERIES, SQL = query.queries, query.sql

SUPPLIER = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("s_nationkey", T.IntegerType()), T.StructField("s_acctbal", T.DoubleType())])
_ALL = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
_NULLED = "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END AS s_nationkey, s_acctbal FROM supplier"


def _written(spark, d, name):
    """supplier as CSV; every third nation is written as NA."""
    path = scratch(spark, name)
    n = F.when(F.col("s_suppkey") % 3 == 0, "NA").otherwise(F.col("s_nationkey").cast("string"))
    writers.csv(table(spark, d, "supplier").withColumn("s_nationkey", n).select(*SUPPLIER.names), path)
    return path


@query(_NULLED)
def S01_csv_strict(spark, d):
    return readers.csv_strict(spark, _written(spark, d, "s01"), SUPPLIER)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def S02_csv_lenient(spark, d):
    return readers.csv_lenient(spark, _written(spark, d, "s02"), ["s_suppkey", "not_there", "s_name"])


def _ages(spark, d, name):
    path = scratch(spark, name)
    writers.csv(table(spark, d, "supplier").select(*SUPPLIER.names), f"{path}/a/b")
    return path


@query(_ALL + " WHERE s_acctbal > 1000")
def S03_csv_lazy_filter(spark, d):
    return readers.csv_filtered(spark, _ages(spark, d, "s03") + "/a/b", SUPPLIER, F.col("s_acctbal") > 1000)


@query(_ALL)
def S04_recursive_glob(spark, d):
    return readers.csv_filtered(spark, _ages(spark, d, "s04"), SUPPLIER, F.lit(True), recursive=True, glob="*.csv")


@query("SELECT n_nationkey, n_name FROM nation")
def S05_csv_text(spark, d):
    rows = table(spark, d, "nation").collect()  # a dimension of a few rows, as if fetched
    text = "n_nationkey,n_name\n" + "\n".join(f"{r.n_nationkey},{r.n_name}" for r in rows)
    return readers.csv_text(spark, text, T.StructType.fromDDL("n_nationkey int, n_name string"))


def _archive(spark, path, name, lines, kind="zip"):
    """An archive with one member, put into the shared folder."""
    data, blob = "\r\n".join(lines).encode("latin-1"), io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(blob, "w") as z:
            z.writestr(name, data)
    else:
        with tarfile.open(fileobj=blob, mode="w:gz") as t:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(blob.getvalue()))
    out.close()


def _nation_lines(spark, d, pad=""):
    return ["key,name", *(f"{pad}{r.n_nationkey}{pad},{r.n_name}{pad}" for r in table(spark, d, "nation").collect())]


_NATION = "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation"


@query(_NATION)
def S06_zip_member(spark, d):
    path = scratch(spark, "s06")
    _archive(spark, f"{path}/n.zip", "nations.csv", _nation_lines(spark, d))
    return readers.member_lines(readers.members(spark, path, ".csv"), ["key", "name"]).select("key", "name")


@query(_NATION)
def S07_padded_latin1(spark, d):
    path = scratch(spark, "s07")
    writers.put_text(spark, f"{path}/n.txt", "\n".join(_nation_lines(spark, d, pad="  ")))
    return readers.padded_text(spark, path, ["key", "name"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'x' END AS extra FROM nation")
def S08_ragged_rows(spark, d):
    path = scratch(spark, "s08")
    lines = ["key,name,extra", *(f"{r.n_nationkey},{r.n_name}" + (",x,surplus" if r.n_nationkey % 2 == 0 else "") for r in table(spark, d, "nation").collect())]
    _archive(spark, f"{path}/n.zip", "n.txt", lines)
    return readers.member_lines(readers.members(spark, path), ["key", "name", "extra"]).drop("member")


@query("SELECT count(*) AS n, count(DISTINCT l_returnflag) AS flags FROM lineitem")
def S09_parquet_scan(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("flags"))


@query("SELECT o_orderkey AS order_key, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) IN (1996, 1997)")
def S10_years(spark, d):
    path = scratch(spark, "s10")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("OrderKey"), F.year("o_orderdate").alias("year"))
    writers.parquet(o, path, ["year"])
    return readers.years(spark, path, [1996, 1997])


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'A'")
def S11_projection_predicate(spark, d):
    return table(spark, d, "lineitem").where("l_quantity >= 49 and l_returnflag = 'A'").select("l_orderkey", "l_quantity")


@query("SELECT s_suppkey, s_name FROM supplier")
def S13_json_array(spark, d):
    path = scratch(spark, "s13")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name")
    # a document for each range of keys, so that no task holds more than a range
    ranges = rows.groupBy(F.floor(F.col("s_suppkey") / 1000)).agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("value")).select("value")
    ranges.write.option("maxRecordsPerFile", 1).text(path)
    return readers.json_array(spark, path, T.StructType.fromDDL("s_suppkey long, s_name string"))


@query("SELECT x AS snapshot_time, 'v' || i AS id, CAST(i AS DOUBLE) AS longitude, hour(x) + i / 10 AS latitude FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 03:00:00', INTERVAL 30 MINUTE)) AS x), range(3) t(i)")
def S14_snapshots(spark, d):
    spark.dataSource.register(Snapshots)
    s = spark.read.format("snapshots").options(start="2024-01-01T00:00:00", end="2024-01-01T03:00:00", every="1800").load()
    return s.select(F.col("snapshot_time").cast("timestamp_ntz").alias("snapshot_time"), "id", "longitude", "latitude")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 3 THEN 'ok ' || s_suppkey END AS result, CAST(least(s_suppkey % 5 + 1, 3) AS INTEGER) AS attempts FROM supplier")
def S15_retry(spark, d):
    """A call for each supplier, to a service that fails as often as the key says; three attempts each."""
    return fetch.fetched(table(spark, d, "supplier").select("s_suppkey"), _Unsteady(), attempts=3, base=0.0)


class _Unsteady:
    """Fails s_suppkey % 5 times, then answers."""

    def __init__(self) -> None:
        self.asked: dict[int, int] = {}

    def __call__(self, row: dict) -> str:
        key = row["s_suppkey"]
        self.asked[key] = self.asked.get(key, 0) + 1
        if self.asked[key] <= key % 5:
            raise OSError("not yet")
        return f"ok {key}"


def _month_middle_is_missing(keys: list[int], a: date, b: date) -> list[tuple]:
    """A service that fails for every third key if the 15th of a month is asked for."""
    days = [a + timedelta(days=i) for i in range((b - a).days + 1)]
    if any(k % 3 == 0 for k in keys) and any(x.day == 15 for x in days):
        raise OSError("too much")
    return [(k, x) for k in keys for x in days]


@query("""WITH r AS (SELECT o_custkey AS key, CAST(min(o_orderdate) AS DATE) AS a, CAST(min(o_orderdate) AS DATE) + CAST(20 + o_custkey % 20 AS INTEGER) AS b FROM orders GROUP BY o_custkey),
x AS (SELECT key, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM r)
SELECT key, CAST(count(*) FILTER (NOT (key % 3 = 0 AND day(day) = 15)) AS INTEGER) AS got, CAST(count(*) FILTER (key % 3 = 0 AND day(day) = 15) AS INTEGER) AS failed FROM x GROUP BY 1""")
def S16_shrinking_windows(spark, d):
    """Each customer's first weeks, asked for in windows that shrink where they fail."""
    first = F.min("o_orderdate").cast("date")
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(first.alias("first"))
    return fetch.spans(r.withColumn("last", F.date_add("first", (F.col("key") % 20 + 20).cast("int"))), _month_middle_is_missing)


@query("""WITH r AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1),
x AS (SELECT *, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS m FROM r)
SELECT o_custkey, CAST(greatest(m, a) AS DATE) AS "from", CAST(least(last_day(m), b) AS DATE) AS "to", strftime(m, '%Y-%m') AS label FROM x""")
def S17_month_windows(spark, d):
    """The months between each customer's first and last order."""
    from waypath.functions.clock import month_ranges

    r = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return r.select("o_custkey", F.inline(month_ranges(F.col("a"), F.col("b"))))


@query("SELECT count(*) AS n FROM events")
def S18_queue_source(spark, d):
    """A stream over what lies in a folder; with Kafka the same frame comes from ``format('kafka')``."""
    from waypath.streaming import run

    return run.finished(run.source(spark, d, "events").select("event_id"), "s18").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def S19_dataset_by_name(spark, d):
    """By name from where the name says it lies; the second load reads the copy that the first one made."""
    cache = scratch(spark, "s19")
    load = lambda: readers.dataset(spark, "nation", {"nation": f"{d}/nation.parquet"}, cache)
    load()
    return load().select("n_nationkey", "n_name")


@query("SELECT DISTINCT upper(c_mktsegment) AS name FROM customer")
def S20_block_list(spark, d):
    path = scratch(spark, "s20")
    writers.csv(table(spark, d, "customer").select(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" ")).alias("name")), path)
    return readers.block_list(spark, path, "name").unionByName(readers.block_list(spark, path + "-missing", "name"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def S21_cached_or_computed(spark, d):
    path = scratch(spark, "s21")
    make = lambda: table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    readers.cached(spark, path, make)
    return readers.cached(spark, path, lambda: 1 / 0)


@query(_NATION)
def S22_tar_member(spark, d):
    path = scratch(spark, "s22")
    _archive(spark, f"{path}/n.tar.gz", "deep/nations.csv", _nation_lines(spark, d), kind="tar")
    return readers.member_lines(readers.members(spark, path, ".csv"), ["key", "name"]).select("key", "name")


# sinks


@query("SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders")
def K01_partitioned_parquet(spark, d):
    path = scratch(spark, "k01")
    writers.parquet(table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")), path, ["year", "month"])
    return spark.read.parquet(path)


@query(_ALL)
def K02_snappy(spark, d):
    path = scratch(spark, "k02")
    writers.parquet(table(spark, d, "supplier"), path, compression="snappy")
    return spark.read.parquet(path)


@query(_ALL)
def K03_csv(spark, d):
    path = scratch(spark, "k03")
    writers.csv(table(spark, d, "supplier"), path)
    return spark.read.schema(SUPPLIER).option("header", True).csv(path)


@query("SELECT n_name AS name, n_nationkey AS key FROM nation")
def K04_json_mapping(spark, d):
    j = writers.mapping(table(spark, d, "nation"), "n_name", "n_nationkey")
    return j.select(F.explode(F.from_json("json", "map<string,int>")).alias("name", "key"))


@query("SELECT 'x' AS run, count(*) AS n FROM orders")
def K05_results_json(spark, d):
    path = scratch(spark, "k05")
    writers.results(spark, f"{path}/r.json", {"run": "x", "n": table(spark, d, "orders").count()})
    return spark.read.schema("run string, n long").option("multiLine", True).json(path)


@query("SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def K06_markdown(spark, d):
    rows = [r.asDict() for r in table(spark, d, "region").collect()]
    return spark.createDataFrame([(x,) for x in writers.markdown(rows, ["r_regionkey", "r_name"]).split("\n")[2:]], "line string")


@query("SELECT event_id, value FROM events")
def K07_streamed_parquet(spark, d):
    from waypath.streaming import run

    return run.finished(run.source(spark, d, "events").select("event_id", "value"), "k07")


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN '{"event_id":' || event_id || ',"kind":"' || event_type || '"}' ELSE '{"event_id":' || event_id || '}' END AS json FROM events""")
def K08_dry_run(spark, d):
    """Rows as JSON without their empty fields."""
    return writers.json_rows(table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind")))


@query("SELECT s_suppkey, s_name FROM supplier")
def K09_whitelist(spark, d):
    path = scratch(spark, "k09")
    writers.whitelisted(table(spark, d, "supplier"), path, ["s_suppkey", "s_name", "not_there"])
    return spark.read.parquet(path)


def _model(spark, d):
    x = VectorAssembler(inputCols=["s_acctbal"], outputCol="v").transform(table(spark, d, "supplier"))
    return StandardScaler(inputCol="v", outputCol="z").fit(x), x


@query("SELECT count(*) AS n FROM supplier")
def K10_model(spark, d):
    from pyspark.ml.feature import StandardScalerModel

    path = scratch(spark, "k10")
    model, x = _model(spark, d)
    model.write().overwrite().save(path)
    return StandardScalerModel.load(path).transform(x).agg(F.count("z").alias("n"))


@query("SELECT s_suppkey, CAST(s_acctbal > 0 AS INTEGER) AS actual, CAST(s_acctbal > 100 AS INTEGER) AS predicted FROM supplier")
def K11_predictions(spark, d):
    path = scratch(spark, "k11")
    model, x = _model(spark, d)
    p = x.select("s_suppkey", (F.col("s_acctbal") > 0).cast("int").alias("actual"), (F.col("s_acctbal") > 100).cast("int").alias("predicted"))
    writers.model_run(spark, path, model, p, {"n": x.count()})
    return spark.read.parquet(f"{path}/predictions")


@query("SELECT o_orderkey, year(o_orderdate) AS year FROM orders")
def K12_dynamic_overwrite(spark, d):
    """A year written again replaces that year alone."""
    path = scratch(spark, "k12")
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    writers.parquet(o, path, ["year"])
    writers.parquet(o.where("year = 1996"), path, ["year"])
    return spark.read.parquet(path)
