"""What stands at a rank: exact quantiles and exact samples without sorting.

Values are 64-bit integers. A pass counts them by the 16 highest bits that are still open, at most 65,536 counts a
group and rank, summed in the tasks before the shuffle; the count that holds the rank is the next pass's range.
A range narrows to the values that it really has, so few passes are needed and never more than four. All
columns or strata and all their ranks are narrowed together.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from decimal import Decimal
from math import ceil, floor, isinf

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waypath.session import cut, uncut

#: Open ranks that come to the driver between passes; more are written to the shared folder.
FEW = 10_000
BITS = 16


def ordered(df: DataFrame, value: str, key: str) -> DataFrame:
    """``df`` with a column ``key``: the double ``value`` as an integer in the same order, the bits of its size with its
    sign. Both zeros are 0; infinities are the outermost; no value and not-a-number give null."""
    x, size = F.col(value).cast("double"), F.abs(F.col(value).cast("double"))
    finite = size.between(F.lit(5e-324), F.lit(1.7976931348623157e308))
    df = df.withColumn("_e", F.when(finite, F.greatest(F.floor(F.log2(size)), F.lit(-1022)).cast("int")))
    df = df.withColumn("_m", size * F.pow(F.lit(2.0), -F.col("_e")))  # from 1 to 2, but where a logarithm was rounded
    step = F.when(F.col("_m") >= 2, 1).when((F.col("_m") < 1) & (F.col("_e") > -1022), -1).otherwise(0)
    df = df.withColumn("_s", step)
    bits = (F.col("_e") + F.col("_s") + 1022).cast("long") * F.lit(1 << 52) + (F.col("_m") * F.pow(F.lit(2.0), F.lit(52.0) - F.col("_s"))).cast("long")
    bits = F.when(finite, bits).when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 << 52))
    return df.withColumn(key, F.when(F.isnan(x), None).when(x < 0, -bits).otherwise(bits)).drop("_e", "_m", "_s")


def value_of(key: int) -> float:
    """The double that :func:`ordered` made ``key`` of."""
    size = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -size if key < 0 else size


RANKS = "group", "rank", "total", "key", "before"


def at_ranks(values: DataFrame, ranks: Callable[[Column], Column]) -> DataFrame:
    """RANKS of ``values`` (group, key long): the key at each of ``ranks`` of a group, counted from 0.

    ``ranks`` gives an array of ranks for the number of a group's rows (``total``); ``before`` is how many
    keys are smaller. A group may be null and may hold any share of the rows. Rows with a null key don't count.
    """
    spark, values = values.sparkSession, values.where("key is not null")
    first = values.groupBy("group", F.shiftright("key", 64 - BITS).alias("cell")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    every = W.partitionBy("group")
    earlier = every.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = first.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "total": F.sum("n").over(every)}).withColumn("ranks", ranks(F.col("total")))
    done, held = None, []
    while True:
        here = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
        found = cells.select("group", "total", "lo", "hi", "before", here.alias("ranks")).where(F.size("ranks") > 0)
        rows = found.limit(FEW + 1).collect()
        few = len(rows) <= FEW
        found = spark.createDataFrame(rows, found.schema) if few else cut(found, "ranks")
        if not few:
            held.append(found)
        part = found.where("lo = hi").select("group", F.explode("ranks").alias("rank"), "total", F.col("lo").alias("key"), "before")
        done = part if done is None else done.unionByName(part)
        open_ = found.where("lo < hi")
        if all(r.lo == r.hi for r in rows) if few else open_.isEmpty():
            break
        # rows meet three numbers of a range and are counted by hash; what else it has is joined to the counts
        range_ = open_.select(F.col("group").alias("_g"), "lo", "hi", F.expr(f"greatest(0, length(bin(hi - lo)) - {BITS})").alias("_s"))
        range_ = F.broadcast(range_) if few else range_
        inside = values.join(range_, values["group"].eqNullSafe(range_["_g"]) & F.col("key").between(F.col("lo"), F.col("hi")))
        again = inside.groupBy("group", F.col("lo").alias("from"), F.expr("shiftright(key - lo, _s)").alias("cell")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        rest = open_.select(F.col("group").alias("_g"), F.col("lo").alias("_lo"), "total", F.col("before").alias("below"), "ranks")
        rest = F.broadcast(rest) if few else rest
        again = again.join(rest, again["group"].eqNullSafe(rest["_g"]) & (again["from"] == rest["_lo"])).drop("_g", "_lo")
        earlier = W.partitionBy("group", "from").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
        cells = again.withColumn("before", F.col("below") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    done = spark.createDataFrame(done.collect(), done.schema) if not held else cut(done, "at-ranks")
    for table in held:
        uncut(table)
    return done


def quantiles(df: DataFrame, cols: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, between neighbours in proportion; None for a column without a value.

    Nulls and not-a-number don't count. Infinities are values: between two equal ones lies the same one, and what
    lies between a finite and an infinite one is infinite (between both infinities the negative one).
    """
    stack = F.inline(F.array(*(F.struct(F.lit(i).alias("group"), F.col(c).cast("double").alias("x")) for i, c in enumerate(cols))))
    # written: each pass filters by the key, and a filter that is moved below would work it out again, many times over
    values = cut(ordered(df.select(stack).where("x is not null and not isnan(x)"), "x", "key").drop("x"), "keys")
    places = F.array(*(F.lit(float(q)) for q in shares))
    at = lambda total: F.array_distinct(F.flatten(F.transform(places, lambda q: F.array(F.floor(q * (total - 1)), F.ceil(q * (total - 1))))))
    got: dict[int, dict[int, float]] = {i: {} for i in range(len(cols))}
    total = dict.fromkeys(got, 0)
    for r in at_ranks(values, at).collect():
        got[r["group"]][r["rank"]], total[r["group"]] = value_of(r["key"]), r["total"]
    uncut(values)

    def between(i: int, q: float) -> float | None:
        if not total[i]:
            return None
        p = q * (total[i] - 1)
        a, b = got[i][floor(p)], got[i][ceil(p)]
        return a if a == b or isinf(a) else b if isinf(b) else a + (b - a) * (p - floor(p))

    return {c: [between(i, q) for q in shares] for i, c in enumerate(cols)}


def place(key: str, seed: int = 0) -> Column:
    """The first 60 bits of the MD5 of a key (and a seed, unless it is 0): where a row stands in a sample's order."""
    text = F.col(key).cast("string") if not seed else F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def lowest(df: DataFrame, group: Column, key: str, wanted: Callable[[Column], Column], seed: int = 0) -> DataFrame:
    """``df`` with ``taken``: true for exactly ``wanted`` (of the group's number of rows) rows of each group.

    They are the first in the order of :func:`place`, then of the key, so the same on every run and in any
    partitioning. The place that bounds them is found by :func:`at_ranks`; only rows at that very place - of equal
    keys, as places hardly collide - are ranked among themselves.
    """
    rows = df.withColumns({"_g": group, "_h": place(key, seed)})
    last = at_ranks(rows.select(F.col("_g").alias("group"), F.col("_h").alias("key")), lambda total: F.array(wanted(total) - 1))
    last = last.select(F.col("group").alias("_k"), F.col("key").alias("_last"), (F.col("rank") + 1 - F.col("before")).alias("_left"))
    both = rows.join(last, rows["_g"].eqNullSafe(last["_k"]), "left")
    tied = both.where("_h = _last").withColumn("_r", F.row_number().over(W.partitionBy("_g").orderBy(key)))
    tied = tied.withColumn("taken", F.col("_r") <= F.col("_left")).drop("_r")
    apart = both.where("_last is null or _h <> _last").withColumn("taken", F.coalesce(F.col("_h") < F.col("_last"), F.lit(False)))
    return apart.unionByName(tied).select(*df.columns, "taken")


def sample(df: DataFrame, key: str, n: int | None = None, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), or the share ``fraction`` of them rounded down."""
    if (n is None) == (fraction is None):
        raise ValueError("either n or fraction")
    if n == 0:
        return df.limit(0)
    wanted = (lambda total: F.least(F.lit(n).cast("long"), total)) if n is not None else (lambda total: F.floor(total.cast("decimal(20,0)") * F.lit(Decimal(str(fraction)))))
    return lowest(df, F.lit(0), key, wanted, seed).where("taken").drop("taken")


def stratified(df: DataFrame, stratum: str, key: str, percent: int) -> DataFrame:
    """``df`` with ``part``: of each stratum exactly ``percent`` (rounded down) are test, the rest train."""
    split = lowest(df, F.col(stratum), key, lambda total: F.floor(total * percent / 100))
    return split.select(*df.columns, F.when(F.col("taken"), "test").otherwise("train").alias("part"))
