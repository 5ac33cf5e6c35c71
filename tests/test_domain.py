"""Flight semantics on rows written by hand."""

import random
from datetime import datetime as dt
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypath.functions import buckets, clock, text
from waypath.operators import boosting, features, learning, metrics, network, ranks, recurrent, rotation, tables
from waypath.operators.asof import asof_ends, asof_join


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", dt: "timestamp_ntz"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.fixture(scope="module")
def weather(spark):
    rows = [("S", dt(2024, 1, 1, 11, 45), 18.0), ("S", dt(2024, 1, 1, 14, 20), 22.0), ("S", dt(2024, 1, 1, 14, 55), 23.0), ("T", dt(2024, 1, 1, 14, 30), 9.0)]
    return spark.createDataFrame(rows, "station string, valid_ts timestamp_ntz, temp double")


@pytest.fixture(scope="module")
def flights(spark):
    rows = [(1, "S", dt(2024, 1, 1, 14, 32)), (2, "S", dt(2024, 1, 1, 11, 44)), (3, "S", dt(2024, 1, 1, 16, 55)), (4, "S", dt(2024, 1, 1, 16, 55, 1)), (5, None, dt(2024, 1, 1, 14, 32)), (6, "S", None), (7, "U", dt(2024, 1, 1, 14, 32)), (8, "S", dt(2024, 1, 1, 14, 20))]
    return spark.createDataFrame(rows, "leg_id long, station string, dep timestamp_ntz")


ASOF = {1: 22.0, 2: None, 3: 23.0, 4: None, 5: None, 6: None, 7: None, 8: 22.0}


def test_asof_takes_the_latest_within_tolerance(flights, weather):
    got = asof_join(flights, weather, ["station"], "dep", "valid_ts", ["temp"], "2 hours", prefix="dep_")
    assert {r.leg_id: r.dep_temp for r in got.collect()} == ASOF
    assert got.columns == ["leg_id", "station", "dep", "dep_valid_ts", "dep_temp"]


def test_asof_plan_has_no_window_on_a_bare_key(flights, weather):
    plan = asof_join(flights, weather, ["station"], "dep", "valid_ts", ["temp"], "2 hours")._jdf.queryExecution().optimizedPlan().toString()
    assert "[station#" in plan and all("_b#" in line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Window"))


def test_asof_equals_a_search_over_all_rows(spark):
    rng = random.Random(6)
    at = lambda: dt(2024, 1, 1) + timedelta(seconds=rng.randrange(0, 40000))
    left, right = [(i, rng.choice("ab"), at()) for i in range(200)], [(rng.choice("ab"), at(), float(i)) for i in range(60)]
    l, r = spark.createDataFrame(left, "leg_id long, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, s timestamp_ntz, v double")
    for direction, sign in (("backward", 1), ("forward", -1)):
        gap = lambda x, y: (x - y).total_seconds() * sign  # noqa: E731, B023
        want = {i: max((((-gap(t, s)), v) for k2, s, v in right if k2 == k and 0 <= gap(t, s) <= 1800), default=(0, None))[1] for i, k, t in left}
        got = {x.leg_id: x.v for x in asof_join(l, r, ["k"], "t", "s", ["v"], "30 minutes", direction=direction).collect()}
        assert got == want


def test_asof_forward(flights, weather):
    got = asof_join(flights, weather, ["station"], "dep", "valid_ts", ["temp"], "2 hours", direction="forward")
    assert {r.leg_id: r.temp for r in got.collect()} == {1: 23.0, 2: 18.0, 3: None, 4: None, 5: None, 6: None, 7: None, 8: 22.0}


def test_asof_of_both_ends_is_one_pass(spark):
    at = lambda h: dt(2024, 1, 1, h)
    legs = spark.createDataFrame([(1, "A", "B", at(5), at(9)), (2, "B", "A", at(6), None), (3, None, "A", at(7), at(8)), (4, "A", "C", at(4), at(23))], "leg int, origin string, dest string, dep timestamp_ntz, arr timestamp_ntz")
    seen = spark.createDataFrame([("A", at(4), 1.0), ("A", at(8), 2.0), ("B", at(9), 3.0), ("B", at(1), 4.0), (None, at(7), 5.0)], "place string, ts timestamp_ntz, wind double")
    got = asof_ends(legs, seen, ["leg"], ["place"], "ts", ["wind"], "3 hours", {"dep_": (["origin"], "dep"), "arr_": (["dest"], "arr")})
    assert got.columns == ["leg", "origin", "dest", "dep", "arr", "dep_ts", "dep_wind", "arr_ts", "arr_wind"]
    assert {r.leg: (r.dep_wind, r.arr_wind) for r in got.collect()} == {1: (1.0, 3.0), 2: (None, None), 3: (None, 2.0), 4: (1.0, None)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("wind#") and plan.count("Window ") == 1


def test_asof_on_empty_sides(flights, weather):
    assert asof_join(flights, weather.limit(0), ["station"], "dep", "valid_ts", ["temp"], "2 hours").where("temp is not null").count() == 0
    assert asof_join(flights.limit(0), weather, ["station"], "dep", "valid_ts", ["temp"], "2 hours").count() == 0


@pytest.mark.parametrize(("value", "want"), [(5.0, "0005"), (930.0, "0930"), (1745.0, "1745"), (12345.0, "12345")])
def test_hhmm(spark, value, want):
    assert one(spark, clock.hhmm(F.col("c")), c=value) == want


def test_midnight_as_24(spark):
    day = F.to_date("d")
    assert one(spark, clock.clock_ts(day, F.lit("2400")), d="2019-05-31") is None
    assert one(spark, clock.clock_ts(day, F.lit("2400"), midnight_24=True), d="2019-05-31") == dt(2019, 6, 1)
    assert one(spark, clock.clock_ts(day, F.lit("0930")), d="2019-05-31") == dt(2019, 5, 31, 9, 30)


def test_arrival_after_midnight(spark):
    assert one(spark, clock.after(F.col("a"), F.col("b")), a=dt(2024, 1, 1, 23, 45), b=dt(2024, 1, 1, 0, 30)) == dt(2024, 1, 2, 0, 30)


@pytest.mark.parametrize(
    ("local", "zone", "want"),
    [
        (dt(2019, 3, 10, 2, 30), "America/New_York", dt(2019, 3, 10, 7, 30)),  # a clock that was never shown
        (dt(2019, 11, 3, 1, 30), "America/New_York", dt(2019, 11, 3, 5, 30)),  # shown twice: the first
        (dt(2019, 7, 1, 12), "America/Phoenix", dt(2019, 7, 1, 19)),
        (dt(2019, 7, 1, 12), "Bad/Zone", None),
    ],
)
def test_local_to_utc(spark, local, zone, want):
    assert one(spark, clock.to_utc(F.col("t"), F.col("z")), t=local, z=zone) == want


def test_zones_by_place(spark):
    at = lambda lon, lat: one(spark, clock.zone_of(F.col("x"), F.col("y")), x=lon, y=lat)
    assert [at(-155.0, 20.0), at(-112.0, 33.0), at(-112.0, 45.0), at(-115.0, 36.0), at(-87.9, 41.9), at(-73.8, 40.6)] == [
        "Pacific/Honolulu", "America/Phoenix", "America/Denver", "America/Los_Angeles", "America/Chicago", "America/New_York",
    ]


@pytest.mark.parametrize(("raw", "want", "kept"), [("+0123,1", 12.3, 12.3), ("-0056,1", -5.6, -5.6), ("+9999,9", None, 999.9), ("bad", None, None), ("", None, None)])
def test_packed_field(spark, raw, want, kept):
    assert one(spark, text.packed(F.col("c"), 0, 10), c=raw) == want
    assert one(spark, text.packed(F.col("c"), 0, 10, keep_missing=True), c=raw) == kept


@pytest.mark.parametrize(("name", "want"), [("CRSDepTime", "crs_dep_time"), ("Reporting_Airline", "reporting_airline"), ("DepDel15", "dep_del15"), ("STATION NAME", "station_name")])
def test_snake(name, want):
    assert text.snake(name) == want


def test_snake_names_stay_unique():
    assert text.unique_snake(["A b", "a_b", "aB"]) == ["a_b", "a_b_1", "a_b_2"]


def test_rotation_of_one_tail(spark):
    rows = [(1, "X", "A", "B", dt(2024, 1, 1, 8), dt(2024, 1, 1, 9)), (2, "X", "B", "C", dt(2024, 1, 1, 10), dt(2024, 1, 1, 11)), (3, "X", "D", "E", dt(2024, 1, 1, 12), dt(2024, 1, 1, 13)), (4, None, "A", "B", None, None)]
    df = spark.createDataFrame(rows, "leg_id long, tail string, origin string, dest string, dep_ts timestamp_ntz, arr_ts timestamp_ntz")
    got = rotation.links(rotation.neighbours(df, "tail", "dep_ts", "leg_id", ["leg_id", "origin", "dest", "arr_ts", "dep_ts"]))
    got = {r.leg_id: (r.prev_leg_id, r.next_leg_id, r.continuity_flag, r.next_continuity_flag, r.turnaround_minutes) for r in got.collect()}
    assert got == {1: (None, 2, 0, 1, None), 2: (1, 3, 1, 0, 60), 3: (2, None, 0, 0, 60), 4: (None, None, 0, 0, None)}


def test_priority_union_prefers_the_first_source(spark):
    a = spark.createDataFrame([("N1", "master")], "tail string, src string")
    b = spark.createDataFrame([("N1", "old", 3), ("N2", "old", 4)], "tail string, src string, n int")
    assert {(r.tail, r.src, r.n) for r in tables.by_priority(["tail"], [], a, b).collect()} == {("N1", "master", None), ("N2", "old", 4)}


def test_best_station(spark):
    names = ["KA FIELD", "KA AIRPORT", "KA INTL AIRPORT", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.name_score(F.col("n"))).collect()] == [0, 1, 2, 0]


def test_ladder_borders(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.1,), (50.0,), (None,)], "v double")
    assert [r[0] for r in df.select(buckets.ladder(F.col("v"), *buckets.WIND_MPH, closed=True)).collect()] == ["0-10", "0-10", "10-20", "40+", None]


def test_auc_with_ties_and_without_a_class(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    assert metrics.auc(df, "y", "s").first()[0] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert metrics.auc(df.where("y = 1"), "y", "s").first()[0] is None
    assert metrics.auc(df.limit(0), "y", "s").first()[0] is None


def test_half_is_positive_and_empty_ratios_are_zero(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.4)], "y int, s double")
    r = metrics.classification(df, "y", "s").first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (1, 1, 1, 1)
    r = metrics.classification(df, "y", "s", 0.9).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0, 0, 0, 0.5)


def test_hops_and_centralities(spark):
    e = network.edge_table(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")])
    core = spark.createDataFrame([("d",)], "node string")
    assert {r.node: r.hop for r in network.inbound_hops(e, core, 2).collect()} == {"d": 0, "c": 1, "b": 2, "a": 2}
    dist = network.distances(e)
    assert {(r.src, r.dst): r.hops for r in dist.collect()}[("a", "d")] == 2
    assert {r.node: round(r.betweenness, 6) for r in network.betweenness(dist).collect()} == {"a": 0, "b": 0, "c": round(2 / 6, 6), "d": 0}
    assert sum(r.rank for r in network.pagerank(e, 10).collect()) == pytest.approx(1)


def plain_centralities(edges):
    """Every pair's shortest paths, counted from both ends."""
    out, nodes = {}, sorted({v for e in edges for v in e})
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    hops, paths = {}, {}
    for s in nodes:
        hops[s, s], paths[s, s], level = 0, 1, [s]
        while level:
            ahead = []
            for v in level:
                for w in out.get(v, ()):
                    if (s, w) not in hops:
                        hops[s, w], paths[s, w] = hops[s, v] + 1, 0
                        ahead.append(w)
                    if hops[s, w] == hops[s, v] + 1:
                        paths[s, w] += paths[s, v]
            level = ahead
    through = {v: sum(paths[s, v] * paths[v, t] / paths[s, t] for s in nodes for t in nodes if len({s, t, v}) == 3 and (s, t) in hops and (s, v) in hops and (v, t) in hops and hops[s, v] + hops[v, t] == hops[s, t]) for v in nodes}
    far = {s: [h for (a, b), h in hops.items() if a == s and b != s] for s in nodes}
    return {v: (through[v] / max((len(nodes) - 1) * (len(nodes) - 2), 1), len(far[v]) / sum(far[v]) if far[v] else None) for v in nodes}


@pytest.mark.parametrize("most", [10**6, 0])
def test_centralities_equal_all_pairs(spark, most):
    rng = random.Random(2)
    edges = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(40)} | {("far", "n1"), ("n2", "end")})
    want = plain_centralities([e for e in edges if e[0] != e[1]])
    got = network.centralities(network.edge_table(spark, edges + edges[:5]), most).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.betweenness == pytest.approx(want[r.node][0]) and r.closeness == (want[r.node][1] and pytest.approx(want[r.node][1])), r


def test_expanding_folds_never_see_the_future():
    folds = list(learning.expanding([2015, 2016, 2017, 2018], 2))
    assert [(f.train, f.test) for f in folds] == [((2015, 2016), 2017), ((2015, 2016, 2017), 2018)]


def test_two_hop_filter(spark):
    df = network.edge_table(spark, [("x", "core"), ("y", "x"), ("core", "x"), ("z", "y")]).toDF("origin", "dest")
    assert {tuple(r) for r in tables.two_hop_inbound(df, ["core"]).collect()} == {("x", "core"), ("y", "x")}


def test_distances_have_no_cap_on_length(spark):
    n = 60
    dist = network.distances(network.edge_table(spark, [(f"{i:02}", f"{i + 1:02}") for i in range(n)]))
    assert dist.count() == n * (n + 1) // 2 and dist.agg(F.max("hops")).first()[0] == n


def test_keys_keep_the_order_of_doubles(spark):
    import struct

    tiny = [5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308]
    near = [float(np.nextafter(2.0**k, side)) for k in (-1022, -1021, -3, 0, 1, 2, 10, 52, 53, 1000, 1023) for side in (0, np.inf)]
    rng = np.random.default_rng(0)
    some = [struct.unpack("<d", struct.pack("<q", int(b)))[0] for b in rng.integers(0, 2047 << 52, 3000)]
    xs = [*tiny, *near, *some, *(2.0**k for k in range(-1074, 1024, 7)), 0.1, 1.0, 3.0, float("inf"), 0.0]
    xs += [-x for x in xs] + [float("nan"), None]
    got = ranks.ordered(spark.createDataFrame([(x,) for x in xs], "x double"), "x", "key").collect()
    for r in got:
        if r.x is None or r.x != r.x:
            assert r.key is None
        else:
            assert abs(r.key) == struct.unpack("<q", struct.pack("<d", abs(r.x)))[0] and ranks.value_of(r.key) == r.x


def test_quantiles_equal_numpy(spark):
    rng, inf = np.random.default_rng(3), float("inf")
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    cols = {
        "normal": rng.normal(size=301), "wide": rng.normal(size=200) * 10.0 ** rng.integers(-300, 300, 200), "few": np.repeat([1.0, 2.0, 1e12], [5, 3, 2]),
        "whole": rng.integers(-5, 5, 40).astype(float), "zeros": np.array([0.0, -0.0, 1.0, -1.0]), "one": np.array([7.0]), "close": 1 + np.arange(50) * 2.0**-52,
    }
    cols |= {"left": np.array([-inf, 1.0, 2.0, 3.0, 4.0]), "both": np.array([-inf, -inf, 5.0, inf, inf]), "none": np.array([])}
    longest = max(map(len, cols.values()))
    rows = [tuple(float(x[i]) if i < len(x) else (None if i % 2 else float("nan")) for x in cols.values()) for i in range(longest)]
    got = ranks.quantiles(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), list(cols), shares)
    for c in ("normal", "wide", "few", "whole", "zeros", "one", "close"):
        assert got[c] == pytest.approx(list(np.quantile(cols[c], shares)), rel=1e-12), c
    assert got["left"] == [-inf, -inf, 1.0, 2.0, pytest.approx(3.96), 4.0]
    assert got["both"] == [-inf, -inf, -inf, 5.0, inf, inf]
    assert got["none"] == [None] * 6


def test_describe_takes_columns_together(spark):
    df = spark.createDataFrame([(1.0, 4), (2.0, None), (float("-inf"), 6), (None, 9)], "a double, b int")
    got = {r["column"]: r for r in tables.describe(df, "a", "b").collect()}
    assert (got["a"].n, got["a"].nulls, got["a"].min, got["a"].q50, got["a"]["max"]) == (3, 1, float("-inf"), 1.0, 2.0)
    assert (got["b"].n, got["b"].nulls, got["b"].mean, got["b"].q25, got["b"].q75) == (3, 1, pytest.approx(19 / 3), 5.0, 7.5)


def test_many_groups_are_narrowed_by_tables(spark, monkeypatch):
    """With more open ranks than come to the driver."""
    monkeypatch.setattr(ranks, "FEW", 3)
    rows = [(None if i % 7 == 0 else i % 7, (i * 2654435761) % (1 << 60)) for i in range(700)]
    got = {(r["group"], r["rank"]): r["key"] for r in ranks.at_ranks(spark.createDataFrame(rows, "group long, key long"), lambda t: F.array(F.lit(0).cast("long"), t - 1)).collect()}
    for g in {g for g, _ in rows}:
        keys = [k for h, k in rows if h == g]
        assert (got[g, 0], got[g, len(keys) - 1]) == (min(keys), max(keys))


def test_strata_are_split_exactly(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(200)], "k string, i long")
    got = ranks.stratified(df, "k", "i", 25).groupBy("k", "part").count().collect()
    sizes = {None: 67, "a": 133}
    assert {(r.k, r.part): r["count"] for r in got} == {(k, p): (n * 25 // 100 if p == "test" else n - n * 25 // 100) for k, n in sizes.items() for p in ("test", "train")}


def test_samples_are_exact_and_alike(spark):
    df = spark.createDataFrame([(i % 90, i) for i in range(180)], "k long, i long")  # each key twice
    a, b = ({r.k for r in ranks.sample(x, "k", n=40, seed=3).collect()} for x in (df, df.repartition(5)))
    assert a == b and len(a) == 20
    assert ranks.sample(df, "k", n=41).count() == 41 and ranks.sample(df, "k", n=999).count() == 180
    assert ranks.sample(df, "k", fraction=0.29).count() == 52 and ranks.sample(df, "k", n=0).count() == 0
    assert {r.k for r in ranks.sample(df, "k", n=40, seed=4).collect()} != a
    plan = ranks.sample(df, "k", n=40)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_correlations_of_complete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 5.0), (9.0, None)], "a double, b double")
    got = {(r.a, r.b): r.r for r in tables.correlations(df, ["a", "b"]).collect()}
    assert got[("a", "a")] == pytest.approx(1) and got[("a", "b")] == got[("b", "a")] == pytest.approx(0.9819805)


def test_feature_sets_have_their_sizes():
    assert {n: len(s) for n, s in features.SETS.items()} == {"schedule": 9, "context": 20, "2hop_propagation": 30, "2hop_delay_only": 19, "aircraft_state": 19, "ops_full": 43, "full": 33, "full_aircraft": 37}
    assert all(len(set(s)) == len(s) for s in features.SETS.values()) and len(features.STEP) == 29


def test_permutation_drops_only_what_matters(spark):
    """A label that is one feature's sign: that feature's importance is large, the other's none."""
    from pyspark.ml.classification import LogisticRegression

    df = spark.createDataFrame([(i, float(i % 2) * 2 - 1, float(i * 7 % 11), i % 2) for i in range(200)], "i long, x double, z double, label int")
    model = learning.pipeline(["x", "z"], [], LogisticRegression(labelCol="label", maxIter=10)).fit(df)
    assert learning.evaluated(model, df, "label")["auc"] == 1
    rows = learning.numbered(df.repartition(3))
    assert learning.permuted(model, rows, 200, "label", "x", 0) < 0.7 and learning.permuted(model, rows, 200, "label", "z", 0) > 0.99


def test_every_row_is_a_donor_once(spark):
    for n in (1, 2, 3, 7, 64, 1000, 5003):
        rows = learning.numbered(spark.range(n).repartition(5))
        got = rows.select("_i", learning.shuffled(F.col("_i"), n, 1).alias("a"), learning.shuffled(F.col("_i"), n, 2).alias("b")).collect()
        assert sorted(r._i for r in got) == sorted(r.a for r in got) == sorted(r.b for r in got) == list(range(n))
        if n >= 1000:
            assert sum(r.a == r._i for r in got) < 10 and sum(r.a == r.b for r in got) < 10
            assert abs(np.corrcoef([r._i for r in got], [r.a for r in got])[0, 1]) < 0.1


def test_known_coefficients_are_found(spark):
    from pyspark.ml.regression import LinearRegression

    df = spark.createDataFrame([(float(i % 13), float(i * 5 % 17), 3.0 * (i % 13) - 2.0 * (i * 5 % 17) + 1) for i in range(300)], "x double, z double, y double")
    fitted = learning.pipeline(["x", "z"], [], LinearRegression(labelCol="y")).fit(df).stages[-1]
    assert list(fitted.coefficients) == pytest.approx([3, -2]) and fitted.intercept == pytest.approx(1)


def test_balanced_weights_sum_alike(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 9, "label int")
    got = {r.label: (r.s, r.n) for r in learning.balanced(df, "label", "w").groupBy("label").agg(F.sum("w").alias("s"), F.count("*").alias("n")).collect()}
    assert got[0][0] == pytest.approx(6) and got[1][0] == pytest.approx(6)


def test_search_ranks_by_mean_over_folds(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    df = spark.createDataFrame([(y, float(i % 2), i % 2) for y in range(4) for i in range(20)], "year int, x double, label int")
    build = lambda c: LogisticRegression(labelCol="label", maxIter=c["n"])
    got = learning.search(df, "year", list(learning.expanding([0, 1, 2, 3], 2)), learning.grid(n=[0, 5]), learning.pipeline(["x"], [], None), build, "label")
    assert [g["n"] for g in got] == [5, 0] and got[0]["auc"] == 1 and got[1]["auc"] == 0.5


def test_recurrent_gradients():
    shape, rng = recurrent.Shape(3, 4), np.random.default_rng(1)
    flat, x = shape.first(2), rng.normal(size=(5, 3, 3))
    label, amount = np.array([0.0, 1, 1, 0, 1]), rng.normal(size=5)
    _, grad = recurrent.loss_and_gradient(shape, flat, x, label, amount)
    for k in range(0, len(flat), 3):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = (recurrent.loss_and_gradient(shape, up, x, label, amount)[0] - recurrent.loss_and_gradient(shape, down, x, label, amount)[0]) / 2e-5
        assert grad[k] == pytest.approx(slope, rel=1e-4, abs=1e-8)


def test_recurrent_learns_what_depends_on_the_order_of_steps(spark):
    """The class is whether the first step is above the last, the amount their difference."""
    rng = np.random.default_rng(4)
    steps = rng.normal(size=(1500, 3, 2))
    rows = [([[float(v) for v in s] for s in x], int(x[0][0] > x[2][0]), float(5 * (x[0][0] - x[2][0]) + 2)) for x in steps] + [(None, 1, 1.0)]
    df = spark.createDataFrame(rows, "steps array<array<double>>, label int, delay double").repartition(2)
    got = recurrent.fit(df, "label", "delay", hidden=8, rounds=12, rate=0.03).scored(df.where("steps is not null"))
    assert metrics.auc(got, "label", "score").first()[0] > 0.97
    assert metrics.regression(got, "delay", "predicted").first()["rmse"] < 3.5  # half of what a constant leaves


def test_boosting_goes_on_from_year_to_year(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(3)
    rows = [(y, x := rng.random(), z := rng.random(), int(x + (0.5 if y > 1 else 0) * z + rng.random() / 4 > 0.7)) for y in (1, 2, 3) for _ in range(200)]
    df = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(spark.createDataFrame(rows, "year int, x double, z double, label int"))
    assert boosting.shares(11, 3) == [3, 3, 5] and boosting.shares(2, 3) == [0, 0, 2]
    model = boosting.by_year(df, "year", [1, 2, 3], "label", rounds=5)
    assert len(model.trees) == 5 and all(after <= before for before, after in model.losses.values())
    assert metrics.auc(model.scored(df), "label", "score").first()[0] > 0.9
    one = boosting.by_year(df.where("year = 1"), "year", [1], "label", rounds=3)
    same = boosting.by_year(df.where("year = 1").withColumn("all", F.lit(7)), "all", [7], "label", rounds=3)
    a, b = (sorted(r.score for r in m.scored(df).select("score").collect()) for m in (one, same))
    assert a == pytest.approx(b)
    # by hand: the first tree's leaves are means of label - 1/2
    first = boosting.by_year(df.where("year = 1"), "year", [1], "label", rounds=1, depth=1)
    leaf = first.margins(df.where("year = 1")).groupBy("margin").agg(F.avg(F.col("label") - 0.5).alias("mean")).collect()
    assert len(leaf) == 2 and all(r.margin == pytest.approx(r["mean"]) for r in leaf)
