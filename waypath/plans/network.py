"""Graph queries (G): places are nodes, busy routes edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from waypath.operators import network, tables
from waypath.plans.legs import LEGS, Registry, legs

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: Routes flown a quarter more often than the mean route: by a rule over all legs, a graph that isn't complete.
_EDGES = f"""{LEGS}, routes AS (SELECT origin AS src, dest AS dst, count(*) AS n FROM legs GROUP BY 1, 2),
mean AS (SELECT sum(n)::DOUBLE / count(*) AS m FROM routes), e AS (SELECT src, dst FROM routes, mean WHERE n > 1.25 * m)"""


def _edges(spark, d):
    routes = legs(spark, d).groupBy(F.col("origin").alias("src"), F.col("dest").alias("dst")).agg(F.count("*").alias("n"))
    mean = routes.agg((F.sum("n").cast("double") / F.count("*")).alias("m"))
    return routes.join(F.broadcast(mean), F.col("n") > 1.25 * F.col("m")).select("src", "dst")  # one row on the right


def _core(spark):
    return spark.createDataFrame([("N1",), ("N2",)], "node string")


@query(f"""WITH RECURSIVE {_EDGES}, h AS (SELECT DISTINCT x AS node, 0 AS hop FROM (VALUES ('N1'), ('N2')) t(x) UNION SELECT src, hop + 1 FROM h JOIN e ON dst = node WHERE hop < 2)
SELECT node, min(hop) AS hop FROM h GROUP BY 1""")
def G01_inbound_hops(spark, d):
    return network.inbound_hops(_edges(spark, d), _core(spark), 2)


@query(f"""WITH RECURSIVE {_EDGES}, h0 AS (SELECT DISTINCT x AS node, 0 AS hop FROM (VALUES ('N1'), ('N2')) t(x) UNION SELECT src, hop + 1 FROM h0 JOIN e ON dst = node WHERE hop < 2),
h AS (SELECT node, min(hop) AS hop FROM h0 GROUP BY 1)
SELECT leg_id, tail FROM legs JOIN h a ON origin = a.node JOIN h b ON dest = b.node WHERE a.hop = b.hop + 1""")
def G02_market_subset(spark, d):
    hops = network.inbound_hops(_edges(spark, d), _core(spark), 2)
    x = tables.lookup(legs(spark, d), hops, "origin", "node", {"hop": "a"})
    return tables.lookup(x, hops, "dest", "node", {"hop": "b"}).where("a = b + 1").select("leg_id", "tail")


@query(f"""WITH {_EDGES}, n AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, count(*) AS degree FROM n GROUP BY 1""")
def G03_degrees(spark, d):
    return network.degrees(_edges(spark, d))


@query(f"""WITH RECURSIVE {_EDGES}, nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), c AS (SELECT count(*) AS n FROM nodes),
m AS (SELECT a.node AS src, b.node AS dst, CASE WHEN o.n IS NULL THEN 1.0 / c.n ELSE coalesce(k.hit / o.n, 0.0) END AS share FROM nodes a, nodes b, c LEFT JOIN o ON a.node = o.src LEFT JOIN (SELECT src, dst, 1.0 AS hit FROM e) k ON k.src = a.node AND k.dst = b.node),
r AS (SELECT 0 AS i, list(node ORDER BY node) AS names, list(1.0::DOUBLE / c.n ORDER BY node) AS v FROM nodes, c GROUP BY c.n
 UNION ALL SELECT i + 1, names, (SELECT list(x ORDER BY dst) FROM (SELECT dst, 0.15 / c.n + 0.85 * sum(share * v[list_position(names, src)]) AS x FROM m, c GROUP BY dst, c.n)) FROM r WHERE i < 20)
SELECT unnest(names) AS node, round(unnest(v), 6) AS rank FROM r WHERE i = 20""")
def G04_pagerank(spark, d):
    return network.pagerank(_edges(spark, d), 20).select("node", F.round("rank", 6).alias("rank"))


@query()
def G05_betweenness(spark, d):
    return network.centralities(_edges(spark, d)).select("node", F.round("betweenness", 6).alias("betweenness"))


@query(f"""WITH RECURSIVE {_EDGES}, w AS (SELECT src, dst, 1 AS hops FROM e WHERE src <> dst UNION SELECT w.src, e.dst, hops + 1 FROM w JOIN e ON w.dst = e.src WHERE hops < (SELECT count(DISTINCT src) + count(DISTINCT dst) FROM e) AND w.src <> e.dst),
s AS (SELECT src, dst, min(hops) AS hops FROM w GROUP BY 1, 2) SELECT src AS node, round(count(*) / sum(hops), 6) AS closeness FROM s GROUP BY 1""")
def G06_closeness(spark, d):
    return network.centralities(_edges(spark, d)).where("closeness is not null").select("node", F.round("closeness", 6).alias("closeness"))


@query(f"""WITH {_EDGES}, h1 AS (SELECT DISTINCT src AS node FROM e WHERE dst IN ('N1', 'N2') AND src NOT IN ('N1', 'N2')),
h2 AS (SELECT DISTINCT src AS node FROM e WHERE dst IN (SELECT node FROM h1) AND src NOT IN (SELECT node FROM h1) AND src NOT IN ('N1', 'N2'))
SELECT node, 1 AS hop FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def G07_hop_sets(spark, d):
    return network.inbound_hops(_edges(spark, d), _core(spark), 2).where("hop > 0")
