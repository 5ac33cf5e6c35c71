"""Graphs as edge tables: hops, degrees, PageRank, and shortest-path centralities.

Iterations are joins on node tables. A round's result is written out where
the plan would otherwise grow with the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.session import cut


def _cut(df: DataFrame) -> DataFrame:
    return cut(df, "graph")


def inbound_hops(edges: DataFrame, core: DataFrame, most: int) -> DataFrame:
    """(node, hop): the fewest edges (src, dst) from a node to one of ``core`` (node), up to ``most``."""
    edges = edges.select("src", "dst").distinct()
    found = core.select("node", F.lit(0).alias("hop"))
    frontier = found
    for hop in range(1, most + 1):
        step = edges.join(frontier, edges["dst"] == frontier["node"]).select(F.col("src").alias("node")).distinct()
        frontier = _cut(step.join(found, "node", "left_anti").withColumn("hop", F.lit(hop)))
        found = found.unionByName(frontier)
    return found


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, degree) of distinct edges."""
    e = edges.select("src", "dst").distinct()
    both = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count("*").alias("degree"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds; ranks sum to one. Dead ends spread evenly. No edges give no rows."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("n_out"))
    shares = _cut(e.join(out, "src"))
    nodes = _cut(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(rounds):
        sent = _cut(shares.join(rank, shares["src"] == rank["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("n_out")).alias("got")))
        lost = 1 - (sent.agg(F.sum("got")).first()[0] or 0.0)
        rank = nodes.join(sent, "node", "left").select("node", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        rank = _cut(rank)
    return rank


def distances(edges: DataFrame) -> DataFrame:
    """(src, dst, hops, paths) of all pairs of nodes with a path: fewest edges and number of such paths.

    Goes on until no pair is new. For small graphs (places, not legs): pairs are the square of nodes.
    """
    e = _cut(edges.where("src <> dst").select("src", "dst").distinct())
    found = e.select("src", "dst", F.lit(1).alias("hops"), F.lit(1.0).alias("paths"))
    frontier = found
    for hops in count(2):
        nxt = frontier.alias("f").join(e.alias("e"), F.col("f.dst") == F.col("e.src")).where(F.col("f.src") != F.col("e.dst"))
        nxt = nxt.groupBy(F.col("f.src").alias("src"), F.col("e.dst").alias("dst")).agg(F.sum("f.paths").alias("paths"))
        frontier = _cut(nxt.join(found, ["src", "dst"], "left_anti").select("src", "dst", F.lit(hops).alias("hops"), "paths"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return _cut(found)


def closeness(dist: DataFrame) -> DataFrame:
    """(node, closeness): nodes reached by the sum of their distances."""
    return dist.groupBy(F.col("src").alias("node")).agg((F.count("*") / F.sum("hops")).alias("closeness"))


def betweenness(dist: DataFrame) -> DataFrame:
    """(node, betweenness): over ordered pairs of other nodes, the share of shortest paths through the
    node, divided by the number of such pairs."""
    a, b, c = dist.alias("a"), dist.alias("b"), dist.alias("c")
    via = a.join(b, F.col("a.dst") == F.col("b.src")).join(c, (F.col("a.src") == F.col("c.src")) & (F.col("b.dst") == F.col("c.dst")))
    via = via.where(F.col("a.hops") + F.col("b.hops") == F.col("c.hops"))
    sums = via.groupBy(F.col("a.dst").alias("node")).agg(F.sum(F.col("a.paths") * F.col("b.paths") / F.col("c.paths")).alias("s"))
    nodes = dist.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = nodes.count()
    pairs = max((n - 1) * (n - 2), 1)
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("s", F.lit(0.0)) / pairs).alias("betweenness"))


#: Edges (two numbers of four bytes) up to which a graph is broadcast.
BROADCAST_EDGES = 5_000_000


class Adjacency:
    """A directed graph as a compressed adjacency: the edges of node v are ``targets[starts[v] : starts[v + 1]]``."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int):
        order = np.argsort(src, kind="stable")
        self.n, self.targets = n, dst[order].astype(np.int32)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n)))).astype(np.int64)

    def edges_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both ends of all edges that leave ``nodes``."""
        m = self.starts[nodes + 1] - self.starts[nodes]
        at = np.repeat(self.starts[nodes] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        return np.repeat(nodes, m), self.targets[at]

    def from_source(self, s: int) -> tuple[np.ndarray, int, int]:
        """What shortest paths from s add to each node's betweenness, how many nodes s reaches, and the sum of their distances."""
        hops, paths = np.full(self.n, -1), np.zeros(self.n)
        hops[s], paths[s] = 0, 1
        level, levels, reached, far = np.array([s]), [], 0, 0
        while len(level):
            v, w = self.edges_of(level)
            new = np.unique(w[hops[w] < 0])
            hops[new] = len(levels) + 1
            ahead = hops[w] == len(levels) + 1
            v, w = v[ahead], w[ahead]
            paths += np.bincount(w, paths[v], self.n)
            levels.append((v, w))
            level, reached, far = new, reached + len(new), far + len(new) * len(levels)
        share = np.zeros(self.n)
        for v, w in reversed(levels):
            share += np.bincount(v, paths[v] / paths[w] * (1 + share[w]), self.n)
        share[s] = 0
        return share, reached, far


def centralities(edges: DataFrame, most: int = BROADCAST_EDGES) -> DataFrame:
    """(node, betweenness, closeness) of distinct edges (src, dst): see :func:`betweenness` and :func:`closeness`.

    Up to ``most`` edges are broadcast (counted first). Sources are dealt to tasks; each goes through the shortest paths
    from its sources one source at a time and gives one sum a node, whatever the number of sources, so nothing
    grows with pairs. A larger graph goes through joins of pairs.
    """
    spark = edges.sparkSession
    e = _cut(edges.where("src <> dst").select("src", "dst").distinct())
    if e.count() > most:
        dist = distances(e)
        return betweenness(dist).join(closeness(dist), "node", "left")
    ends = e.toPandas()
    names, code = np.unique(np.concatenate((ends["src"], ends["dst"])).astype(str), return_inverse=True)
    n, m = len(names), len(ends)
    graph = spark.sparkContext.broadcast((Adjacency(code[:m], code[m:], n), names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adjacency, nodes = graph.value
        sums, reach, far = np.zeros(len(nodes)), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        for p in batches:
            for s in p["id"]:
                share, reach[s], far[s] = adjacency.from_source(int(s))
                sums += share
        own = np.flatnonzero((sums > 0) | (reach > 0))
        yield pd.DataFrame({"node": nodes[own], "s": sums[own], "reach": reach[own], "far": far[own]})

    tasks = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = spark.range(0, n, 1, tasks).mapInPandas(run, "node string, s double, reach long, far long")
    total = parts.groupBy("node").agg(F.sum("s").alias("s"), F.sum("reach").alias("reach"), F.sum("far").alias("far"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select(F.col("node").cast("string").alias("node"))
    pairs = max((n - 1) * (n - 2), 1)
    return nodes.join(total, "node", "left").select("node", (F.coalesce("s", F.lit(0.0)) / pairs).alias("betweenness"), F.expr("try_divide(reach, far)").alias("closeness"))


def edge_table(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(pairs, "src string, dst string")
