"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.llm.shared import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node in ``edges`` (a, b long): component is its smallest reachable id.

    Edges point from the larger id u to the smaller v; u's parent is its smallest v. A round ties
    each u to its grandparent and each other v of u to u's parent, so paths halve and rounds grow
    with the logarithm of the longest chain. Both joins read written tables, so Spark's skew join
    splits a hub's rows; minima are taken before the shuffle. Loops and repeated edges count once;
    rows with a null end are ignored; no edge gives no row.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = materialize(e.where("u > v").distinct(), "edges")
    while True:
        parent = materialize(e.groupBy("u").agg(F.min("v").alias("p")), "parents")
        above = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jumped = parent.join(above, "p", "left").select("u", F.coalesce("pp", "p").alias("v"), F.col("pp").isNotNull().alias("moved"))
        hooked = e.join(parent, "u").where("v > p").select(F.col("v").alias("u"), F.col("p").alias("v"), F.lit(True).alias("moved"))
        new = materialize(jumped.unionByName(hooked).groupBy("u", "v").agg(F.max("moved").alias("moved")), "edges")
        drop(e)
        drop(parent)
        e = new.select("u", "v")
        if new.where("moved").isEmpty():  # every v is a root, and every u has one
            break
    leaves = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
