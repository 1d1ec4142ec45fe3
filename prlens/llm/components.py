"""Connected components of a graph given as a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prlens.llm._arrow import discard, written


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """``node`` and ``label`` (the component's smallest node) for all nodes of ``links`` (columns ``u``, ``v``).

    Every round moves links towards the smallest nodes of their neighbourhoods, in aggregations that combine before
    the shuffle and joins with one row a node; no neighbourhood is gathered. Rounds are written to the shared folder.
    Nodes may be of any type with an order. Links that have not settled after ``most`` rounds are an error.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    nodes = edges
    state = None
    for k in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, edges = edges, written(small, f"stars-{k}")
        if last is not nodes:
            discard(last)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    labels = edges.groupBy("u").agg(F.min("v").alias("label"))
    every = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    out = written(every.join(labels, every["node"] == labels["u"], "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    for table in {id(t): t for t in (nodes, edges)}.values():
        discard(table)
    return out
