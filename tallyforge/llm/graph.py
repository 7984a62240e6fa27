"""Connected components of an edge list, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, root): each node's smallest reachable node. Nodes without edges don't appear.

    Each step links a node's neighbours to the smallest of them; the steps alternate until nothing changes, in a
    number that is logarithmic in practice. Minima are aggregated before the shuffle, and the joins are equi-joins
    that adaptive execution splits where a node is hot. Every step is written, so a lost executor costs one step.
    """
    e = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    if not e.take(1):
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        # Large star: each node's larger neighbours go to the smallest of the node and its neighbours.
        both = e.unionAll(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u_"), F.least("u", "m").alias("m"))
        large = save(both.filter("v > u").join(least, F.col("u") == F.col("u_")).select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct(), "large")
        # Small star: each node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "b_")
        joined = large.join(least, F.col("b") == F.col("b_"))
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionAll(joined.select(F.col("m").alias("a"), F.col("b"))).filter("a < b").distinct()
        small = save(small, "small")
        # Stars: each node is either always an edge's smaller or always its larger node, and has one root.
        if small.select("b", "a").exceptAll(e.select("b", "a")).isEmpty() and e.select("b", "a").exceptAll(small.select("b", "a")).isEmpty():
            break
        e = small
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(e.select(F.col("a"), F.col("a")).distinct())
