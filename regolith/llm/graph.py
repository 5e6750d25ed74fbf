"""Connected components of a large, sparse graph by alternating stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import forget, written


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) with a <> b, in either order, repeats allowed. Returns (node, component): component is the smallest node reachable; one row
    for each node that has an edge and isn't itself the smallest.

    Each round hangs every node's larger neighbours below its smallest neighbour, then its smaller ones; rounds grow as the logarithm of the
    longest path. Minima are combined before they are shuffled, so a node with a third of all edges is no hot group, and rows never exceed the
    edges' number. Null ends are left out; an empty graph gives no rows.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if not mark["n"] or before is not None and (mark["n"], mark["x"]) == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = (mark["n"], mark["x"])
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", "m")).distinct()
        after = written(small)
        forget(spark, now)
        now = after
