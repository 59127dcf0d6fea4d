"""Connected components by alternating large-star and small-star steps, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _toward_least(pairs: DataFrame, both: bool) -> DataFrame:
    """Link each neighbour of u (only the smaller ones, unless both) to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = pairs.join(least, "u")
    if both:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u and root (the least node of its component) for every node that isn't a root. edges: u, v of type long.

    Only counts of a step reach the driver. Minima are taken map-side first, and the joins are plain
    equi-joins, whose skewed keys Spark splits. Every step ends in a reliable checkpoint.
    """
    links = checkpointed(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        sign = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (sign["n"], sign["x"]) == state or sign["n"] == 0:
            return links.select("u", F.col("v").alias("root"))
        state = (sign["n"], sign["x"])
        large = _toward_least(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), both=True)
        links = checkpointed(_toward_least(large, both=False))
