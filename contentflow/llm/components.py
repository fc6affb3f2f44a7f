"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.llm.common import save


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: 64-bit nodes) to (node, root), root the smallest node of the component; nodes without links
    and roots are left out.

    Each round hangs the larger neighbours of every node below its smallest neighbour, then does so with the smaller
    ones; the number of rounds follows the logarithm of the longest path. Only narrow rows are shuffled, every
    group is a minimum that is combined before the shuffle, and each round is written to the shared folder."""
    edges = save(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == mark or not state["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(state)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = save(small.select("a", F.col("m").alias("b")).unionByName(
            small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a != b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
