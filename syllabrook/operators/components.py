"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabrook.session import cut_lineage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Every node of an edge list with the smallest node of its component: (node, root).

    Alternates large-star and small-star steps; the number of edges never grows, each step is two
    aggregations with map-side combine, and a component of any size is never gathered in one task.
    Rounds go on until one changes nothing; lineage is cut after each. Self loops and repeated edges do no harm; null ends are dropped;
    an empty edge list gives an empty result.
    """
    links = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    links = cut_lineage(links)
    before = None
    while True:
        # large star: every neighbour above a node hangs on the smallest of node and neighbours
        both = links.union(links.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        links = cut_lineage(small.select(F.col("m").alias("u"), F.col("u").alias("w")).union(small.select(F.col("m").alias("u"), F.col("v").alias("w"))).filter("u <> w").toDF("u", "v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return links.select(F.col("v").alias("node"), F.col("u").alias("root")).union(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
