"""Connected components of a graph that stays distributed: alternating large and small stars.

Each round replaces a node's edges by edges to the smallest node in sight, with grouped minima and
joins alone; rounds are written to shared storage, which cuts the lineage. The number of rounds grows
with the logarithm of the longest path; nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_dir, written


def _sum(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return r.n, r.x


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (node, root): each node with an edge to another, and its component's smallest node."""
    spark = edges.sparkSession
    path = shared_dir(spark, "edges")
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", path)
    before = None
    while (now := _sum(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        old, path = path, shared_dir(spark, "edges")
        edges = written(small.where("u <> v").distinct(), "edges", path)
        remove(spark, old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
