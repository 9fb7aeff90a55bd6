"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestay.storage import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(id, component) for every id that an edge names; component is the smallest id that edges lead to.

    No neighbour list is gathered: each step is one aggregation and one join, so a node with very many edges is
    split like any skewed join. Steps end when the edges form stars; their number grows with the logarithm of
    the longest path. Every step is written to ``scratch``. Edges with a null end are left out.
    """
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    now, seen = scratch.write(clean, "edges"), None
    while True:
        now = scratch.write(_small_star(_large_star(now)).where("u <> v").distinct(), "stars")
        total = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if total == seen or total[0] == 0:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        seen = total
