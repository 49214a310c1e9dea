"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregate and one join; its result is written to the shared
folder. Vertices and links stay distributed throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.common import saved


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(e: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(vertex, root) for every vertex of `edges` (u, v long); root is the smallest vertex reachable.

    Self-links and repeated links are harmless; an empty table gives an empty
    result. Stops when a round leaves the star forest as it was.
    """
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
              name)
    before = _mark(e)
    while before[0]:
        e = saved(_small_star(_large_star(e)), name)
        now = _mark(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(roots)
