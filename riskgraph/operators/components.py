"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import SMALL_ROWS
from ..sources.io import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): every end of an edge with the smallest node of its component.

    Alternates two steps until the edge table stays the same, with no limit on rounds: the large star links each
    larger neighbour of a node to the smallest node around it, the small star does so for the smaller neighbours.
    Paths shrink by a constant factor per round, so rounds grow with the logarithm of the longest path. Each step
    is a partial minimum per node and a join of two written tables, which lets Spark split a node that very many
    edges meet; a table of few rows needs no splitting, and its minima are not written. The driver sees a count and a checksum. Loops and repeated edges are fine; null ends are dropped."""
    a, b = edges[u], edges[v]
    e = cut(edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    loops = e.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    e = e.where("u <> v")
    state = _state(e)
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        low = low if state[0] <= SMALL_ROWS else cut(low, "cc-low")
        e = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        low = low if state[0] <= SMALL_ROWS else cut(low, "cc-low")
        e = cut(e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .union(low.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        new = _state(e)
        if new == state:
            break
        state = new
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).union(loops) \
        .groupBy("node").agg(F.min("component").alias("component"))
