"""Connected components of links by alternating star contraction, one stored table of edges per round.

A round hangs the larger neighbours of every node on its smallest one, then the smaller ones too. Minima are summed map-side and
joined back, so a node with very many links is never gathered; the number of rounds is logarithmic in the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of all ids that have a link to another id; component is the smallest id that links reach."""
    pairs = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stored(pairs, "edges")
    before, now = None, _mark(edges)
    while before != now:
        both = edges.union(edges.select("v", "u")).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        edges = stored(small.select("e.*").filter("u <> v").distinct(), "edges")
        before, now = now, _mark(edges)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
