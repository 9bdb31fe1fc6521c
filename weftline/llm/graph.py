"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v.

    Large: each node's larger neighbours go to its smallest one (or itself). Small: a node
    and its smaller neighbours go to the smallest of them.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    least = least.select("c", F.least("c", "m").alias("m"))
    met = both.join(least, F.col("u") == F.col("c"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of ``edges`` (u, v); the label is the smallest id reachable.

    Both steps only aggregate with a combiner and join on a node, so a node with very many
    edges is split like any skewed join key; each round shortens paths by a constant factor.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(mark) == seen or not mark["n"]:
            break
        seen = tuple(mark)
        now = cut(_star(_star(now, True), False))
    # settled: every edge goes from a node to the root of its star
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
