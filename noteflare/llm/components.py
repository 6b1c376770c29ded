"""Connected components over an edge table: alternating large-star and small-star.

Each star step is a min aggregate (combined map-side, so a hub is reduced
before the shuffle) joined back to the edges (a hub's rows are split by
adaptive skew joins).  No neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflare.llm.common import drop_scratch, scratch_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v): every u links its neighbours to its smallest one."""
    pairs = edges
    if large:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        low = low.select("u", F.least("u", "m").alias("m"))
        out = pairs.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = pairs.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges -> (node, root): the smallest node reachable; isolated nodes are absent.

    Loops and repeated edges are ignored.  Ends when a round of both steps
    leaves the edge set unchanged (its count and hash sum), which takes a
    number of rounds logarithmic in the component size.
    """
    e = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch_table(e, "cc")

    def state(df):
        return df.agg(F.count("*"), F.sum((F.xxhash64("u", "v") / 2**20).cast("decimal(20,0)"))).first()

    before = state(e)
    while before[0]:
        new = scratch_table(_star(_star(e, large=True), large=False), "cc")
        after = state(new)
        drop_scratch(e)
        e = new
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
