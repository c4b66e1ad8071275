"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import spent, stored

def _state(links: DataFrame) -> tuple:
    """A count and two sums of hashes: equal for equal sets of links."""
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is named by its smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest neighbour. Every round
    is stored in the shared folder and the one before it deleted; rounds grow with the logarithm of the longest chain.
    No group is ever gathered: only its minimum is, by partial aggregation. A hub's links meet its one minimum in a join
    that adaptive execution splits when they are many. No links give an empty table.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        after = stored(small)
        spent(now)
        before, state, now = state, _state(after), after
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
