"""Connected components of an edge table, by alternating large and small stars.

Every step is a grouped minimum (partially aggregated before the shuffle) and an equi-join in which no node
is hot; no group is gathered anywhere. The edge table is written once per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import written

#: Edges up to which all nodes' minima are broadcast (16 bytes each); neighbours beyond which a node's is, in larger graphs.
FEW_EDGES, HEAVY = 1_000_000, 10_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _with_lowest(rows: DataFrame, low: DataFrame, edges: int) -> DataFrame:
    """``rows`` (u, v) with ``m`` from ``low`` (u, m, degree).

    The lowest of all nodes are broadcast while there are few edges (``low`` has two rows an edge at most). Of
    large graphs only those of nodes with more than ``HEAVY`` neighbours are, one for HEAVY edge ends at most: what is left to
    the join by node has no hot key.
    """
    if edges <= FEW_EDGES:
        return rows.join(F.broadcast(low.select("u", "m")), "u")
    low = written(low, "cc-lowest")
    heavy = F.broadcast(low.filter(F.col("degree") > HEAVY).select("u", "m"))
    light = low.filter(F.col("degree") <= HEAVY).select("u", "m")
    return rows.join(heavy, "u").unionByName(rows.join(heavy, "u", "left_anti").join(light, "u"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of edges (a, b); a written table.

    Null ends and self loops are ignored; repeated edges count once.
    """
    now = written(edges.select("a", "b").filter("a <> b").distinct(), "cc-edges")
    count = lambda: now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = count()
    while seen[0]:
        # large star: each node ties its larger neighbours to the smallest one it knows
        ways = _both_ways(now)
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = _with_lowest(ways.filter("v > u"), low, seen[0]).select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: each node ties itself and its smaller neighbours to the smallest of them
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if seen[0] > FEW_EDGES:
            down = written(down.distinct(), "cc-down")
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = _with_lowest(down, low, seen[0]).select(F.explode(F.array(
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = written(small.filter("a <> b").distinct(), "cc-edges")
        state = count()
        if state == seen:
            break
        seen = state
    return written(now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct(), "cc-labels")
