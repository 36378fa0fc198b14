"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsflow.llm.common import cut, drop_cut


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the links ``a``-``b``.

    Each round is an aggregate per node and a join back, for which the links of a node are
    dealt to several places; edges are written to the shared folder after each round. Links
    of a node to itself and repeated links are allowed; no links give no rows.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = cut(pairs.where("a < b").distinct(), "links")
    before = None
    while True:
        spent, edges = edges, cut(_small_star(_large_star(edges)).where("a < b").distinct(), "stars")
        drop_cut(spent)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # every edge now leads from the smallest node to another one of its component
    out = edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
    out._newsflow_path = edges._newsflow_path  # for drop_cut
    return out


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


#: Places that the links of one node are dealt to.
DEALT = 16


def beside(links: DataFrame, least: DataFrame) -> DataFrame:
    """Links (u, v) with the smallest node of ``u``, which is sent to every place."""
    place = F.pmod(F.xxhash64("v"), F.lit(DEALT)).alias("place")
    every = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)).cast("array<bigint>")).alias("place")
    # never a broadcast: the optimizer sees the size of the side before it is multiplied
    dealt = least.select("u", "m", every).hint("merge")
    return links.select("u", "v", place).join(dealt, ["u", "place"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to its smallest one (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where("v > u")
    return _ordered(beside(larger, least).select("v", F.col("m").alias("u")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the smallest one."""
    down = edges.where("a < b").select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = beside(down, least).select("v", F.col("m").alias("u"))
    kept = least.select(F.col("u").alias("v"), F.col("m").alias("u"))
    return _ordered(moved.unionByName(kept))
