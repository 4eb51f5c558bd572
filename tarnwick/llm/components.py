"""Connected components of an edge table, with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import cut, small_or_shuffled

#: A row of two nodes.
ROW_BYTES = 64


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for undirected edges (a, b) of nodes with an order (bigint, decimal); a component is named by its least node.

    Alternates two star contractions (Kiveris et al., *Connected Components in MapReduce and Beyond*, 2014): each node
    links its larger neighbours to its least one, then its smaller ones.  Minima are aggregated on the map side, so a
    node with very many links is one row per task; the joins back have one row per node on one side, which is broadcast where
    the counted edges, of a fixed width, are few and left to AQE (which splits skewed keys) where not.  Each round is written to the shared
    checkpoint folder.  Ends when a round changes nothing.
    """
    star = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _state(star)
    for _ in range(most_rounds):
        star = cut(_small_star(_large_star(star, seen[0]), seen[0]))
        now = _state(star)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    nodes = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(star: DataFrame) -> tuple:
    """The number of edges and two sums of hashes; equal for equal tables, whatever their order."""
    return tuple(star.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def _large_star(star: DataFrame, n_edges: int) -> DataFrame:
    both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.where("v > u").join(small_or_shuffled(least, 2 * n_edges * ROW_BYTES), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(star: DataFrame, n_edges: int) -> DataFrame:
    least = star.groupBy("u").agg(F.min("v").alias("m"))
    linked = star.join(small_or_shuffled(least, n_edges * ROW_BYTES), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
