"""Connected components of an edge table, in rounds of joins with bounded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(a, b) -> (node, root), the root being the component's smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each node links its larger
    neighbours, then its smaller ones, to the smallest node it sees. A round is an aggregate and an
    equi-join and never makes more edges than it had; a node with very many neighbours is spread by
    the adaptive join. The edges are a star around each root once a round changes nothing; the sum of
    the edges' smaller ends and their number tell that. Nodes without edges are not returned.
    """
    stars = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        stars = stage(_small_star(_large_star(stars)), "stars")
        state = stars.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")),
                          F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                stars.select("v", "v").distinct()
            )
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.where("v > u").join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
