"""Connected components of an edge table by alternating large-star and small-star steps.

Everything stays in DataFrames; each round is written to the shared folder, so neither lineage nor any executor holds
state, and the number of rounds grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.joins import join_by_size
from opinara.session import cut_lineage

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, n): the least of u and its neighbours in ``edges`` (u, v), and their number."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # A hub, such as the centre of a star, is a key with all its neighbours.
    return join_by_size(both, _least(both), ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = join_by_size(down, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex u that isn't its component's least vertex; ``edges`` has columns u and v."""
    now = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        # Done when every vertex has one edge and no target has an edge of its own: a forest of stars.
        many = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        chained = now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u").limit(1)
        if not many.select("u").unionAll(chained).take(1):
            return now.select("u", F.col("v").alias("root"))
        now = cut_lineage(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
