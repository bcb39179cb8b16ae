"""Connected components by alternating stars.

A large-star step links each node's larger neighbours to the least node around it, a small-star step does so for the
smaller ones; both keep the components, and in a few rounds every component is a star around its least node. Each
step is an aggregation and a join of plain written tables, which Spark can split where one node has very many links.
Edges that are stars already, as those of most small groups, need no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import drop, scratch


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node is linked to one smaller node and to none else, or to larger ones only."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("child")), F.struct(F.col("b").alias("n"), F.lit(0).alias("child")))).alias("e"))
    seen = ends.groupBy("e.n").agg(F.sum("e.child").alias("up"), F.count("*").alias("all"))
    return seen.where("up > 1 OR (up = 1 AND all > 1)").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.where("b < a")
    least = scratch(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = around.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
    done = scratch(out, "stars")
    drop(least)
    return done


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node that ``edges`` (a, b) names; root is the least node of its component."""
    current = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_stars(current):
        half = _star(current, large=True)
        after = _star(half, large=False)
        drop(half, current)
        current = after
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
