"""Connected components of an edge list, by alternating large-star and small-star steps.

Both steps are grouped minima over the edges, joined back to them row by row, so no component is
gathered; every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``root`` (the least node reachable) for every node of ``edges`` (columns ``u``, ``v``, longs)."""
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while True:
        # each star deals its edges by node once; sums and joins by that node need no other shuffle
        # large star: the larger neighbours of a node, with its least neighbour (itself included); a node with both kinds is a change
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u"))).repartition("u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("changed"))
        # small star: the smaller neighbours of a node, and itself, with the least of them; more than one is a change
        small = large.repartition("u")
        low = small.groupBy("u").agg(F.min("v").alias("m"))
        changed = (F.col("changed") | (F.col("v") != F.col("m"))).alias("changed")
        new = small.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v"), changed), F.struct(F.col("v").alias("u"), F.col("m").alias("v"), changed))).alias("e"))
        now = written(new.select("e.*").where("u != v").groupBy("u", "v").agg(F.max("changed").alias("changed")), name)
        if now.where("changed").isEmpty():  # every node had one neighbour, a root
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
