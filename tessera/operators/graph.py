"""Connected components by contraction, for graphs of any diameter and with hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the smallest node that each node of ``edges`` can reach.

    Each round, every node takes the neighbour (or itself) that comes first in a hashed order, and edges
    are mapped to the nodes taken; hashing makes the rounds few even on sorted chains. Nodes on no edge
    are not returned. Lineage is cut each round by a table in the shared checkpoint folder.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    e = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    # One order for all rounds: the first of a star's nodes stays its centre, whichever node that was before.
    order = lambda c: F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("id"))
    place, left = None, not e.isEmpty()
    while left or place is None:
        taken = cut(e.groupBy("u").agg(F.min(order("v")).alias("m")).select("u", F.least(F.col("m"), order("u"))["id"].alias("to")))
        if place is None:
            place = taken.select(F.col("u").alias("node"), F.col("to").alias("at"))
        else:
            place = place.join(taken.withColumnRenamed("u", "at"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
        if left:
            half = e.join(taken, "u").select(F.col("to").alias("u"), "v")
            e = cut(half.join(taken.withColumnRenamed("u", "v").withColumnRenamed("to", "to_v"), "v").select("u", F.col("to_v").alias("v")).filter("u <> v").distinct())
            left = not e.isEmpty()
    least = place.groupBy("at").agg(F.min("node").alias("component"))
    return place.join(least, "at").select("node", "component")
