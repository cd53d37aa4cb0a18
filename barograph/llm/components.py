"""Connected components of links between integer ids, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import release, stored


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """Link neighbours of every node to the least of them.

    The large star moves the greater neighbours, the small star the node and its
    lesser neighbours. A node with very many neighbours is a frequent join key,
    which adaptive execution splits; nothing gathers its neighbours in one place.
    """
    if small:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        moved = pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node with a greater end ``a`` has one lesser end ``b``, that has none itself.

    Another round of stars would change nothing then, at several times the tasks of this one aggregation.
    """
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    of_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not of_node.agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node with a link; component is the least node reachable.

    ``edges`` has two long columns ``a`` and ``b``, in any direction, repeated or
    not; links of a node to itself and to null are ignored. Alternates large and
    small stars until all links lead to the least node; each round is stored, so a
    lost executor costs a round.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(links.distinct(), "links")
    while not _settled(current):
        moved = stored(_starred(_starred(current, small=False), small=True), "stars")
        release(current)
        current = moved
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
