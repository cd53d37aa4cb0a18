"""Decision trees as tables, walked by column functions.

A tree is an array of nodes ``(feature, threshold, left, right, …)``; a leaf has
feature -1. Children are places in the array, the root is the first node.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.session import scratch_dir


def walk(x: Column, nodes: Column, depth: int, found: Callable[[Column, Column], Column]) -> Column:
    """``found(node, steps)`` of the node that ``x array<double>`` reaches in a tree of at most ``depth`` levels."""
    root = F.struct(F.lit(0).alias("at"), F.lit(0).alias("steps"))

    def step(state: Column, _: Column) -> Column:
        node = F.get(nodes, state["at"])
        below = F.when(F.get(x, node["feature"]) <= node["threshold"], node["left"]).otherwise(node["right"])
        inner = node["feature"] >= 0
        return F.struct(F.when(inner, below).otherwise(state["at"]).alias("at"), (state["steps"] + inner.cast("int")).alias("steps"))

    levels = F.sequence(F.lit(1), F.lit(max(depth, 1)))
    return F.aggregate(levels, root, step, lambda state: found(F.get(nodes, state["at"]), state["steps"]))


def boosted_prediction(x: Column, trees: Column, depth: int) -> Column:
    """Weighted sum of the leaves that ``x`` reaches in ``trees`` (``boosted_trees``)."""

    def add(total: Column, tree: Column) -> Column:
        return total + tree["weight"] * walk(x, tree["nodes"], depth, lambda node, _: node["value"])

    return F.aggregate(trees, F.lit(0.0), add)


def boosted_trees(spark: SparkSession, models: Sequence[tuple[tuple, GBTRegressionModel]], names: str) -> DataFrame:
    """One row per model: its label, columns ``names``, and ``trees array<struct<tree,weight,nodes>>``.

    The models are written in their own format and read back as tables, so no node
    passes the driver. The table is bounded by the number of models, trees and nodes.
    """
    base = scratch_dir(spark, "models")
    for i, (_, model) in enumerate(models):
        model.write().overwrite().save(f"{base}/model={i}")
    labels = spark.createDataFrame(
        [(i, *label, list(map(float, model.treeWeights))) for i, (label, model) in enumerate(models)], f"model int, {names}, weights array<double>"
    )
    stored = spark.read.option("basePath", base).parquet(*[f"{base}/model={i}/data" for i in range(len(models))])
    n = F.col("nodeData")
    node = F.struct(
        n["id"].alias("id"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
        n["leftChild"].alias("left"),
        n["rightChild"].alias("right"),
        n["prediction"].alias("value"),
    )
    trees = stored.groupBy("model", "treeID").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    weighted = trees.join(labels, "model").withColumn("tree", F.struct(F.col("treeID"), F.get("weights", F.col("treeID")).alias("weight"), "nodes"))
    return weighted.groupBy(*[c for c in labels.columns if c not in ("model", "weights")]).agg(F.sort_array(F.collect_list("tree")).alias("trees"))
