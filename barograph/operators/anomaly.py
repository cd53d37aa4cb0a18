"""Anomaly detection on daily series with an isolation forest.

The forest follows Liu, Ting and Zhou, "Isolation Forest", ICDM 2008. Spark
draws the samples, builds one tree per group and scores all rows; trees and
the forest are small tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from barograph.functions.severity import confidence_bin
from barograph.functions.timeparts import day_parts
from barograph.functions.display import fixed
from barograph.operators.filters import existing_columns
from barograph.operators.series import lag_features, zscores
from barograph.operators.trees import walk
from barograph.schemas import ALERT_TYPES, DOMINANT_TYPES

NUMERIC_FEATURES = [
    "total_alerts",
    "severity_score",
    "sentiment_score",
    "word_count",
    "alert_intensity",
    "7_day_avg",
    "30_day_avg",
    "day_over_day_change",
]
LAGS = (1, 2, 3, 7)
MIN_ROWS = 10
EULER = 0.5772156649
NODE = "feature int, threshold double, left int, right int, size int"
NODES = f"array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>"
RESULT_COLUMNS = ["anomaly_score", "is_anomaly", "anomaly_confidence", "anomaly_severity"]


def anomaly_features(
    daily: DataFrame,
    types: Sequence[str] = ALERT_TYPES,
    keys: Sequence[str] = (),
    day: str = "issued_date",
    keep_row: bool = False,
) -> tuple[DataFrame, list[str]]:
    """The feature columns of a daily series and their names; nulls become 0.

    ``keep_row`` carries the whole input row along as the struct ``_row``.
    """
    base = existing_columns(daily, [*NUMERIC_FEATURES, *types])
    if not base:
        raise ValueError("the table has none of the feature columns")
    carried = ["_row"] if keep_row else []
    rows = daily.withColumn("_row", F.struct(*daily.columns)) if keep_row else daily
    out = rows.select(*carried, *keys, day, *base).withColumns(day_parts(F.col(day)))
    names = [*base, *day_parts(F.col(day))]
    if "total_alerts" in base:
        out = zscores(lag_features(out, LAGS, keys=keys, day=day), (7, 30), keys=keys, day=day)
        names += [f"lag_{k}" for k in LAGS] + ["rolling_std_7", "rolling_std_30", "z_score_7", "z_score_30"]
    clean = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in names]
    return out.select(*carried, *keys, day, *clean), names


def average_path(size: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``size`` points."""
    n = np.maximum(np.asarray(size, dtype=float), 3.0)
    usual = 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return np.where(size > 2, usual, np.where(size == 2, 1.0, 0.0))


def _grow_tree(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Random splits until points are alone, equal, or the height limit is reached."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[list] = []
    todo = [(np.arange(len(points)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows)])
        if parent is not None:
            nodes[parent][side] = at
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or len(open_features) == 0:
            continue
        feature = int(rng.choice(open_features))
        threshold = float(rng.uniform(low[feature], high[feature]))
        nodes[at][:2] = [feature, threshold]
        goes_left = points[rows, feature] <= threshold
        todo += [(rows[goes_left], depth + 1, at, 2), (rows[~goes_left], depth + 1, at, 3)]
    return [tuple(n) for n in nodes]


def build_forest(points: DataFrame, keys: Sequence[str], n_rows: int, n_trees: int = 100, max_samples: int = 256, seed: int = 42) -> DataFrame:
    """``(tree_id, sample_size, nodes)`` from rows with a column ``x array<double>``.

    A tree's sample are the rows with the smallest hash of seed, tree and row
    key, so it does not depend on the partitioning. Rows choose their trees
    before they are copied: about three times the sample size reaches a tree.
    """
    sample = min(max_samples, n_rows)
    share = min(1.0, 3.0 * sample / n_rows)
    space = 1 << 53

    def draw(tree):
        return F.pmod(F.xxhash64(F.lit(seed), tree, *keys), F.lit(space))

    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: draw(t) < F.lit(int(share * space)))
    drawn = points.select(*keys, "x", F.explode(trees).alias("tree_id")).select(
        "tree_id", draw(F.col("tree_id")).alias("draw"), "x"
    )

    def build(group: pd.DataFrame) -> pd.DataFrame:
        chosen = group.sort_values("draw").head(sample)
        tree = int(chosen["tree_id"].iloc[0])
        nodes = _grow_tree(np.stack(chosen["x"].to_list()), np.random.default_rng([seed, tree]))
        names = [c.split()[0] for c in NODE.split(", ")]
        return pd.DataFrame(
            {"tree_id": [tree], "sample_size": [len(chosen)], "nodes": [[dict(zip(names, n)) for n in nodes]]}
        )

    schema = f"tree_id int, sample_size int, nodes {NODES}"
    return drawn.groupBy("tree_id").applyInPandas(build, schema)


def path_length(size: Column) -> Column:
    """``average_path`` of a column."""
    usual = 2.0 * (F.ln(size - 1) + EULER) - 2.0 * (size - 1) / size
    return F.when(size > 2, usual).when(size == 2, 1.0).otherwise(0.0)


def score_rows(points: DataFrame, trees: list[Row]) -> DataFrame:
    """Add ``raw``, minus the anomaly score of the paper (lower is more unusual).

    The forest is a single value of at most ``n_trees * (2 * max_samples - 1)`` nodes,
    bounded by the model's parameters, and each row of ``x`` walks it by column
    functions alone.
    """
    sample = max(t["sample_size"] for t in trees)
    depth = math.ceil(math.log2(max(sample, 2)))
    norm = float(average_path(np.array(sample))) or 1.0
    rows = [(i, t["nodes"]) for i, t in enumerate(trees)]
    table = points.sparkSession.createDataFrame(rows, f"tree_id int, nodes {NODES}")
    forest = table.agg(F.sort_array(F.collect_list(F.struct("tree_id", "nodes")))).scalar()

    def add(total: Column, tree: Column) -> Column:
        return total + walk(F.col("x"), tree["nodes"], depth, lambda node, steps: steps + path_length(node["size"]))

    mean_path = F.aggregate("_forest", F.lit(0.0), add) / len(trees)
    return points.withColumn("_forest", forest).withColumn("raw", -F.pow(F.lit(2.0), -mean_path / norm)).drop("_forest")


@dataclass
class AnomalyModel:
    """Scaling, projection, forest and threshold learned from a daily series."""

    features: list[str]
    projection: PipelineModel
    trees: list[Row]
    offset: float
    types: list[str] = field(default_factory=lambda: list(ALERT_TYPES))
    keys: list[str] = field(default_factory=list)
    contamination: float = 0.1
    seed: int = 42

    def predict(self, daily: DataFrame, day: str = "issued_date") -> DataFrame:
        """The series with score, flag, confidence and severity.

        Rows keep their own columns while they are scored, so nothing has to
        be joined back and the series is computed once.
        """
        rows, _ = anomaly_features(daily, self.types, self.keys, day, keep_row=True)
        points = self.projection.transform(rows).select("_row", vector_to_array("selected").alias("x"))
        score = F.col("anomaly_score")
        return (
            score_rows(points, self.trees)
            .select("_row.*", (F.col("raw") - F.lit(self.offset)).alias("anomaly_score"))
            .select("*", (score < 0).alias("is_anomaly"), F.abs(score).alias("anomaly_confidence"))
            .withColumn("anomaly_severity", confidence_bin(F.col("anomaly_confidence")))
        )

    def save(self, path: str) -> None:
        """Write the model below ``path`` in Spark's own formats."""
        spark = SparkSession.active()
        self.projection.write().overwrite().save(f"{path}/projection")
        schema = f"tree_id int, sample_size int, nodes {NODES}"
        spark.createDataFrame(self.trees, schema).write.mode("overwrite").parquet(f"{path}/forest")
        meta = [(self.features, self.offset, self.types, self.keys, self.contamination, self.seed)]
        columns = "features array<string>, offset double, types array<string>, keys array<string>, contamination double, seed int"
        spark.createDataFrame(meta, columns).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AnomalyModel:
        settings = spark.read.parquet(f"{path}/settings").first().asDict()
        trees = spark.read.parquet(f"{path}/forest").orderBy("tree_id").collect()
        return cls(projection=PipelineModel.load(f"{path}/projection"), trees=trees, **settings)


def fit_anomaly_model(
    daily: DataFrame,
    types: Sequence[str] = ALERT_TYPES,
    keys: Sequence[str] = (),
    day: str = "issued_date",
    contamination: float = 0.1,
    n_trees: int = 100,
    max_samples: int = 256,
    variance: float = 0.95,
    seed: int = 42,
) -> AnomalyModel:
    """Learn one pooled model from all series; fewer than 10 rows are an error."""
    rows, names = anomaly_features(daily, types, keys, day)
    rows = rows.persist()
    try:
        n_rows = rows.count()
        if n_rows < MIN_ROWS:
            raise ValueError(f"{n_rows} rows are too few to fit; {MIN_ROWS} are needed")
        assembled = VectorAssembler(inputCols=names, outputCol="assembled")
        scaler = StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True, withStd=True).fit(
            assembled.transform(rows)
        )
        scaled = scaler.transform(assembled.transform(rows))
        pca = PCA(k=len(names), inputCol="scaled", outputCol="components").fit(scaled)
        explained = np.cumsum(pca.explainedVariance.toArray())
        kept = int(np.searchsorted(explained, variance, side="right")) + 1
        slicer = VectorSlicer(inputCol="components", outputCol="selected", indices=list(range(min(kept, len(names)))))
        projection = PipelineModel([assembled, scaler, pca, slicer])
        points = projection.transform(rows).select(*keys, day, vector_to_array("selected").alias("x"))
        trees = build_forest(points, [*keys, day], n_rows, n_trees, max_samples, seed).orderBy("tree_id").collect()
        offset = score_rows(points, trees).agg(F.percentile("raw", F.lit(contamination))).first()[0]
    finally:
        rows.unpersist()
    return AnomalyModel(names, projection, trees, offset, list(types), list(keys), contamination, seed)


def unscored(daily: DataFrame) -> DataFrame:
    """The series with the result columns of a missing model: score 0, nothing flagged."""
    return daily.select(
        "*",
        F.lit(0.0).alias("anomaly_score"),
        F.lit(False).alias("is_anomaly"),
        F.lit(0.0).alias("anomaly_confidence"),
        F.lit("low").alias("anomaly_severity"),
    )


def explain_anomalies(
    anomalies: DataFrame, types: Sequence[str] = DOMINANT_TYPES, keys: Sequence[str] = (), day: str = "issued_date"
) -> DataFrame:
    """One row of reasons for every anomalous day."""
    total = F.col("total_alerts")
    reasons = []
    if "7_day_avg" in anomalies.columns:
        mean = F.col("7_day_avg")
        deviation = F.when(mean > 0, (total - mean) / mean * 100)
        side = F.when(deviation > 0, "Above").otherwise("Below")
        text = F.concat(side, F.lit(" 7-day average by "), fixed(F.abs(deviation), 1), F.lit("%"))
        reasons.append(F.when(F.abs(deviation) > 50, text))
    present = existing_columns(anomalies, types)
    if present:
        best = F.array_max(
            F.array(
                *[
                    F.struct(F.col(t).alias("n"), F.lit(-i).alias("order"), F.lit(t).alias("type"))
                    for i, t in enumerate(present)
                ]
            )
        )
        reasons.append(F.when(best["n"] > 0, F.concat(F.lit("High number of "), best["type"], F.lit(" alerts"))))
    if "severity_score" in anomalies.columns:
        reasons.append(F.when(F.col("severity_score") > 0.7, F.lit("High average alert severity")))
    listed = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    return anomalies.filter("is_anomaly").select(
        *keys,
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        total,
        F.coalesce("anomaly_severity", F.lit("unknown")).alias("severity"),
        F.coalesce("anomaly_confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("Statistical anomaly detected"))).alias("reasons"),
    )
