"""Model training, calibration and importances on Spark ML (M4, M5, M8, M9); ``search`` runs the grid.

Fits are distributed by Spark ML.  Folds are the expanding time folds of ``splits``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outagelens.operators.calibration import CalibratedEnsemble, fit_calibrated
from outagelens.operators.isotonic import calibrated, isotonic_blocks, knots
from outagelens.operators.splits import N_CALIB_FOLDS, fold_bounds

SEED = 42  # fixed value: random seed of the fits
MAX_NODES = 2_000_000  # nodes of an ensemble that attributions broadcast


def depth_of(max_depth: int) -> int:
    """Spark ML trees have at most 30 levels: -1 (no limit) means 30, a larger number is an error."""
    if max_depth > 30:
        raise ValueError(f"max_depth {max_depth} is above Spark ML's 30")
    return 30 if max_depth == -1 else max_depth


def assembled(cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")


def random_forest(cols: Sequence[str], num_trees: int = 200, max_depth: int = 12, min_leaf: int = 4,
                  weighted: bool = True, bootstrap: bool = True, max_bins: int = 32) -> Pipeline:
    """M4: numTrees / maxDepth / minInstancesPerNode with class weights (weightCol)."""
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=num_trees,
                                maxDepth=depth_of(max_depth), minInstancesPerNode=min_leaf, seed=SEED, bootstrap=bootstrap, maxBins=max_bins,
                                **({"weightCol": "weight"} if weighted else {}))
    return Pipeline(stages=[assembled(cols), rf])


def boosted_trees(cols: Sequence[str], rounds: int = 300, max_depth: int = 8, rate: float = 0.1,
                  subsample: float = 0.8, colsample: float = 0.8, weighted: bool = True, max_bins: int = 32) -> Pipeline:
    """M5: histogram-style boosted trees; Spark samples columns per node (featureSubsetStrategy)."""
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth_of(max_depth),
                        stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=str(colsample), maxBins=max_bins, seed=SEED,
                        **({"weightCol": "weight"} if weighted else {}))
    return Pipeline(stages=[assembled(cols), gbt])


def scored(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Positive-class probability as a double column ``score``."""
    p = model.transform(df)
    return p.select(*keep, "label", vector_to_array("probability")[1].alias("score"))


def fold_frames(train: DataFrame, n_splits: int):
    """(train rows, test rows) of each expanding fold: ranges of ``row_idx``, so no row is copied."""
    n = train.agg(F.max("row_idx")).first()[0]
    for lo, hi in fold_bounds(0 if n is None else n + 1, n_splits):
        yield train.where(F.col("row_idx") < lo), train.where((F.col("row_idx") >= lo) & (F.col("row_idx") < hi))


def calibrated_ensemble(train: DataFrame, pipe: Pipeline, n_splits: int = N_CALIB_FOLDS) -> CalibratedEnsemble:
    """M8: for each expanding fold, the model fitted on the fold's train rows and an isotonic map fitted on its test
    scores; the ensemble's probability is the mean over folds of iso_k(model_k(x))."""
    return fit_calibrated(fold_frames(train, n_splits), pipe)


def isotonic_fit(df: DataFrame, x: str = "score", y: str = "label") -> DataFrame:
    """Isotonic (non-decreasing) fit of y on x; one row per distinct x with its number of rows and the fitted value."""
    pts = df.groupBy(x).agg(F.count(F.lit(1)).alias("n"))
    return calibrated(pts, *knots(isotonic_blocks(df, x, y)), score=x, out="fitted")


def save_load(model: PipelineModel, path: str) -> PipelineModel:
    """Persist with Spark ML and read back."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def importances(model: PipelineModel, cols: Sequence[str]) -> DataFrame:
    """M9: the fitted ensemble's feature importances as (feature, importance); size = feature count."""
    from pyspark.sql import SparkSession
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(list(zip(cols, imp)), "feature string, importance double")


def tree_table(model_path: str, spark, forest: bool = False) -> pd.DataFrame:
    """Node table of a saved tree ensemble (treeID, id, prediction, left, right, feature, threshold)
    with tree weights and covers (rows of a node); its size is bounded by the model (trees x 2^depth), not by the data, and checked.

    A node's value is its prediction in boosted trees, whose trees are regressions; in a ``forest`` of classification
    trees it is the share of positives by the node's impurity statistics, and trees weigh 1 / number of trees."""
    stats = F.col("nodeData.impurityStats")
    value = F.get(stats, 1) / F.aggregate(stats, F.lit(0.0), lambda a, b: a + b) if forest else F.col("nodeData.prediction")
    nodes = spark.read.parquet(f"{model_path}/stages/1_*/data").select(
        "treeID", "nodeData.id", value.alias("prediction"), "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("threshold"), F.col("nodeData.rawCount").alias("cover"))
    # tree metadata is stored as (treeID, params json, weight)
    meta = spark.read.parquet(f"{model_path}/stages/1_*/treesMetadata").select(
        F.col("_1").alias("treeID"), F.col("_3").alias("weights"))
    out = nodes.limit(MAX_NODES + 1).toPandas()
    if len(out) > MAX_NODES:
        raise ValueError(f"the ensemble has over {MAX_NODES} nodes, the most that are taken")
    out = out.merge(meta.toPandas(), on="treeID")
    if forest:
        out["weights"] = 1.0 / out["treeID"].nunique()
    return out


def path_attributions(df: DataFrame, keys: Sequence[str], cols: Sequence[str], nodes: pd.DataFrame) -> DataFrame:
    """Per-row path contributions of a tree ensemble (additive: base + sum = margin).

    The node table is broadcast; rows are processed in Arrow batches by ``mapInPandas``.
    """
    spark = df.sparkSession
    trees = {}
    for tid, g in nodes.groupby("treeID"):
        g = g.set_index("id").sort_index()
        trees[int(tid)] = (float(g["weights"].iloc[0]), g["prediction"].to_numpy(float),
                           g["leftChild"].to_numpy(int), g["rightChild"].to_numpy(int),
                           g["feature"].to_numpy(int), g["threshold"].to_numpy(float))
    bc = spark.sparkContext.broadcast(trees)
    nf = len(cols)
    keys = list(keys)

    def run(batches):
        tr = bc.value
        for pdf in batches:
            x = pdf[list(cols)].to_numpy(float)
            n = len(pdf)
            contrib = np.zeros((n, nf))
            base = np.zeros(n)
            for w, pred, left, right, feat, thr in tr.values():
                node = np.zeros(n, dtype=int)
                base += w * pred[0]
                active = left[node] >= 0
                while active.any():
                    idx = np.where(active)[0]
                    nd = node[idx]
                    go_left = x[idx, feat[nd]] <= thr[nd]
                    child = np.where(go_left, left[nd], right[nd])
                    np.add.at(contrib, (idx, feat[nd]), w * (pred[child] - pred[nd]))
                    node[idx] = child
                    active = left[node] >= 0
            out = pdf[keys].loc[np.repeat(np.arange(n), nf)].reset_index(drop=True)
            out["feature"] = np.tile(np.array(cols, dtype=object), n)
            out["contribution"] = contrib.reshape(-1)
            out["base_value"] = np.repeat(base, nf)
            yield out

    schema = df.select(*keys).schema.add("feature", "string").add("contribution", "double") \
        .add("base_value", "double")
    return df.select(*keys, *cols).mapInPandas(run, schema)


def member_importances(model: PipelineModel, cols: Sequence[str]) -> DataFrame:
    """Per-tree importances (member, feature, importance) of a fitted ensemble; size = trees x features."""
    from pyspark.sql import SparkSession
    rows = [(t, f, float(v)) for t, tree in enumerate(model.stages[-1].trees)
            for f, v in zip(cols, tree.featureImportances.toArray().tolist())]
    return SparkSession.getActiveSession().createDataFrame(rows, "member int, feature string, importance double")
