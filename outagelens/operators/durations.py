"""Outage-duration regression: runs as labelled rows, a chronological split, fits and residual statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outagelens.functions.timefmt import calendar_columns, hour_ts_from_index
from outagelens.operators.splits import temporal_split
from outagelens.operators.training import SEED, assembled, depth_of

#: what is known when an outage begins
INPUTS = ["hour", "day_of_week", "month", "load_kw", "hours_since_last"]


def labelled_runs(runs: DataFrame, hourly: DataFrame, key: str = "site_id") -> DataFrame:
    """A row for each run (key, first, last, length): its length as ``label`` and what is known at its first hour.

    ``hours_since_last`` counts from the end of the site's run before; the first run of a site has 0."""
    order = Window.partitionBy(key).orderBy("first")  # a row for each run
    d = runs.withColumn("hours_since_last", F.coalesce(F.col("first") - F.lag("last").over(order), F.lit(0)).cast("double"))
    d = d.join(hourly.select(key, F.col("hidx").alias("first"), F.coalesce("total_load_kw", F.lit(0.0)).alias("load_kw")), [key, "first"], "left")
    d = d.withColumns(calendar_columns(hour_ts_from_index(F.col("first"))))
    return d.select(key, "first", F.col("length").cast("double").alias("label"), *(F.col(c).cast("double").alias(c) for c in INPUTS))


def split_runs(rows: DataFrame, key: str = "site_id") -> tuple[DataFrame, DataFrame]:
    """The first 80 % of all runs in order of their start, and the rest."""
    d = temporal_split(rows, ["first", key])
    return d.where("split = 'train'"), d.where("split = 'test'")


def boosted_durations(cols: Sequence[str] = INPUTS, rounds: int = 50, max_depth: int = 4, rate: float = 0.1) -> Pipeline:
    return Pipeline(stages=[assembled(cols), GBTRegressor(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth_of(max_depth),
                                                          stepSize=rate, seed=SEED)])


def tree_durations(cols: Sequence[str] = INPUTS, max_depth: int = 4, max_bins: int = 32) -> Pipeline:
    return Pipeline(stages=[assembled(cols), DecisionTreeRegressor(labelCol="label", featuresCol="features", maxDepth=depth_of(max_depth),
                                                                   maxBins=max_bins, seed=SEED)])


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """label and prediction; an outage lasts an hour at least."""
    return model.transform(rows).select("label", F.greatest("prediction", F.lit(1.0)).alias("prediction"))


def residual_stats(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, rmse, mae, r2, bias and the 10, 50 and 90 % quantiles of label - prediction, in one aggregate."""
    e = F.col("label") - F.col("prediction")
    sse, mean = F.sum(e * e), F.avg("label")
    spread = F.sum(F.col("label") * F.col("label")) - F.count("*") * mean * mean
    quantile = lambda q: F.percentile(e, F.lit(q))
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(sse, spread)).alias("r2"), F.avg(e).alias("bias"),
        quantile(0.1).alias("p10"), quantile(0.5).alias("p50"), quantile(0.9).alias("p90"))
