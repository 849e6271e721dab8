"""A fixed-weight logistic scorer over feature columns, with exact attributions.

It stands in for a fitted model where a query must stay SQL-checkable: the
probability is sigmoid(b + sum w_i x_i), and the attribution of feature i for a
row is w_i (x_i - mean(x_i)) in log-odds, with base value b + sum w_i mean(x_i).
Contributions plus base equal the row's log-odds exactly (additivity).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: weights of the stand-in risk scorer over feature-table columns
RISK_WEIGHTS = {
    "load_std_24h": 0.01,
    "peak_ratio": 0.8,
    "solar_ratio": -1.2,
    "base_load_ratio": -0.6,
    "temp_humidity_interaction": 0.02,
    "heat_stress": 0.5,
    "hour_sin": 0.3,
    "is_weekend": -0.2,
}
RISK_INTERCEPT = -1.5


def logit(df_cols: Mapping[str, float] = RISK_WEIGHTS, intercept: float = RISK_INTERCEPT) -> Column:
    z = F.lit(float(intercept))
    for c, w in df_cols.items():
        z = z + F.lit(float(w)) * F.col(c).cast("double")
    return z


def probability(weights: Mapping[str, float] = RISK_WEIGHTS, intercept: float = RISK_INTERCEPT) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit(weights, intercept)))


def logit_sql(weights: Mapping[str, float] = RISK_WEIGHTS, intercept: float = RISK_INTERCEPT) -> str:
    z = f"CAST({float(intercept)!r} AS DOUBLE)"
    for c, w in weights.items():
        z = f"({z} + CAST({float(w)!r} AS DOUBLE) * CAST({c} AS DOUBLE))"
    return z


def probability_sql(weights: Mapping[str, float] = RISK_WEIGHTS, intercept: float = RISK_INTERCEPT) -> str:
    return f"(1.0 / (1.0 + exp(-{logit_sql(weights, intercept)})))"


def mean_abs_attributions(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(feature, mean_abs_contribution) over all rows: one aggregate per column, then one row is unpivoted."""
    feats = list(weights)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_mu_{c}") for c in feats])
    one = df.select(*feats).crossJoin(F.broadcast(means)).agg(*[
        F.avg(F.abs(F.lit(float(weights[c])) * (F.col(c).cast("double") - F.col(f"_mu_{c}")))).alias(c) for c in feats])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs_contribution")) for c in feats])))


def attributions(df: DataFrame, keys: Sequence[str], weights: Mapping[str, float],
                 intercept: float = 0.0, background: DataFrame | None = None) -> DataFrame:
    """Long table (keys..., feature, value, contribution) plus the base value per row.

    Feature means are taken over ``background`` (default: ``df``); they are one global aggregate
    row (size-bounded) crossed onto the rows.
    """
    keys = list(keys)
    feats = list(weights)
    means = (df if background is None else background).agg(*[F.avg(F.col(c).cast("double")).alias(f"_mu_{c}") for c in feats])
    base = F.lit(float(intercept))
    for c in feats:
        base = base + F.lit(float(weights[c])) * F.col(f"_mu_{c}")
    d = df.select(*keys, *feats).crossJoin(F.broadcast(means)).withColumn("base_value", base)
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                               (F.lit(float(weights[c])) * (F.col(c).cast("double") - F.col(f"_mu_{c}")))
                               .alias("contribution")) for c in feats])
    return d.select(*keys, "base_value", F.inline(items))
