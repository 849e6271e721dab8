"""Schema-driven column work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outagelens.operators.features import numeric_columns

# fixed values: columns excluded from model inputs (leaking or constant on one series) and the target
EXCLUDED = [
    "datetime", "is_outage", "grid_availability_ratio", "generators_kw", "generator_active", "generator_ratio",
    "grid_availability_rolling_6h", "recent_outages_6h", "recent_outages_24h", "storm_risk",
    "loadshed_avg_stage", "loadshed_max_stage", "loadshed_pct_active", "who_reliability_pct", "reliability_risk",
]
TARGET = "is_outage"
ID_COLUMNS = ["site_id", "hidx", "hour_ts", "country_code"]


def feature_columns(df: DataFrame, exclude: Sequence[str] = EXCLUDED, ids: Sequence[str] = ID_COLUMNS) -> list[str]:
    """Numeric columns minus exclusions and ids (P8, P9), in table order."""
    return [c for c in numeric_columns(df) if c not in set(exclude) and c not in set(ids)]


def feature_matrix(df: DataFrame, keys: Sequence[str] = ("site_id", "hidx")) -> DataFrame:
    """keys + model inputs + integer label."""
    return df.select(*keys, *feature_columns(df), F.col(TARGET).cast("int").alias("label"))


def align_schema(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), fill: float = 0.0) -> DataFrame:
    """Add absent columns as a constant and put columns in the given order (P10)."""
    have = set(df.columns)
    return df.select(*keys, *[F.col(c) if c in have else F.lit(fill).alias(c) for c in columns])


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: null count per column and the total."""
    cols = list(columns or df.columns)
    counts = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"nulls_{c}") for c in cols]
    total = F.lit(0)
    for c in cols:
        total = total + F.col(f"nulls_{c}")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *counts).withColumn("nulls_total", total.cast("long"))
