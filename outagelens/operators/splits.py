"""Leak-safe time splits.

The chronological row index comes from ``sequence_number`` (numbering inside
range partitions plus their offsets), so a global order never funnels all rows
through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outagelens.operators.blocked import sequence_number

TEST_SIZE = 0.2  # fixed value: hold-out fraction
N_FOLDS = 5  # fixed value: expanding-window folds for model selection
N_CALIB_FOLDS = 3  # fixed value: expanding-window folds for calibration


def chronological_index(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "row_idx") -> DataFrame:
    return sequence_number(df, list(keys), list(order), name)


def _with_total(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    n = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.count(F.lit(1)).alias("n_rows"))
    if keys:
        return df.join(n, keys, "left")
    return df.crossJoin(F.broadcast(n))  # one row


def temporal_split(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
                   test_size: float = TEST_SIZE) -> DataFrame:
    """First floor(n * (1 - test_size)) rows in time are 'train', the rest 'test' (M1)."""
    d = _with_total(chronological_index(df, order, keys), keys)
    cut = F.floor(F.col("n_rows") * F.lit(1.0 - test_size))
    return d.withColumn("split", F.when(F.col("row_idx") < cut, "train").otherwise("test"))


def fold_bounds(n_rows: int, n_splits: int = N_FOLDS) -> list[tuple[int, int]]:
    """(first test row, end of the test rows) of each expanding fold; the rows before are its train rows."""
    t = n_rows // (n_splits + 1)
    return [(n_rows - (n_splits - i) * t, n_rows - (n_splits - i - 1) * t) for i in range(n_splits)]


def expanding_folds(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
                    n_splits: int = N_FOLDS) -> DataFrame:
    """Expanding-window folds (M2): test size n // (k+1); fold i tests rows
    [n - (k-i) t, n - (k-i-1) t) and trains on every row before.  One output row per
    (row, fold, role); rows before the first test block appear once per fold as train.
    """
    d = _with_total(chronological_index(df, order, keys), keys)
    t = F.floor(F.col("n_rows") / F.lit(n_splits + 1))
    memberships = F.array(*[
        F.struct(F.lit(i).alias("fold"),
                 F.when(F.col("row_idx") < F.col("n_rows") - F.lit(n_splits - i) * t, "train")
                 .when(F.col("row_idx") < F.col("n_rows") - F.lit(n_splits - i - 1) * t, "test").alias("role"))
        for i in range(n_splits)])
    d = d.withColumn("_m", F.explode(F.filter(memberships, lambda m: m["role"].isNotNull())))
    return d.withColumn("fold", F.col("_m.fold").cast("int")).withColumn("role", F.col("_m.role")).drop("_m")


def class_weights(df: DataFrame, label: str = "label", pos_weight: float | None = None,
                  multiplier: float = 1.0) -> DataFrame:
    """weightCol for Spark ML (M3): positives weigh ``pos_weight`` (default round(multiplier / positive rate))."""
    if pos_weight is None:
        rate = df.agg(F.avg(F.col(label).cast("double")).alias("_rate"))
        w = F.round(F.lit(multiplier) / F.col("_rate")).cast("double")
        d = df.crossJoin(F.broadcast(rate.select(w.alias("_w"))))  # one row
        return d.withColumn("weight", F.when(F.col(label) == 1, F.col("_w")).otherwise(F.lit(1.0))).drop("_w")
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))
