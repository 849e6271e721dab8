"""Sinks (S2, S10, S16, S17): partitioned parquet and JSON summaries in the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outagelens.session import checkpoint_dir


MAX_RECORDS = 5_000_000  # rows of one file
BUCKETS, BUCKET = 64, "_bucket"  # folders of a bucketed table, and the column they are named by


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` (never a machine-local temp folder on a cluster)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet") -> str:
    """One folder per key (replaces one file per site); overwrites.

    Rows are rebalanced by key first, so a key's rows are in few tasks (many, if it is hot) and files stay few."""
    (df.hint("rebalance", *by).write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS)
     .partitionBy(*by).format(fmt).save(path))
    return path


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS, fmt: str = "parquet") -> str:
    """Rows of a key together, in one of ``buckets`` folders by a hash of it: for keys without a bound, a folder each would be
    millions of them. The key stays a column; overwrites."""
    d = df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    (d.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, key).write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS)
     .partitionBy(BUCKET).format(fmt).save(path))
    return path


def read_bucketed(spark: SparkSession, path: str, key: str, values: Sequence | None = None, buckets: int = BUCKETS,
                  fmt: str = "parquet") -> DataFrame:
    """The rows of ``write_bucketed``; with ``values`` only those keys, from their folders alone."""
    d = spark.read.format(fmt).load(path)
    if values is not None:
        kind = d.schema[key].dataType
        wanted = [F.lit(v).cast(kind) for v in values]
        d = d.where(F.col(BUCKET).isin([F.pmod(F.xxhash64(v), F.lit(buckets)).cast("int") for v in wanted])).where(F.col(key).isin(wanted))
    return d.drop(BUCKET)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_attributions(attr: DataFrame, path: str, by: Sequence[str] = ("feature",)) -> str:
    """Attribution matrix sink (S18) in long format (row keys, feature, value, contribution, base)."""
    return write_partitioned(attr, path, list(by))
