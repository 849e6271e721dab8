"""Parquet scans of the input tables (explicit column lists keep ReadSchema narrow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema, header: bool = True) -> DataFrame:
    """Typed CSV scan (S1, S11): explicit schema, FAILFAST - a file that does not parse
    (an HTML error page or a "404" text saved with a .csv name) fails instead of loading junk."""
    return (spark.read.schema(schema).option("header", header).option("mode", "FAILFAST")
            .option("enforceSchema", False).csv(path))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature-table reader with an explicit missing-table error."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"feature table not found: {path}; run the feature pipeline first") from e
        raise
