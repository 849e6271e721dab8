"""JSON documents to rows (S7-S9, N1): array-of-records and object-of-parallel-arrays.

Documents are parsed with explicit schemas (``from_json``), exploded with
``inline`` - each document is flattened inside its own row, nothing is grouped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# fixed values: record fields kept from the reliability API and their engine names
RECORD_FIELDS = {
    "SpatialDim": "country_code",
    "TimeDim": "year",
    "Dim1": "area_type",
    "NumericValue": "reliability_pct",
    "ParentLocationCode": "region_code",
    "ParentLocation": "region",
}
AREA_PREFIX = "RESIDENCEAREATYPE_"


def records_to_rows(df: DataFrame, doc: str, record_schema: StructType, keep: Sequence[str] | None = None,
                    carry: Sequence[str] = ()) -> DataFrame:
    """``{"value": [ {...}, ... ]}`` -> one row per record (only ``keep`` fields)."""
    schema = StructType().add("value", ArrayType(record_schema))
    parsed = df.select(*carry, F.from_json(F.col(doc), schema).alias("_d"))
    rows = parsed.select(*carry, F.inline(F.col("_d.value")))
    return rows.select(*carry, *(keep or [f.name for f in record_schema.fields]))


def arrays_to_rows(df: DataFrame, doc: str, arrays_schema: StructType, field: str = "hourly",
                   carry: Sequence[str] = ()) -> DataFrame:
    """``{"hourly": {"time": [...], "x": [...], ...}}`` -> one row per position (arrays_zip + inline)."""
    schema = StructType().add(field, arrays_schema)
    parsed = df.select(*carry, F.from_json(F.col(doc), schema).alias("_d"))
    names = [f.name for f in arrays_schema.fields]
    zipped = F.arrays_zip(*[F.col(f"_d.{field}.{n}").alias(n) for n in names])
    return parsed.select(*carry, F.inline(zipped))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def clean_area(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit(AREA_PREFIX), F.lit("")))
