"""Raw CSV tables (S3, S4): renaming, text to numbers and times, and a quarantine for lines that don't parse."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outagelens.functions.text import parse_free, parse_yearless

_CORRUPT = "_corrupt"


@dataclass(frozen=True)
class RawTable:
    """A raw file's columns in order, as (header, name) pairs; ``time`` is parsed by ``parse`` into ``datetime``, others are numbers;
    ``derived`` columns are SQL expressions of these."""

    columns: Sequence[tuple[str, str]]
    time: str
    parse: Callable[[Column], Column]
    derived: dict[str, str] = field(default_factory=dict)

    @property
    def numbers(self) -> list[str]:
        return [name for _, name in self.columns if name != self.time]


def fixed_order(*patterns: str) -> Callable[[Column], Column]:
    """A parser that tries ``patterns`` in this order (a column's day-first or month-first form)."""
    return lambda c: parse_free(c, patterns)


# fixed values: headers of the raw tables
METER_TABLE = RawTable(
    (("Unnamed: 0", "datetime"), ("Solar PV kW", "solar_pv_kw"), ("Total load kW", "total_load_kw"), ("Generators kW", "generators_kw"),
     ("Sterilization kW", "sterilization_kw"), ("Base load kW", "base_load_kw"), ("Grid avail", "grid_available")),
    "datetime", parse_free, {"is_outage": "CAST(1 - grid_available AS INT)"})
SITE_TABLE = RawTable(
    (("Date/Time", "datetime_str"), ("Electricity:Facility [kW](Hourly)", "total_electricity_kw"), ("Fans:Electricity [kW](Hourly)", "fans_kw"),
     ("Cooling:Electricity [kW](Hourly)", "cooling_kw"), ("Heating:Electricity [kW](Hourly)", "heating_kw"),
     ("InteriorLights:Electricity [kW](Hourly)", "lights_kw"), ("InteriorEquipment:Electricity [kW](Hourly)", "equipment_kw"),
     ("Gas:Facility [kW](Hourly)", "total_gas_kw")),
    "datetime_str", lambda c: parse_yearless(c, 2022))


def scan(spark: SparkSession, path: str, table: RawTable) -> DataFrame:
    """All lines: raw texts by name, ``datetime``, numbers, and ``reason`` (null for a good line).

    Reasons, the first that holds: ``columns`` (too many or too few), ``time`` (none, or not to be parsed), ``number:<name>``
    (a text that isn't a number; an empty field is a missing value). A file with other headers fails as a whole."""
    schema = ", ".join(f"`{header}` string" for header, _ in table.columns) + f", {_CORRUPT} string"
    raw = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
           .option("enforceSchema", False).option("columnPruning", False).csv(path))
    texts = raw.select(_CORRUPT, *(F.col(f"`{h}`").alias(f"_{n}") for h, n in table.columns))
    d = texts.withColumn("datetime", table.parse(F.col(f"_{table.time}")))
    d = d.withColumns({n: F.col(f"_{n}").try_cast("double") for n in table.numbers})
    filled = lambda n: F.trim(f"_{n}") != ""
    reason = F.when(F.col(_CORRUPT).isNotNull(), "columns").when(F.col("datetime").isNull(), "time")
    for n in table.numbers:
        reason = reason.when(F.col(n).isNull() & F.coalesce(filled(n), F.lit(False)), f"number:{n}")
    return d.withColumn("reason", reason)


def good_rows(lines: DataFrame, table: RawTable) -> DataFrame:
    """datetime, numbers and derived columns of the lines without a reason."""
    return lines.where("reason is null").select("datetime", *table.numbers).withColumns({c: F.expr(e) for c, e in table.derived.items()})


def quarantine(lines: DataFrame, table: RawTable) -> DataFrame:
    """reason and text (the whole line, or its fields as JSON) of the others."""
    fields = F.to_json(F.struct(*(F.col(f"_{n}").alias(n) for _, n in table.columns)))
    return lines.where("reason is not null").select("reason", F.coalesce(F.col(_CORRUPT), fields).alias("line"))


def report(lines: DataFrame) -> DataFrame:
    """Lines by reason (good ones as ``ok``)."""
    return lines.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n_lines"))
