"""The end-to-end batch plan over the bound tables.

readings -> hourly grid (A1 + W12) -> nearest weather (J1) -> country context (J2)
-> stage context (J3) -> calendar (D4) -> gap fill (W9, W10) -> features (F1-F5, P14).
Catalyst plans the chain. The hours with a reading are written once, as the gap fill reads them three times; empty hours are made
by the fill, from what is known on both sides, so they are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from outagelens.functions.numeric import rnd
from outagelens.functions.timefmt import hour_ts_from_index
from outagelens.operators.asof import asof_nearest, asof_nearest_grid
from outagelens.operators.blocked import HALO_BLOCK, IS_HALO
from outagelens.operators.context import add_reliability_context, add_stage_context
from outagelens.operators.features import HALO_HOURS, calendar_features, feature_table
from outagelens.operators.fill import gap_fill
from outagelens.operators.resample import hourly_grid, hourly_spans, known_hours
from outagelens.sources import bindings
from outagelens.sources.tables import read_table

HOUR_US = 3_600_000_000
POWER_COLUMNS = ["solar_pv_kw", "total_load_kw", "generators_kw", "sterilization_kw", "base_load_kw"]


def site_grid(spark: SparkSession, sf_dir: str, site_columns: DataFrame | None = None) -> DataFrame:
    """Gap-free hourly grid of the meter readings, empty hours null (per-site columns ride along)."""
    return hourly_grid(bindings.meter_readings(spark, sf_dir), site_columns=site_columns)


def filled_grid(spark: SparkSession, sf_dir: str, fill: str = "carry", halo: int = 0) -> DataFrame:
    return filled_from(bindings.meter_readings(spark, sf_dir), None, None, fill, halo)


def filled_from(readings: DataFrame, weather: DataFrame | None, site_columns: DataFrame | None, fill: str = "carry", halo: int = 0) -> DataFrame:
    """The filled hourly grid of the readings with their nearest weather, if any, and the columns of their site."""
    linear, carry = fill_columns(bindings.WEATHER_COLUMNS if weather is not None else [], fill)
    spans = hourly_spans(readings, site_columns=site_columns)
    known = known_hours(readings, spans, nearest_weather(weather) if weather is not None else None)
    d = gap_fill(_fillable(known, fill), ["site_id"], "hidx", linear=linear, carry=carry, halo=halo, spans=spans)
    context = [c for c in site_columns.columns if c != "site_id"] if site_columns is not None else []
    measures = [c for c in known.columns if c not in ("site_id", "hidx")]
    made = [c for c in d.columns if c not in ("site_id", "hidx", *context, *measures)]
    return d.select("site_id", "hidx", *context, hour_ts_from_index("hidx").alias("hour_ts"), *measures, *made)


def nearest_weather(weather: DataFrame) -> DataFrame:
    """Nearest weather reading within 1 h of every hour that has one (J1, grid specialisation)."""
    return asof_nearest_grid(weather, by=["site_id"], right_on="ts", step_us=HOUR_US, tolerance_us=HOUR_US,
                             right_cols=bindings.WEATHER_COLUMNS, right_order="seq")


def with_weather(grid: DataFrame, weather: DataFrame) -> DataFrame:
    """The grid with ``nearest_weather``."""
    return grid.join(nearest_weather(weather), ["site_id", "hidx"], "left")


def with_weather_general(grid: DataFrame, weather: DataFrame) -> DataFrame:
    """Same result through the general as-of plan (irregular left sides)."""
    return asof_nearest(grid, weather, on="hour_ts", by=["site_id"], tolerance_us=HOUR_US,
                        right_cols=bindings.WEATHER_COLUMNS, right_order="seq", right_on="ts")


def site_context(spark: SparkSession, sf_dir: str, facts: bool = True) -> DataFrame:
    """One row per site: country and latest reliability (J2 at site grain, joined once onto the grid)."""
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).select(
        F.col("c_custkey").alias("site_id"), F.col("c_nationkey").alias("country_code"))
    return add_reliability_context(cust, bindings.country_facts(spark, sf_dir) if facts else None)


def merged_table(spark: SparkSession, sf_dir: str, facts: bool = True, stages: bool = True,
                 weather: bool = True, fill: str = "carry", halo: int = 0) -> DataFrame:
    """F8.  Per-site constants (country, latest reliability, the one-row stage statistics) are attached
    to the per-site bounds the hours are generated from: one row per site instead of a join on the
    hourly table, and no part of the gap fill.  Each of the three context
    sources may be absent (S15).  ``fill``: see ``fill_columns``; ``halo``: see ``gap_fill``."""
    ctx = site_context(spark, sf_dir, facts)
    ctx = add_stage_context(ctx, bindings.stage_history(spark, sf_dir) if stages else None)
    return merged_from(bindings.meter_readings(spark, sf_dir), ctx, bindings.weather_readings(spark, sf_dir) if weather else None, fill, halo)


def merged_from(meters: DataFrame, sites: DataFrame, weather: DataFrame | None, fill: str = "carry", halo: int = 0) -> DataFrame:
    """The merged table from meter readings, per-site constants and weather readings, if any."""
    g = filled_from(meters, weather, sites, fill, halo)
    g = g.withColumn("who_reliability_pct", F.coalesce(F.col("who_reliability_pct"), F.lit(50.0)))
    made = [c for c in (HALO_BLOCK, IS_HALO) if c in g.columns]
    g = calendar_features(g)
    return g.select(*(c for c in g.columns if c not in made), *made)


def fill_columns(weather: list[str], fill: str) -> tuple[list[str], list[str]]:
    """(columns filled linearly, columns carried on). With ``carry`` an empty hour has the flag of the hour before; with
    ``reference`` the outage flag is interpolated like any number."""
    if fill not in ("carry", "reference"):
        raise ValueError(f"unknown fill {fill!r}")
    linear = [*POWER_COLUMNS, "grid_availability_ratio", *weather]
    return (linear, ["is_outage"]) if fill == "carry" else ([*linear, "is_outage"], [])


def _fillable(grid: DataFrame, fill: str) -> DataFrame:
    """Interpolated flags are fractions."""
    return grid if fill == "carry" else grid.withColumn("is_outage", F.col("is_outage").cast("double"))


def tolerant_features(spark: SparkSession, meters: DataFrame, weather: DataFrame | None, facts: DataFrame | None,
                      stages: DataFrame | None, sites: DataFrame) -> DataFrame:
    """O1: the feature table of whatever sources there are; absent ones leave their defaults."""
    ctx = add_stage_context(add_reliability_context(sites, facts), stages)
    return feature_table(merged_from(meters, ctx, weather, halo=HALO_HOURS), absent_defaults=weather is None)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(merged_table(spark, sf_dir, halo=HALO_HOURS))


def round_doubles(df: DataFrame, n: int = 6) -> DataFrame:
    """Round every floating column half-up to ``n`` digits (portable with the SQL oracle)."""
    return df.withColumns({f.name: rnd(F.col(f.name), n) for f in df.schema.fields
                           if isinstance(f.dataType, (DoubleType, FloatType))})
