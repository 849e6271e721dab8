"""Context joins: latest fact lookup with default (J2), one-row statistics onto every row (J3),
positional zip (J4), coverage anti join (J9), dimension lookups with defaults (J7, J8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outagelens.functions.numeric import rnd
from outagelens.operators.blocked import sequence_number

DEFAULT_RELIABILITY = 50.0  # fixed value: reliability used when a country has no fact
# fixed values: profile fields of a site that has none
PROFILE_DEFAULTS = {"who_reliability": 50.0, "grid_stability": "moyen", "avg_load_kw": 133.0}


def latest_fact(facts: DataFrame, key: str = "country_code", area: str = "totl") -> DataFrame:
    """Newest-year reliability per country for one area type."""
    return (facts.filter(F.col("area_type") == area)
            .groupBy(key)
            .agg(F.max_by("reliability_pct", "year").alias("who_reliability_pct"),
                 F.max("year").alias("who_year")))


def add_reliability_context(df: DataFrame, facts: DataFrame | None, key: str = "country_code",
                            default: float = DEFAULT_RELIABILITY) -> DataFrame:
    """Attach the latest reliability per row's country; default when the country (or the table) is missing.

    The per-country table has one row per country; it is joined with AQE choosing
    broadcast only when its runtime size is under the broadcast threshold.
    """
    if facts is None:
        return df.withColumn("who_reliability_pct", F.lit(default))
    latest = latest_fact(facts, key).select(key, "who_reliability_pct")
    return (df.join(latest, key, "left")
            .withColumn("who_reliability_pct", F.coalesce(F.col("who_reliability_pct"), F.lit(default))))


def stage_stats(history: DataFrame) -> DataFrame:
    """One row: mean stage (2 digits), max stage, share of active events (4 digits)."""
    s = F.col("stage")
    return history.agg(
        rnd(F.avg(s), 2).alias("loadshed_avg_stage"),
        F.max(s).cast("int").alias("loadshed_max_stage"),
        rnd(F.avg((s > 0).cast("double")), 4).alias("loadshed_pct_active"),
        F.count(F.lit(1)).alias("n_events"),
        F.min("created_at").alias("first_event"),
        F.max("created_at").alias("last_event"),
    )


def add_stage_context(df: DataFrame, history: DataFrame | None) -> DataFrame:
    """Append the three stage statistics to every row.

    The statistics are a global aggregate: exactly one row, so broadcasting it is
    size-bounded by construction.
    """
    if history is None:
        return df
    stats = stage_stats(history).select("loadshed_avg_stage", "loadshed_max_stage", "loadshed_pct_active")
    return df.crossJoin(F.broadcast(stats))


def stage_time_weighted(history: DataFrame) -> DataFrame:
    """Share of *time* (not events) with an active stage: each daily max stage lasts until the next day present.

    The daily table is small (one row per day); the window over it orders days.
    """
    daily = history.groupBy(F.to_date("created_at").alias("day")).agg(F.max("stage").alias("stage"))
    w = Window.orderBy("day")
    d = daily.withColumn("_next", F.lead("day").over(w)) \
             .withColumn("days", F.coalesce(F.datediff("_next", "day"), F.lit(1)).cast("long"))
    return d.agg(
        F.sum("days").cast("long").alias("days_total"),
        F.sum(F.when(F.col("stage") > 0, F.col("days")).otherwise(0)).cast("long").alias("days_active"),
    ).withColumn("active_share", rnd(F.col("days_active") / F.col("days_total"), 6))


def positional_zip(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str],
                   right_order: Sequence[str], right_cols: Sequence[str]) -> DataFrame:
    """Row i of each key's left series gets row i of its right series; the right side is cut to the left length."""
    l = sequence_number(left, keys, left_order, "pos")
    r = sequence_number(right.select(*keys, *right_order, *right_cols), keys, right_order, "pos")
    r = r.select(*keys, "pos", *right_cols)
    return l.join(r, [*keys, "pos"], "left")


def coverage_anti(dim: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Dimension rows without any fact (J9): left anti join."""
    return dim.join(facts.select(key), key, "left_anti")


def lookup_with_default(df: DataFrame, dim: DataFrame, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """Dimension lookup by key; absent keys or fields take per-field defaults."""
    j = df.join(dim, key, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
