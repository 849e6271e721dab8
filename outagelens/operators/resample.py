"""Hourly resampling (A1) and the gap-free hourly spine."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outagelens.functions.timefmt import hour_index, hour_ts_from_index
from outagelens.operators.blocked import BLOCK_ROWS, block_of
from outagelens.operators.fill import CONTEXT, FIRST, LAST
from outagelens.session import materialised, room_for

# per-column aggregation rules of the meter table (fixed: mean of powers and availability, max of the flag)
METER_RULES = {
    "solar_pv_kw": "mean",
    "total_load_kw": "mean",
    "generators_kw": "mean",
    "sterilization_kw": "mean",
    "base_load_kw": "mean",
    "grid_available": "mean",
    "is_outage": "max",
}
METER_RENAMES = {"grid_available": "grid_availability_ratio"}

_AGG = {
    "mean": lambda c: F.avg(c),
    "max": lambda c: F.max(c),
    "min": lambda c: F.min(c),
    "sum": lambda c: F.sum(c),
    "count": lambda c: F.count(c),
}


def hourly_resample(
    df: DataFrame,
    key: str = "site_id",
    ts: str = "ts",
    rules: Mapping[str, str] = METER_RULES,
    renames: Mapping[str, str] = METER_RENAMES,
) -> DataFrame:
    """Aggregate readings to one row per (key, hour); only hours with readings.

    Output: key, hidx (epoch hour), hour_ts, one column per rule.  The group-by
    is partial-then-final, so a hot site is pre-aggregated map-side.
    """
    aggs = [_AGG[r](c).alias(renames.get(c, c)) for c, r in rules.items()]
    out = df.groupBy(key, hour_index(ts).alias("hidx")).agg(*aggs)
    if "is_outage" in rules:
        out = out.withColumn("is_outage", F.col("is_outage").cast("int"))
    return out.withColumn("hour_ts", hour_ts_from_index("hidx"))


def hourly_spine(hourly: DataFrame, key: str = "site_id", block: int = BLOCK_ROWS,
                 site_columns: DataFrame | None = None) -> DataFrame:
    """Every hour between each key's first and last hour: (key, hidx, hour_ts).

    Generated in two steps (blocks, then hours inside a block) after a shuffle
    on (key, block), so a site with a very long span is spread over tasks.
    ``site_columns`` (one row per key) is joined at the site grain, before the
    expansion, so per-site constants never need a join on the hourly table.
    """
    bounds = hourly.groupBy(key).agg(F.min("hidx").alias("_lo"), F.max("hidx").alias("_hi"))
    extra: list[str] = []
    if site_columns is not None:
        bounds = bounds.join(site_columns, key, "left")
        extra = [c for c in site_columns.columns if c != key]
    blocks = bounds.select(
        key, *extra, "_lo", "_hi",
        F.explode(F.sequence(block_of(F.col("_lo"), block), block_of(F.col("_hi"), block))).alias("_b"),
    # a fixed number: by size, Spark would merge the blocks into one task before they grow
    ).repartition(int(hourly.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "_b")
    start = F.greatest(F.col("_lo"), F.col("_b") * F.lit(block))
    stop = F.least(F.col("_hi"), F.col("_b") * F.lit(block) + F.lit(block - 1))
    return blocks.select(key, *extra, F.explode(F.sequence(start, stop)).alias("hidx")).withColumn(
        "hour_ts", hour_ts_from_index("hidx")
    )


def grid_rows(readings: DataFrame, key: str = "site_id", ts: str = "ts") -> int:
    """Rows of the hourly grid of ``readings``: hours between each key's first and last one (a job over two columns)."""
    hours = readings.groupBy(key).agg((F.max(hour_index(ts)) - F.min(hour_index(ts)) + 1).alias("n"))
    return hours.agg(F.sum("n")).first()[0] or 0


def hourly_grid(readings: DataFrame, key: str = "site_id", ts: str = "ts",
                rules: Mapping[str, str] = METER_RULES, renames: Mapping[str, str] = METER_RENAMES,
                block: int = BLOCK_ROWS, site_columns: DataFrame | None = None) -> DataFrame:
    """Resample and emit empty hours (as pandas ``resample('1h')`` does): spine LEFT JOIN hourly.

    Shuffle partitions follow the number of hours, so a task's rows don't grow with the input."""
    room_for(readings.sparkSession, grid_rows(readings, key, ts))
    hourly = hourly_resample(readings, key, ts, rules, renames)
    spine = hourly_spine(hourly, key, block, site_columns)
    return spine.join(hourly.drop("hour_ts"), [key, "hidx"], "left")


def hourly_spans(readings: DataFrame, key: str = "site_id", ts: str = "ts", site_columns: DataFrame | None = None) -> DataFrame:
    """Each key's first and last hour, and its rows of ``site_columns`` as an array of structs (null without any), for ``gap_fill``.

    The hours are written once. Shuffle partitions follow their number, as with ``hourly_grid``."""
    spans = materialised(readings.groupBy(key).agg(F.min(hour_index(ts)).alias(FIRST), F.max(hour_index(ts)).alias(LAST)), "spans")
    room_for(readings.sparkSession, spans.agg(F.sum(F.col(LAST) - F.col(FIRST) + 1)).first()[0] or 0)
    if site_columns is None:
        return spans.withColumn(CONTEXT, F.lit(None).cast("array<struct<>>"))
    rows = site_columns.groupBy(key).agg(F.collect_list(F.struct(*[c for c in site_columns.columns if c != key])).alias(CONTEXT))
    return spans.join(rows, key, "left")


def known_hours(readings: DataFrame, spans: DataFrame, more: DataFrame | None = None, key: str = "site_id", ts: str = "ts",
                rules: Mapping[str, str] = METER_RULES, renames: Mapping[str, str] = METER_RENAMES) -> DataFrame:
    """The hours with readings or with a row of ``more`` (by key and ``hidx``), the latter within the key's span."""
    hourly = hourly_resample(readings, key, ts, rules, renames).drop("hour_ts")
    if more is None:
        return hourly.where(F.col(key).isNotNull() & F.col("hidx").isNotNull())
    d = hourly.join(more, [key, "hidx"], "full_outer").join(spans.select(key, FIRST, LAST), key)
    return d.where(F.col("hidx").between(F.col(FIRST), F.col(LAST))).drop(FIRST, LAST)
