"""Outage runs, storage sizing, load categories and energy balance over the hourly table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outagelens.functions.numeric import fixed
from outagelens.operators.blocked import BLOCK_ROWS, block_of
from outagelens.session import materialised

SAFETY = 1.2  # fixed value: safety factor of the storage size
#: fixed values: category of each part of the load; what no part covers is ``rest``
LOAD_CATEGORIES = {"base_load_kw": "vital", "sterilization_kw": "vital", "rest_kw": "comfort"}


def runs(df: DataFrame, keys: Sequence[str], idx: str, flag: str, sums: Mapping[str, str] | None = None,
         peaks: Mapping[str, str] | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """Maximal runs of consecutive positions with ``flag`` = 1: keys, first, last, length, sums and maxima of columns.

    ``sums`` and ``peaks`` map output names to columns. Runs are found per (key, block of positions). Those that touch
    an edge of their block, two a block at most, are joined by a window over one row each; the others are whole."""
    keys, sums, peaks = list(keys), dict(sums or {}), dict(peaks or {})
    pos = F.col(idx)
    d = df.where(F.col(flag) == 1).select(*keys, idx, *sorted({*sums.values(), *peaks.values()})).withColumn("_blk", block_of(pos, block))
    within = Window.partitionBy(*keys, "_blk").orderBy(idx)
    aggs = [F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("length"),
            *(F.sum(c).alias(n) for n, c in sums.items()), *(F.max(c).alias(n) for n, c in peaks.items())]
    parts = d.withColumn("_island", pos - F.row_number().over(within)).groupBy(*keys, "_blk", "_island").agg(*aggs)
    # both branches read it; a row for each run and block
    parts = materialised(parts.drop("_island"), "run-parts")
    edge = (F.col("first") == F.col("_blk") * block) | (F.col("last") == F.col("_blk") * block + (block - 1))
    order = Window.partitionBy(*keys).orderBy("first")
    goes_on = F.coalesce(F.lag("last").over(order) == F.col("first") - 1, F.lit(False))
    numbered = parts.where(edge).withColumn("_new", (~goes_on).cast("long")).withColumn(
        "_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy(*keys, "_run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length"),
        *(F.sum(n).alias(n) for n in sums), *(F.max(n).alias(n) for n in peaks))
    columns = [*keys, "first", "last", "length", *sums, *peaks]
    return parts.where(~edge).select(*columns).unionByName(joined.select(*columns))


def _kw(c: Column | str) -> Column:
    """Power as a decimal of six digits, null as 0."""
    return fixed(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)))


def load_parts(df: DataFrame) -> DataFrame:
    """Adds vital_kw (base load and sterilization, at most the total) and comfort_kw (the rest of the total), as decimals."""
    vital = F.least(_kw("base_load_kw") + _kw("sterilization_kw"), _kw("total_load_kw")).cast("decimal(20,6)")
    return df.withColumn("vital_kw", vital).withColumn("comfort_kw", (_kw("total_load_kw") - F.col("vital_kw")).cast("decimal(20,6)"))


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in names})


def outage_runs(hourly: DataFrame, keys: Sequence[str] = ("site_id",), block: int = BLOCK_ROWS) -> DataFrame:
    """A row for each run of outage hours with its vital energy (kWh, as rows are hours) and its highest vital load."""
    found = runs(load_parts(hourly), keys, "hidx", "is_outage", {"vital_kwh": "vital_kw"}, {"peak_vital_kw": "vital_kw"}, block)
    return _doubles(found, "vital_kwh", "peak_vital_kw")


def storage_size(outages: DataFrame, keys: Sequence[str] = ("site_id",), safety: float = SAFETY) -> DataFrame:
    """Capacity and power that carry the vital load through the worst run, with a safety factor."""
    return outages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.max("length").alias("longest_h"), F.sum("length").alias("outage_h"),
        (F.max("vital_kwh") * safety).alias("capacity_kwh"), (F.max("peak_vital_kw") * safety).alias("power_kw"))


def load_segments(hourly: DataFrame, categories: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """kWh and share of each load category: parts of the load, summed before the join with ``categories`` (part, category)."""
    keys = list(keys)
    base, steril = _kw("base_load_kw"), _kw("sterilization_kw")
    rest = F.greatest((_kw("total_load_kw") - base - steril).cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)"))
    sums = hourly.groupBy(*keys).agg(F.sum(base).alias("base_load_kw"), F.sum(steril).alias("sterilization_kw"), F.sum(rest).alias("rest_kw"))
    parts = sums.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("part"), F.col(c).cast("double").alias("kwh")) for c in ("base_load_kw", "sterilization_kw", "rest_kw")])))
    by = parts.join(categories, "part", "left").withColumn("category", F.coalesce("category", F.lit("other")))
    by = by.groupBy(*keys, "category").agg(F.sum("kwh").alias("kwh"))
    whole = Window.partitionBy(*keys)  # a row for each category
    return by.withColumn("share", F.coalesce(F.try_divide(F.col("kwh"), F.sum("kwh").over(whole)), F.lit(0.0)))


def energy_balance(hourly: DataFrame, key: str = "site_id", ts: str = "hour_ts") -> DataFrame:
    """Vital, comfort, solar and generator energy by day, month, year, site and over all, with subtotals.

    Hours are summed by day first; ``rollup`` then works on a row for each site and day. ``level``: 0 day, 1 month, 2 year,
    3 site, 4 all. ``share`` is a load category's part of the load; ``balance_kwh`` is own production minus the load."""
    d = load_parts(hourly)
    day = d.groupBy(key, F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day")).agg(
        F.sum("vital_kw").alias("vital"), F.sum("comfort_kw").alias("comfort"), F.max(_kw("total_load_kw")).alias("peak_kw"),
        F.sum(_kw("solar_pv_kw") + _kw("generators_kw")).alias("own"))
    up = day.rollup(key, "year", "month", "day").agg(
        F.grouping_id().alias("_g"), *(F.sum(c).alias(c) for c in ("vital", "comfort", "own")), F.max("peak_kw").alias("peak_kw"))
    # grouping_id has a bit for each column rolled up: 0, 1, 3, 7, 15
    level = F.round(F.log2(F.col("_g") + 1)).cast("int")
    up = _doubles(up.withColumn("balance_kwh", F.col("own") - F.col("vital") - F.col("comfort")), "vital", "comfort", "peak_kw", "balance_kwh")
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("kwh")) for c in ("vital", "comfort")]))
    return up.select(key, "year", "month", "day", level.alias("level"), rows, "peak_kw", (F.col("vital") + F.col("comfort")).alias("_load"),
                     "balance_kwh").withColumn("share", F.coalesce(F.try_divide(F.col("kwh"), F.col("_load")), F.lit(0.0))).drop("_load")


def critical_days(hourly: DataFrame, risk: Column, key: str = "site_id", ts: str = "hour_ts", n: int = 5) -> DataFrame:
    """The ``n`` days of each site with the most vital energy at risk (sum of risk x vital load; ties by date)."""
    day = load_parts(hourly.withColumn("_risk", risk)).groupBy(key, F.to_date(ts).alias("day")).agg(
        F.sum(fixed(F.col("_risk") * F.col("vital_kw").cast("double"))).cast("double").alias("kwh_at_risk"), F.max("_risk").alias("peak_risk"))
    order = Window.partitionBy(key).orderBy(F.col("kwh_at_risk").desc(), F.col("day"))
    return day.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= n)
