"""Derived features of the hourly table (F1-F7): calendar, load windows, sources, weather, reliability.

All look-back windows are row frames over a gap-free hourly series; they run per
(site, block) with a 24-row halo (see ``blocked``), so no task holds a whole site.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from outagelens.functions.numeric import clip01, flag, safe_ratio
from outagelens.functions.timefmt import calendar_columns
from outagelens.operators.blocked import BLOCK_ROWS, blocked_rolling

LOAD = "total_load_kw"
HALO_HOURS = 24  # the longest look-back of ``window_features``
#: columns that ``row_features`` reads, besides the time
ROW_INPUTS = [LOAD, "solar_pv_kw", "generators_kw", "base_load_kw", "temperature_2m", "relative_humidity_2m", "wind_speed_10m",
              "precipitation", "shortwave_radiation", "who_reliability_pct"]


def calendar_features(df: DataFrame, ts: str = "hour_ts") -> DataFrame:
    """hour, day_of_week (Mon=0), month."""
    return df.withColumns(calendar_columns(ts))


def cyclic_features(df: DataFrame) -> DataFrame:
    """is_weekend and sin/cos of hour (24) and month (12)."""
    two_pi = 2 * math.pi
    return df.withColumns({
        "is_weekend": (F.col("day_of_week") >= 5).cast("int"),
        "hour_sin": F.sin(F.lit(two_pi) * F.col("hour") / F.lit(24.0)),
        "hour_cos": F.cos(F.lit(two_pi) * F.col("hour") / F.lit(24.0)),
        "month_sin": F.sin(F.lit(two_pi) * F.col("month") / F.lit(12.0)),
        "month_cos": F.cos(F.lit(two_pi) * F.col("month") / F.lit(12.0)),
    })


#: load of the hour before: with the day's mean, all that ``load_changes`` needs of a row's neighbours
LOAD_BEFORE = "_load_before"
LOAD_CHANGES = ["load_diff_1h", "load_pct_change_1h", "peak_ratio"]


def _change_columns(c: Column, prev1: Column, roll24: Column) -> dict[str, Column]:
    return {
        "load_diff_1h": F.coalesce(c - prev1, F.lit(0.0)),
        "load_pct_change_1h": F.coalesce(F.try_divide(c - prev1, prev1), F.lit(0.0)),
        "peak_ratio": F.coalesce(F.try_divide(c, roll24), F.lit(1.0)),
    }


def load_changes(df: DataFrame, col: str = LOAD) -> DataFrame:
    """The features that ``window_features`` leaves out without ``changes``, from the columns it has instead."""
    return df.withColumns(_change_columns(F.col(col), F.col(LOAD_BEFORE), F.col("load_rolling_24h"))).drop(LOAD_BEFORE)


def _load_window_columns(w: Window, col: str = LOAD, changes: bool = True) -> dict[str, Column]:
    c = F.col(col)
    w6 = w.rowsBetween(-5, 0)
    w24 = w.rowsBetween(-23, 0)
    prev1 = F.lag(c, 1).over(w)
    roll24 = F.avg(c).over(w24)
    change = _change_columns(c, prev1, roll24)
    out = {
        "load_rolling_6h": F.avg(c).over(w6),
        "load_rolling_24h": roll24,
        "load_std_24h": F.coalesce(F.stddev_samp(c).over(w24), F.lit(0.0)),
        "load_diff_1h": change["load_diff_1h"],
        "load_diff_24h": F.coalesce(c - F.lag(c, 24).over(w), F.lit(0.0)),
        "load_pct_change_1h": change["load_pct_change_1h"],
        "peak_ratio": change["peak_ratio"],
    }
    return out if changes else {k: v for k, v in out.items() if k not in LOAD_CHANGES} | {LOAD_BEFORE: prev1}


def _history_window_columns(w: Window, columns: Sequence[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if "grid_availability_ratio" in columns:
        out["grid_availability_rolling_6h"] = F.avg("grid_availability_ratio").over(w.rowsBetween(-5, 0))
    if "is_outage" in columns:
        out["recent_outages_6h"] = F.sum(F.col("is_outage").cast("double")).over(w.rowsBetween(-5, 0))
        out["recent_outages_24h"] = F.sum(F.col("is_outage").cast("double")).over(w.rowsBetween(-23, 0))
    return out


def window_features(df: DataFrame, keys: Sequence[str] = ("site_id",), idx: str = "hidx",
                    load: bool = True, history: bool = True, block: int = BLOCK_ROWS, changes: bool = True) -> DataFrame:
    """Load block (W1-W6, F2) and recent-history block (W7, W8) in one halo-windowed pass.

    Without ``changes``, LOAD_BEFORE stands for LOAD_CHANGES, which ``load_changes`` adds later."""
    cols = df.columns

    def build(w):
        out = {}
        if load:
            out.update(_load_window_columns(w, changes=changes))
        if history:
            out.update(_history_window_columns(w, cols))
        return out

    return blocked_rolling(df, list(keys), idx, build, halo=HALO_HOURS, block=block)


def source_ratios(df: DataFrame) -> DataFrame:
    """solar / generator / base-load shares of the total, zero total -> 0, clipped to [0,1]; generator flag."""
    total = F.col(LOAD)
    cols = df.columns
    out = {}
    if "solar_pv_kw" in cols:
        out["solar_ratio"] = clip01(safe_ratio(F.col("solar_pv_kw"), total))
    if "generators_kw" in cols:
        out["generator_active"] = flag(F.col("generators_kw") > 1.0)
        out["generator_ratio"] = clip01(safe_ratio(F.col("generators_kw"), total))
    if "base_load_kw" in cols:
        out["base_load_ratio"] = clip01(safe_ratio(F.col("base_load_kw"), total))
    return df.withColumns(out)


def weather_features(df: DataFrame, storm: bool = True) -> DataFrame:
    """Interactions and threshold flags; skipped without weather columns."""
    if "temperature_2m" not in df.columns:
        return df
    t, h = F.col("temperature_2m"), F.col("relative_humidity_2m")
    wnd, p = F.col("wind_speed_10m"), F.col("precipitation")
    out = {
        "temp_humidity_interaction": t * h / F.lit(100.0),
        "wind_precipitation_interaction": wnd * p,
        "solar_available": flag(F.col("shortwave_radiation") > 50),
        "heat_stress": flag(t > 30),
    }
    if storm:
        out["storm_risk"] = (flag(wnd > 40) + flag(p > 10) > 0).cast("int")
    return df.withColumns(out)


def reliability_risk(df: DataFrame) -> DataFrame:
    if "who_reliability_pct" not in df.columns:
        return df
    return df.withColumn("reliability_risk", F.lit(1.0) - F.col("who_reliability_pct") / F.lit(100.0))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns of numeric type (P8), schema-driven."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ex]


def fill_numeric_zero(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Global null -> 0 on numeric columns."""
    return df.na.fill(0, subset=numeric_columns(df, exclude))


# fixed values: stand-ins for inputs a site does not have (second feature path of the reference)
ABSENT_DEFAULTS = {
    "solar_ratio": 0.0, "base_load_ratio": 0.0, "generator_active": 0, "generator_ratio": 0.0,
    "grid_availability_rolling_6h": 1.0, "recent_outages_6h": 0.0, "recent_outages_24h": 0.0,
    "temperature_2m": 0.0, "relative_humidity_2m": 0.0, "wind_speed_10m": 0.0, "precipitation": 0.0,
    "surface_pressure": 0.0, "shortwave_radiation": 0.0,
}


def with_absent_defaults(df: DataFrame) -> DataFrame:
    """sites without some inputs get constant stand-ins; availability comes from the 0/1 flag if needed."""
    if "grid_available" in df.columns and "grid_availability_ratio" not in df.columns:
        df = df.withColumn("grid_availability_ratio", F.col("grid_available").cast("double"))
    return df.withColumns({c: F.lit(v) for c, v in ABSENT_DEFAULTS.items() if c not in df.columns})


def row_features(df: DataFrame, storm: bool = True) -> DataFrame:
    """The features of a row that are functions of its own columns: calendar, cycles, sources, weather, reliability."""
    if "hour" not in df.columns:
        df = calendar_features(df)
    df = source_ratios(cyclic_features(df))
    return reliability_risk(weather_features(df, storm=storm))


def feature_table(merged: DataFrame, keys: Sequence[str] = ("site_id",), idx: str = "hidx",
                  block: int = BLOCK_ROWS, absent_defaults: bool = False) -> DataFrame:
    """Full feature table (F6): temporal, load, sources, history, weather, reliability, nulls -> 0.

    ``absent_defaults=True`` is the second path (F7): missing inputs become constants and
    no storm flag is derived."""
    df = merged
    if absent_defaults:
        df = df.withColumns({c: F.lit(0.0) for c in ("temperature_2m", "relative_humidity_2m", "wind_speed_10m",
                                                      "precipitation", "surface_pressure", "shortwave_radiation")
                             if c not in df.columns})
    if "hour" not in df.columns:
        df = calendar_features(df)
    df = cyclic_features(df)
    df = window_features(df, keys, idx, block=block)
    df = source_ratios(df)
    df = weather_features(df, storm=not absent_defaults)
    df = reliability_risk(df)
    if absent_defaults:
        df = with_absent_defaults(df)
    return fill_numeric_zero(df, exclude=list(keys) + [idx])
