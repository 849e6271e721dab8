"""Site profiles: rescale a reference series (F9), expand annual totals to hourly profiles (F11),
peak/season stress (F12), intensity ratios (A15, R13).

F11 is re-aimed as a deterministic expansion: the random factors of the original
simulator are replaced by their means (noise 1.0, cloud 0.65, base share 0.65,
sterilisation factor 1.0); no outage draws.
"""

from __future__ import annotations

import math
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outagelens.functions.numeric import clip01, rnd, safe_ratio
from outagelens.operators.context import PROFILE_DEFAULTS, lookup_with_default
from outagelens.session import materialised

HOURS_PER_YEAR = 8760
# fixed values of the profile expansion
PROFILE_YEAR_START = "2022-01-01 00:00:00"
CLOUD_MEAN = 0.65
BASE_SHARE_MEAN = 0.65
SOLAR_CAPACITY_SHARE = 0.15
STERILIZATION_SHARE = 0.06
LOAD_FLOOR_SHARE = 0.3
WEEKEND_FACTOR = 0.82
# fixed values of the outage-stress rule
TARGET_RELIABILITY = 99.5
PEAK_MULTIPLIER = 2.5
WINTER_MULTIPLIER = 1.8
WINTER_MONTHS = (11, 12, 1, 2)

RESCALED = ["total_load_kw", "solar_pv_kw", "base_load_kw", "sterilization_kw", "generators_kw",
            "load_rolling_6h", "load_rolling_24h", "load_std_24h", "load_diff_1h", "load_diff_24h"]


def site_rescale(series: DataFrame, profiles: DataFrame, key: str = "site_id",
                 target: str = "avg_load_kw", has_solar: str = "has_solar") -> DataFrame:
    """Multiply load columns by target_avg / max(observed avg, 1); no solar -> 0; ratios recomputed."""
    avg = series.groupBy(key).agg(F.avg("total_load_kw").alias("_obs_avg"))
    prof = profiles.select(key, F.col(target).alias("_target"), F.col(has_solar).alias("_solar"))
    scale = lookup_with_default(avg, prof, key, {"_target": PROFILE_DEFAULTS["avg_load_kw"], "_solar": True}).select(
        key, (F.col("_target") / F.greatest(F.col("_obs_avg"), F.lit(1.0))).alias("scale"),
                                       "_solar")
    # written, so that its size is known before the series is shuffled for it
    d = series.join(materialised(scale, "scales"), key)
    d = d.withColumns({c: F.col(c) * F.col("scale") for c in RESCALED if c in series.columns})
    d = d.withColumn("solar_pv_kw", F.when(F.coalesce(F.col("_solar"), F.lit(True)), F.col("solar_pv_kw"))
                     .otherwise(F.lit(0.0)))
    total = F.col("total_load_kw")
    return d.withColumns({
        "solar_ratio": clip01(safe_ratio(F.col("solar_pv_kw"), total)),
        "base_load_ratio": clip01(safe_ratio(F.col("base_load_kw"), total)),
        "peak_ratio": F.coalesce(F.try_divide(total, F.nullif(F.col("load_rolling_24h"), F.lit(0.0))), F.lit(1.0)),
    }).drop("_solar")


def hourly_profile(sites: DataFrame, key: str, annual_kwh: str, has_solar: str) -> DataFrame:
    """Annual total -> 8,760 hourly rows per site (F11, U2): day shape x season x weekend, floor 0.3 mean."""
    start = F.expr(f"TIMESTAMP_NTZ'{PROFILE_YEAR_START}'")
    # a fixed number of partitions: by size, Spark would merge the sites into one task before they grow
    sites = sites.repartition(int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    d = sites.select(key, F.col(annual_kwh).cast("double").alias("_annual"), F.col(has_solar).alias("_solar"),
                     F.explode(F.sequence(F.lit(0), F.lit(HOURS_PER_YEAR - 1))).alias("h_of_year"))
    ts = F.timestamp_add("HOUR", F.col("h_of_year"), start)
    d = d.withColumn("datetime", ts).withColumns({
        "_h": F.hour("datetime"), "_m": F.month("datetime"), "_dow": F.weekday("datetime")})
    h, m = F.col("_h").cast("double"), F.col("_m").cast("double")
    mean = F.col("_annual") / F.lit(float(HOURS_PER_YEAR))
    pi = math.pi
    daily = F.when((F.col("_h") >= 7) & (F.col("_h") <= 20), F.lit(0.85) + F.lit(0.15) * F.sin(F.lit(pi) * (h - 7) / 13)) \
        .otherwise(F.lit(0.60) + F.lit(0.10) * F.sin(F.lit(pi) * h / 24))
    seasonal = F.lit(1.0) + F.lit(0.15) * F.cos(F.lit(2 * pi) * (m - 1) / 12)
    weekend = F.when(F.col("_dow") >= 5, F.lit(WEEKEND_FACTOR)).otherwise(F.lit(1.0))
    load = F.greatest(mean * daily * seasonal * weekend, mean * F.lit(LOAD_FLOOR_SHARE))
    sun = F.greatest(F.sin(F.lit(pi) * (h - 6) / 12), F.lit(0.0))
    month_sun = F.lit(0.6) + F.lit(0.4) * F.greatest(F.sin(F.lit(pi) * (m - 3) / 6), F.lit(0.0))
    solar = F.when(F.coalesce(F.col("_solar"), F.lit(False)),
                   mean * F.lit(SOLAR_CAPACITY_SHARE) * sun * F.lit(CLOUD_MEAN) * month_sun).otherwise(F.lit(0.0))
    steril = F.when((F.col("_h") >= 8) & (F.col("_h") <= 17), mean * F.lit(STERILIZATION_SHARE)).otherwise(F.lit(0.0))
    d = d.withColumns({"_load": load})
    return d.select(
        key, "h_of_year", "datetime",
        rnd(F.col("_load"), 1).alias("total_load_kw"),
        rnd(solar, 1).alias("solar_pv_kw"),
        rnd(F.col("_load") * F.lit(BASE_SHARE_MEAN), 1).alias("base_load_kw"),
        rnd(steril, 1).alias("sterilization_kw"),
        F.col("_m").cast("int").alias("month"), F.col("_load").alias("load_raw"),
    )


def peak_season_risk(profile: DataFrame, key: str) -> DataFrame:
    """hourly outage probability (100 - 99.5)/100/365*12, x2.5 above the site's own p90 load,
    x1.8 in Nov-Feb; summarised per site."""
    base = (100.0 - TARGET_RELIABILITY) / 100.0 / 365.0 * 12.0
    # unrounded loads; 8,760 values a site, so one aggregate holds them
    p90 = profile.groupBy(key).agg(F.percentile("load_raw", F.lit(0.9)).alias("load_p90"))
    d = profile.join(p90, key)
    peak = F.col("load_raw") > F.col("load_p90")
    winter = F.col("month").isin(*WINTER_MONTHS)
    p = F.lit(base) * F.when(peak, F.lit(PEAK_MULTIPLIER)).otherwise(F.lit(1.0)) \
        * F.when(winter, F.lit(WINTER_MULTIPLIER)).otherwise(F.lit(1.0))
    return d.groupBy(key).agg(
        F.first("load_p90").alias("load_p90"),
        F.count(F.when(peak, 1)).alias("n_peak_hours"),
        F.count(F.when(winter, 1)).alias("n_winter_hours"),
        F.sum(p).alias("expected_outages"),
    )


def intensity(df: DataFrame, annual_kwh: str, floor_area: str, cost: str) -> DataFrame:
    """Mean hourly kW (0 digits), kWh per m2 (1), cost per kWh (4), GWh per year."""
    a = F.col(annual_kwh).cast("double")
    return df.withColumns({
        "avg_hourly_kw": rnd(a / HOURS_PER_YEAR, 0),
        "electricity_intensity_kwh_m2": rnd(F.try_divide(a, F.col(floor_area)), 1),
        "electricity_cost_per_kwh": rnd(F.try_divide(F.col(cost), a), 4),
        "annual_gwh": a / 1e6,
    })
