"""What-if scenarios.

``nearest_history``: for every scenario, the history row minimising
3|dhour| + |dmonth| + |dload|/30 (first row in time on ties), computed
exactly without forming scenario x history pairs.  For a fixed (hour, month)
cell the score only depends on |dload|, so the best row of a cell is the
nearest-load row on either side.  Each scenario is copied once per cell its
site has (at most 24 x 12), unioned with the history, and two running windows
per (site, hour, month) ordered by load give the nearest lower and higher
load; the best of those <= 576 candidates wins. A site without history borrows the
reference site's rows with rescaled loads, without a copy of them for each site.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outagelens.operators.context import PROFILE_DEFAULTS, lookup_with_default

# fixed values: nearest-row score weights (hour, month, load divisor)
W_HOUR, W_MONTH, LOAD_DIV = 3.0, 1.0, 30.0

SCENARIO_PARAMS = ["hour", "month", "day_of_week", "total_load_kw", "solar_pv_kw", "base_load_kw",
                   "sterilization_kw", "temperature_2m", "humidity", "wind_speed", "precipitation",
                   "pressure", "radiation"]


#: copies of the reference site's history, among which scenarios that borrow it are spread
SALTS = 16


def with_lookup(scenarios: DataFrame, history: DataFrame, profiles: DataFrame, key: str = "site_id") -> DataFrame:
    """``scenarios`` with ``look_site`` and ``scale``: the site whose history serves, and the factor for its loads.

    A site with history serves itself (factor 1). Any other borrows the reference site's series, rescaled from that
    one's mean load to its own target load (the profile's, or the default). The reference site is the smallest
    ``key`` with history. Without any history there are no rows.
    """
    obs = history.groupBy(key).agg(F.avg("total_load_kw").alias("_obs"))
    ref = obs.orderBy(key).limit(1).select(F.col(key).alias("_ref"), F.col("_obs").alias("_ref_obs"))  # one row
    target = profiles.select(key, F.col("avg_load_kw").alias("_target"))
    d = lookup_with_default(scenarios, target, key, {"_target": PROFILE_DEFAULTS["avg_load_kw"]})
    d = d.join(obs.select(key, F.lit(True).alias("_own")), key, "left").crossJoin(F.broadcast(ref))
    own = F.col("_own").isNotNull()
    return d.withColumns({
        "look_site": F.when(own, F.col(key)).otherwise(F.col("_ref")),
        "scale": F.when(own, F.lit(1.0)).otherwise(F.col("_target") / F.greatest(F.col("_ref_obs"), F.lit(1.0))),
    }).drop("_target", "_own", "_ref", "_ref_obs")


def _score(dh, dm, dl):
    return F.lit(W_HOUR) * F.abs(dh) + F.lit(W_MONTH) * F.abs(dm) + F.abs(dl) / F.lit(LOAD_DIV)


def nearest_history(scenarios: DataFrame, history: DataFrame, key: str = "site_id", idx: str = "hidx",
                    scenario_id: str = "scenario_id") -> DataFrame:
    """scenario_id, key, look_site, scale, idx of the best history row and its score; ``scenarios`` from ``with_lookup``.

    Borrowing scenarios all look up one site, so they are spread over ``SALTS`` copies of its history."""
    borrows = F.col("look_site") != F.col(key)
    sc = scenarios.select(
        key, "look_site", "scale", F.col(scenario_id).cast("long").alias("_sid"), F.col("hour").alias("_sh"),
        F.col("month").alias("_sm"), F.col("total_load_kw").alias("_want"),
        F.when(borrows, F.pmod(F.col(scenario_id), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)).alias("_salt"))
    hist = history.select(F.col(key).alias("look_site"), F.col("hour").alias("_h"), F.col("month").alias("_m"),
                          F.col("total_load_kw").alias("_l"), F.col(idx).alias("_i"))
    ref = hist.select("look_site").orderBy("look_site").limit(1).withColumnRenamed("look_site", "_ref")  # one row
    hist = hist.crossJoin(F.broadcast(ref)).withColumn("_salt", F.explode(F.when(
        F.col("look_site") == F.col("_ref"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_ref")
    # the (hour, month) cells each site actually has: at most 288 rows per site
    cells = hist.select("look_site", "_salt", "_h", "_m").distinct()
    sc = sc.join(cells, ["look_site", "_salt"]).withColumn("_l", F.col("_want") / F.greatest(F.col("scale"), F.lit(1e-9)))
    none = {"_i": "long"}, {key: "long", "scale": "double", "_sid": "long", "_sh": "int", "_sm": "int", "_want": "double"}
    sc = sc.withColumns({c: F.lit(None).cast(t) for c, t in none[0].items()}).withColumn("_tag", F.lit(1))
    hist = hist.withColumns({c: F.lit(None).cast(t) for c, t in none[1].items()}).withColumn("_tag", F.lit(0))
    u = hist.unionByName(sc)
    part = ["look_site", "_salt", "_h", "_m"]
    cand = F.when(F.col("_tag") == 0, F.struct(F.col("_l").alias("l"), F.col("_i").alias("i")))
    # lower side: load <= L (history first at equal load), lowest position among equal loads last
    low = Window.partitionBy(*part).orderBy(F.col("_l").asc(), F.col("_tag").asc(), F.col("_i").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    # higher side: load > L, lowest position among equal loads last
    high = Window.partitionBy(*part).orderBy(F.col("_l").desc(), F.col("_tag").desc(), F.col("_i").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_lo", F.last(cand, ignorenulls=True).over(low)) \
         .withColumn("_hi", F.last(cand, ignorenulls=True).over(high)) \
         .filter(F.col("_tag") == 1)
    dh, dm = F.col("_h") - F.col("_sh"), F.col("_m") - F.col("_sm")
    opts = F.array_compact(F.array(*[
        F.when(F.col(side).isNotNull(), F.struct(
            _score(dh, dm, F.col(f"{side}.l") * F.col("scale") - F.col("_want")).alias("score"), F.col(f"{side}.i").alias("i")))
        for side in ("_lo", "_hi")]))
    c = u.select(key, "look_site", "scale", "_sid", F.explode(opts).alias("_o"))
    best = c.groupBy(key, "look_site", "scale", "_sid").agg(F.min("_o").alias("_b"))
    return best.select(F.col("_sid").alias(scenario_id), key, "look_site", "scale", F.col("_b.i").alias(idx),
                       F.col("_b.score").alias("score"))


def scenario_rows(scenarios: DataFrame, features: DataFrame, nearest: DataFrame, key: str = "site_id",
                  idx: str = "hidx", scenario_id: str = "scenario_id") -> DataFrame:
    """The nearest history row's features (loads rescaled, where borrowed), the 13 parameters written over it,
    derived columns recomputed."""
    base = nearest.select(scenario_id, key, "look_site", "scale", idx).join(
        features.withColumnRenamed(key, "look_site"), ["look_site", idx])
    base = base.withColumns({c: F.col(c) * F.col("scale") for c in ("load_rolling_24h", "load_std_24h")})
    over = scenarios.select(scenario_id, *[F.col(c).alias(f"_p_{c}") for c in SCENARIO_PARAMS])
    d = base.join(over, scenario_id)
    p = {c: F.col(f"_p_{c}") for c in SCENARIO_PARAMS}
    two_pi = 2 * math.pi
    load = p["total_load_kw"]
    total = F.greatest(load, F.lit(1.0))
    d = d.withColumns({
        "total_load_kw": load, "solar_pv_kw": p["solar_pv_kw"], "base_load_kw": p["base_load_kw"],
        "sterilization_kw": p["sterilization_kw"], "temperature_2m": p["temperature_2m"],
        "relative_humidity_2m": p["humidity"], "wind_speed_10m": p["wind_speed"],
        "precipitation": p["precipitation"], "surface_pressure": p["pressure"],
        "shortwave_radiation": p["radiation"],
        "hour": p["hour"].cast("int"), "month": p["month"].cast("int"), "day_of_week": p["day_of_week"].cast("int"),
        "is_weekend": (p["day_of_week"] >= 5).cast("int"),
        "hour_sin": F.sin(F.lit(two_pi) * p["hour"] / F.lit(24.0)),
        "hour_cos": F.cos(F.lit(two_pi) * p["hour"] / F.lit(24.0)),
        "month_sin": F.sin(F.lit(two_pi) * p["month"] / F.lit(12.0)),
        "month_cos": F.cos(F.lit(two_pi) * p["month"] / F.lit(12.0)),
        "solar_ratio": p["solar_pv_kw"] / total,
        "base_load_ratio": p["base_load_kw"] / total,
        "peak_ratio": load / F.greatest(F.col("load_rolling_24h"), F.lit(1.0)),
        "temp_humidity_interaction": p["temperature_2m"] * p["humidity"] / F.lit(100.0),
        "wind_precipitation_interaction": p["wind_speed"] * p["precipitation"],
        "solar_available": (p["radiation"] > 50).cast("int"),
        "heat_stress": (p["temperature_2m"] > 30).cast("int"),
    })
    return d.drop(*[f"_p_{c}" for c in SCENARIO_PARAMS])


def reference_scenarios(profiles: DataFrame, key: str = "site_id") -> DataFrame:
    """R9 baseline: mid-day June Wednesday at the site's average load (fixed values below)."""
    avg = F.col("avg_load_kw")
    return profiles.select(
        F.col(key).alias("scenario_id"), key,
        F.lit(12).alias("hour"), F.lit(6).alias("month"), F.lit(2).alias("day_of_week"),
        avg.alias("total_load_kw"),
        F.when(F.col("has_solar"), avg * 0.3).otherwise(F.lit(0.0)).alias("solar_pv_kw"),
        (avg * 0.85).alias("base_load_kw"), (avg * 0.06).alias("sterilization_kw"),
        F.lit(25.0).alias("temperature_2m"), F.lit(70.0).alias("humidity"), F.lit(10.0).alias("wind_speed"),
        F.lit(0.0).alias("precipitation"), F.lit(1013.0).alias("pressure"), F.lit(200.0).alias("radiation"),
    )


def delta(scored: DataFrame, reference: DataFrame, keys: Sequence[str], p: str = "probability") -> DataFrame:
    """Scenario probability minus the reference scenario's, per key."""
    r = reference.select(*keys, F.col(p).alias("reference_probability"))
    return scored.join(r, list(keys), "left").withColumn("delta", F.col(p) - F.col("reference_probability"))
