"""Scoring heuristics, risk bands, site adjustment, out-of-range stress, live-window alerts.

All per-row logic is column expressions; per-site statistics are group-bys joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outagelens.functions.numeric import rnd
from outagelens.functions.timefmt import micros_index

# fixed values: heuristic constants of the scoring rules
ALERT_P = 0.5
REF_RELIABILITY = 50.0
ADJ_SLOPE = 1.5
P_FLOOR, P_CAP = 0.01, 0.99
LIVE_WINDOW_ROWS = 72
STRESS_FEATURES = ("total_load_kw", "temperature_2m", "wind_speed_10m", "precipitation")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int_text(x: Column) -> Column:
    """Half-up integer as text (``format_number`` rounds half-even)."""
    return F.floor(x + F.lit(0.5)).cast("long").cast("string")


def heuristics(p: Column | str) -> dict[str, Column]:
    """Batch scorer outputs (R1): probability (4 digits), hours to outage and duration (1 digit)."""
    p = _c(p)
    hours = F.when(p > ALERT_P, F.greatest(F.lit(1.0), (1 - p) * 24)).otherwise(24 + (1 - p) * 48)
    dur = F.when(p > ALERT_P, 1 + p * 4).otherwise(F.lit(0.0))
    return {
        "outage_probability": rnd(p, 4),
        "estimated_hours_to_outage": rnd(hours, 1),
        "estimated_outage_duration_h": rnd(dur, 1),
    }


def scenario_heuristics(p: Column | str) -> dict[str, Column]:
    """Scenario outputs (R8): hours max(1, round((1-p)*24)); duration 1+4p (1 digit) above 0.5, else 0.5."""
    p = _c(p)
    return {
        "hours_to_outage": F.greatest(F.lit(1.0), rnd((1 - p) * 24, 0)),
        "duration_h": F.when(p > ALERT_P, rnd(1 + p * 4, 1)).otherwise(F.lit(0.5)),
    }


def risk_band(p: Column | str) -> Column:
    """> 0.7 high, > 0.4 medium, else low."""
    p = _c(p)
    return F.when(p > 0.7, "high").when(p > 0.4, "medium").otherwise("low")


def reliability_band(r: Column | str) -> Column:
    """< 30 critical, < 55 low, < 80 moderate, else good."""
    r = _c(r)
    return F.when(r < 30, "critical").when(r < 55, "low").when(r < 80, "moderate").otherwise("good")


def site_factor(reliability: Column | str) -> Column:
    return 1 + (F.lit(REF_RELIABILITY) - _c(reliability)) / 100 * ADJ_SLOPE


def adjust_for_profile(p: Column | str, reliability: Column | str, stability: Column | str,
                       has_solar: Column | str, has_generator: Column | str) -> dict[str, Column]:
    """P * (1 + 1.5 (50 - r)/100) clipped to [0.01, 0.99], plus notes."""
    p, r = _c(p), _c(reliability)
    adj = F.least(F.lit(P_CAP), F.greatest(F.lit(P_FLOOR), p * site_factor(r)))
    r0 = int_text(r)
    rel_note = (F.when(r < 30, F.format_string("grid %s - very low reliability (%s%%)", _c(stability), r0))
                .when(r < 55, F.format_string("grid %s - low reliability (%s%%)", _c(stability), r0))
                .when(r > 90, F.format_string("grid %s - high reliability (%s%%)", _c(stability), r0)))
    notes = F.array_compact(F.array(
        rel_note,
        F.when(~F.coalesce(_c(has_solar), F.lit(False)), F.lit("no solar panels")),
        F.when(~F.coalesce(_c(has_generator), F.lit(False)), F.lit("no backup generator")),
    ))
    return {"adjusted_probability": adj, "notes": notes}


def stress_bounds(history: DataFrame, keys: Sequence[str] = ("site_id",),
                  features: Sequence[str] = STRESS_FEATURES) -> DataFrame:
    """Per key: observed max and exact p95 of each stress feature (A7), in one aggregate.

    A key's rows are the hours of one site, so what ``percentile`` buffers for a key (its distinct values) is
    bounded by the site's time span; for unbounded groups there is ``exact_percentiles``.
    """
    return history.groupBy(*keys).agg(*[x for f in features for x in (
        F.max(F.col(f).cast("double")).alias(f"{f}_max"), F.percentile(F.col(f).cast("double"), F.lit(0.95)).alias(f"{f}_p95"))])


def extrapolation_stress(p: Column | str, values: Mapping[str, Column], labels: Mapping[str, str]) -> dict[str, Column]:
    """Per feature over max -> min(.25, .10 o), over p95 -> min(.10, .05 o); o scaled by max(max - p95, 1);
    two or more stressed features multiply the sum by 1 + .3 (n - 1); result capped at .99.

    ``values`` maps feature -> scenario value column; bounds are columns ``<f>_max`` / ``<f>_p95``.
    """
    bonuses, details = [], []
    for f, v in values.items():
        mx, p95 = F.col(f"{f}_max"), F.col(f"{f}_p95")
        span = F.greatest(mx - p95, F.lit(1.0))
        over_max = v > mx
        over_p95 = v > p95
        bonus = (F.when(over_max, F.least(F.lit(0.25), (v - mx) / span * 0.10))
                 .when(over_p95, F.least(F.lit(0.10), (v - p95) / span * 0.05)).otherwise(F.lit(0.0)))
        bonuses.append(F.coalesce(bonus, F.lit(0.0)))
        details.append(F.when(over_max, F.format_string("%s (%s) above observed max (%s)", F.lit(labels.get(f, f)),
                                                       int_text(v), int_text(mx)))
                       .when(over_p95, F.format_string("%s (%s) above 95th percentile (%s)", F.lit(labels.get(f, f)),
                                                       int_text(v), int_text(p95))))
    det = F.array_compact(F.array(*details))
    total = bonuses[0]
    for b in bonuses[1:]:
        total = total + b
    n = F.size(det)
    total = F.when(n >= 2, total * (1 + 0.3 * (n - 1))).otherwise(total)
    return {"stress": total, "stress_details": det, "n_stressed": n.cast("int"),
            "stressed_probability": F.least(F.lit(P_CAP), _c(p) + total)}


def last_n_rows(df: DataFrame, keys: Sequence[str], order: str, n: int = LIVE_WINDOW_ROWS) -> DataFrame:
    """The last ``n`` rows per key, also where the series has gaps.  Spark keeps at most ``n`` rows of a key
    in each task before the shuffle (a partial group limit), so a long series doesn't meet in one task."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_alert(window_rows: DataFrame, keys: Sequence[str], ts: str, p: str) -> DataFrame:
    """Per key, the first row with p > 0.5 (hours from the last row, floored at 0), else the
    highest p (earliest on ties) with the absolute distance in hours."""
    keys = list(keys)
    t = micros_index(ts)
    d = window_rows.withColumn("_t", t)
    agg = d.groupBy(*keys).agg(
        F.max("_t").alias("_last"),
        F.min_by(F.struct(F.col("_t").alias("t"), F.col(p).alias("p")),
                 F.when(F.col(p) > ALERT_P, F.col("_t"))).alias("_first"),
        F.max_by(F.struct(F.col("_t").alias("t"), F.col(p).alias("p")),
                 F.struct(F.col(p), -F.col("_t"))).alias("_peak"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    has_alert = F.col("_first").isNotNull()
    pick = F.when(has_alert, F.col("_first")).otherwise(F.col("_peak"))
    hours = (pick["t"] - F.col("_last")) / F.lit(3_600_000_000)
    return agg.select(
        *keys, "n_rows",
        has_alert.alias("has_alert"),
        pick["p"].alias("peak_probability"),
        F.when(has_alert, F.greatest(F.lit(0.0), hours)).otherwise(F.abs(hours)).alias("hours_away"),
    )


def latest_row(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """The newest row per key via max_by (a sort-based aggregate on structs; no window)."""
    keys = list(keys)
    s = F.max_by(F.struct(*[F.col(c) for c in [order, *cols]]), F.col(order)).alias("_r")
    return df.groupBy(*keys).agg(s).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [order, *cols]])


def site_stats(df: DataFrame, keys: Sequence[str], ts: str, flag: str, load: str) -> DataFrame:
    """Rows, outage count and rate, mean and max load, first and last day."""
    keys = list(keys)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(flag).cast("long")).alias("n_outages"),
        F.avg(F.col(flag).cast("double")).alias("outage_rate"),
        F.avg(load).alias("mean_load_kw"),
        F.max(load).alias("max_load_kw"),
        F.to_date(F.min(ts)).alias("first_day"),
        F.to_date(F.max(ts)).alias("last_day"),
    )
