"""Registered queries: name -> (spark builder, oracle SQL or None).

Every builder takes (spark, sf_dir) and reads whole tables through the bindings.
Column names and types match the SQL twin; doubles are rounded half-up to 6 digits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from outagelens.operators import features as FE
from outagelens.operators.context import coverage_anti, stage_stats, stage_time_weighted, latest_fact
from outagelens.operators.resample import hourly_resample
from outagelens.plans import oracle_sql as S
from outagelens.plans import pipeline as P
from outagelens.sources import bindings
from outagelens.sources.tables import read_table

from outagelens.plans.registry import REGISTRY, Builder, register
from outagelens.plans.registry import out as _out


GRID_COLS = S.GRID_COLS
MEASURES = S.POWER + ["grid_availability_ratio", "is_outage"]

# ---------------------------------------------------------------- resample, spine, fill


@register("hourly_resample", S.with_(S.READINGS, S.HOURLY) + S.select_rounded(
    ["site_id", "hidx", "hour_ts"] + MEASURES,
    f"(SELECT *, {S.HOUR_TS.format(x='hidx')} AS hour_ts FROM hourly)",
    ints={"is_outage"}, keep=("site_id", "hidx", "hour_ts")))
def q_hourly_resample(spark, sf_dir):
    return _out(hourly_resample(bindings.meter_readings(spark, sf_dir)), ["site_id", "hidx", "hour_ts"] + MEASURES)


@register("hourly_spine", S.with_(S.READINGS, S.HOURLY, S.GRID) + S.select_rounded(
    GRID_COLS, "grid", ints={"is_outage"}, keep=("site_id", "hidx", "hour_ts")))
def q_hourly_spine(spark, sf_dir):
    return _out(P.site_grid(spark, sf_dir), GRID_COLS)


@register("gap_interpolate", S.with_(*S.FILLED_CHAIN) + S.select_rounded(
    GRID_COLS, "filled", ints={"is_outage"}, keep=("site_id", "hidx", "hour_ts")))
def q_gap_interpolate(spark, sf_dir):
    return _out(P.filled_grid(spark, sf_dir), GRID_COLS)


ASOF_COLS = ["site_id", "hidx", "hour_ts"] + S.WEATHER


@register("asof_nearest", S.with_(S.READINGS, S.HOURLY, S.GRID, S.WEATHER_CTE) + S.select_rounded(
    ASOF_COLS, "(SELECT g.site_id, g.hidx, g.hour_ts, " + ", ".join("wx." + c for c in S.WEATHER)
    + " FROM grid g LEFT JOIN wx ON wx.site_id = g.site_id AND wx.hidx = g.hidx)",
    keep=("site_id", "hidx", "hour_ts")))
def q_asof_nearest(spark, sf_dir):
    g = P.site_grid(spark, sf_dir).select("site_id", "hidx", "hour_ts")
    return _out(P.with_weather(g, bindings.weather_readings(spark, sf_dir)), ASOF_COLS)


MERGED_INTS = {"is_outage", "loadshed_max_stage", "hour", "day_of_week", "month", "country_code"}


@register("merged_table", S.with_(*S.MERGED_CHAIN) + S.select_rounded(
    S.MERGED_COLS, "merged", ints=MERGED_INTS, keep=("site_id", "hidx", "hour_ts")))
def q_merged_table(spark, sf_dir):
    return _out(P.merged_table(spark, sf_dir), S.MERGED_COLS)


# ---------------------------------------------------------------- feature blocks

def _feature_sql(chain: list[str], src: str, exprs: dict[str, str], ints: set[str]) -> str:
    inner = f"(SELECT site_id, hidx, {', '.join(f'{e} AS {n}' for n, e in exprs.items())} FROM {src})"
    return S.with_(*chain) + S.select_rounded(["site_id", "hidx"] + list(exprs), inner, ints=ints,
                                              keep=("site_id", "hidx"))


CAL = {"hour": "CAST(hour(hour_ts) AS INTEGER)", "day_of_week": "CAST(isodow(hour_ts) - 1 AS INTEGER)",
       "month": "CAST(month(hour_ts) AS INTEGER)"}


@register("calendar_features", _feature_sql(S.FILLED_CHAIN, "filled", CAL, {"hour", "day_of_week", "month"}))
def q_calendar(spark, sf_dir):
    return _out(FE.calendar_features(P.site_grid(spark, sf_dir)), ["site_id", "hidx", "hour", "day_of_week", "month"])


_CYC_SRC = "(SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in CAL.items()) + " FROM filled)"


@register("cyclic_features", _feature_sql(S.FILLED_CHAIN, _CYC_SRC, S.cyclic_exprs(), {"is_weekend"}))
def q_cyclic(spark, sf_dir):
    df = FE.cyclic_features(FE.calendar_features(P.site_grid(spark, sf_dir)))
    return _out(df, ["site_id", "hidx"] + list(S.cyclic_exprs()))


def _load_subset(names: list[str]) -> dict[str, str]:
    e = S.load_feature_exprs()
    return {n: e[n] for n in names}


def _window_query(names: list[str], history: bool = False) -> Builder:
    def q(spark, sf_dir):
        df = FE.window_features(P.filled_grid(spark, sf_dir, halo=FE.HALO_HOURS), load=not history, history=history)
        return _out(df, ["site_id", "hidx"] + names)
    return q


for _name, _cols in {
    "rolling_mean": ["load_rolling_6h", "load_rolling_24h"],
    "rolling_std": ["load_std_24h"],
    "lag_diff": ["load_diff_1h", "load_diff_24h"],
    "pct_change": ["load_pct_change_1h"],
    "peak_ratio": ["peak_ratio"],
    "load_features": list(S.load_feature_exprs()),
}.items():
    register(_name, _feature_sql(S.FILLED_CHAIN, "filled", _load_subset(_cols), set()))(_window_query(_cols))

register("recent_history", _feature_sql(S.FILLED_CHAIN, "filled", S.history_exprs(), set()))(
    _window_query(list(S.history_exprs()), history=True))


@register("source_ratios", _feature_sql(S.FILLED_CHAIN, "filled", S.source_exprs(), {"generator_active"}))
def q_source_ratios(spark, sf_dir):
    return _out(FE.source_ratios(P.filled_grid(spark, sf_dir)), ["site_id", "hidx"] + list(S.source_exprs()))


_THR = {k: v for k, v in S.weather_exprs().items() if k in ("solar_available", "heat_stress", "storm_risk")}
_INT = {k: v for k, v in S.weather_exprs().items() if k.endswith("interaction")}


@register("threshold_flags", _feature_sql(S.MERGED_CHAIN, "merged", _THR, set(_THR)))
def q_threshold_flags(spark, sf_dir):
    return _out(FE.weather_features(P.merged_table(spark, sf_dir)), ["site_id", "hidx"] + list(_THR))


@register("interactions", _feature_sql(S.MERGED_CHAIN, "merged", _INT, set()))
def q_interactions(spark, sf_dir):
    return _out(FE.weather_features(P.merged_table(spark, sf_dir)), ["site_id", "hidx"] + list(_INT))


FEATURE_COLS = S.FEATURE_COLS


@register("feature_table", S.feature_table_sql())
def q_feature_table(spark, sf_dir):
    return _out(P.features(spark, sf_dir), FEATURE_COLS)


# ---------------------------------------------------------------- context joins

@register("context_latest_lookup", S.with_(S.FACTS) + """
SELECT c.c_custkey AS site_id, c.c_nationkey AS country_code,
  """ + S.r6("COALESCE(la.who_reliability_pct, 50.0)") + """ AS who_reliability_pct,
  """ + S.r6("1 - COALESCE(la.who_reliability_pct, 50.0) / 100") + """ AS reliability_risk,
  la.who_year AS who_year
FROM customer c LEFT JOIN latest la ON la.country_code = c.c_nationkey""")
def q_context_latest(spark, sf_dir):
    from outagelens.operators.context import add_reliability_context
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).select(
        F.col("c_custkey").alias("site_id"), F.col("c_nationkey").alias("country_code"))
    facts = bindings.country_facts(spark, sf_dir)
    df = add_reliability_context(cust, facts)
    df = FE.reliability_risk(df)
    yr = latest_fact(facts).select("country_code", "who_year")
    df = df.join(yr, "country_code", "left")
    return _out(df, ["site_id", "country_code", "who_reliability_pct", "reliability_risk", "who_year"])


@register("stage_history_stats", S.with_(S.STAGES) + "SELECT * FROM sstats")
def q_stage_stats(spark, sf_dir):
    return stage_stats(bindings.stage_history(spark, sf_dir))


@register("stage_time_weighted", S.with_(S.STAGES) + """,
daily AS (SELECT CAST(created_at AS DATE) AS day, max(stage) AS stage FROM stages GROUP BY 1),
d AS (SELECT day, stage, COALESCE(datediff('day', day, lead(day) OVER (ORDER BY day)), 1) AS days FROM daily)
SELECT CAST(sum(days) AS BIGINT) AS days_total,
  CAST(sum(CASE WHEN stage > 0 THEN days ELSE 0 END) AS BIGINT) AS days_active,
  """ + S.r6("sum(CASE WHEN stage > 0 THEN days ELSE 0 END) / sum(days)") + """ AS active_share
FROM d""")
def q_stage_time_weighted(spark, sf_dir):
    return stage_time_weighted(bindings.stage_history(spark, sf_dir))


@register("country_coverage", """
SELECT d.doc_id, d.lang, d.source, d.n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_country_coverage(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id"])
    return coverage_anti(docs, labels, "doc_id")


from outagelens.plans import catalogue_eval  # noqa: E402,F401  (registers evaluation queries)
from outagelens.plans import catalogue_score  # noqa: E402,F401  (registers scoring queries)
from outagelens.plans import catalogue_misc  # noqa: E402,F401  (registers text/json/sink/profile queries)
from outagelens.plans import catalogue_attr  # noqa: E402,F401  (registers attribution queries)
from outagelens.plans import catalogue_train  # noqa: E402,F401  (registers model queries)
from outagelens.plans import catalogue_stumps  # noqa: E402,F401  (registers fits that SQL can check)
from outagelens.plans import catalogue_energy  # noqa: E402,F401  (registers energy queries)
from outagelens.plans import catalogue_io  # noqa: E402,F401  (registers reader and sink queries)
from outagelens.plans import catalogue_ingest  # noqa: E402,F401  (registers raw and tolerant ingest queries)


def queries() -> dict[str, Builder]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
