"""Scoring, stress, scenarios, live-window queries (R1-R13, A7, J5, W11, W13, W14) with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from outagelens.functions.numeric import rnd_sql
from outagelens.operators import features as FE
from outagelens.operators import linear as LIN
from outagelens.operators import scenarios as SC
from outagelens.operators import scoring as R
from outagelens.operators.context import PROFILE_DEFAULTS, lookup_with_default
from outagelens.plans import oracle_sql as S
from outagelens.plans import pipeline as P
from outagelens.plans.registry import out, register
from outagelens.session import materialised
from outagelens.sources import bindings
from outagelens.sources.scored import scored_lines
from outagelens.sources.tables import read_table


def r1(e):
    return rnd_sql(e, 1)


def r4(e):
    return rnd_sql(e, 4)


def r6(e):
    return rnd_sql(e, 6)


def heur_sql(p: str) -> str:
    return (f"{r4(p)} AS outage_probability, "
            f"{r1(f'CASE WHEN {p} > 0.5 THEN greatest(1.0, (1 - {p}) * 24) ELSE 24 + (1 - {p}) * 48 END')} AS estimated_hours_to_outage, "
            f"{r1(f'CASE WHEN {p} > 0.5 THEN 1 + {p} * 4 ELSE 0.0 END')} AS estimated_outage_duration_h")


def band_sql(p: str) -> str:
    return f"CASE WHEN {p} > 0.7 THEN 'high' WHEN {p} > 0.4 THEN 'medium' ELSE 'low' END"


def rel_band_sql(r: str) -> str:
    return (f"CASE WHEN {r} < 30 THEN 'critical' WHEN {r} < 55 THEN 'low' WHEN {r} < 80 THEN 'moderate' "
            f"ELSE 'good' END")


@register("score_heuristics", """WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_discount * 10 AS DOUBLE) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, """ + heur_sql("p") + ", " + band_sql("p") + " AS risk_band FROM s")
def q_score_heuristics(spark, sf_dir):
    s = scored_lines(spark, sf_dir, ["discount"])
    d = s.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in R.heuristics("score").items()],
                 R.risk_band("score").alias("risk_band"))
    return d


@register("risk_bands", """WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS label,
  'discount' AS model, CAST(l_discount * 10 AS DOUBLE) AS score FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER), 'tax', CAST(l_tax * 12.5 AS DOUBLE) FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER), 'quantity', CAST(l_quantity / 50 AS DOUBLE) FROM lineitem)
SELECT model, """ + band_sql("score") + """ AS risk_band, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positive FROM s GROUP BY 1, 2""")
def q_risk_bands(spark, sf_dir):
    s = scored_lines(spark, sf_dir)
    return s.groupBy("model", R.risk_band("score").alias("risk_band")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("n_positive"))


def with_profile(df, prof):
    """A site without a profile, or with fields missing in it, gets the defaults."""
    fields = ["who_reliability", "grid_stability", "has_solar", "has_generator"]
    return lookup_with_default(df, prof.select("site_id", *fields), "site_id",
                               {f: PROFILE_DEFAULTS[f] for f in ("who_reliability", "grid_stability")})


PROFILE_LATERAL = """SELECT COALESCE(prof0.rel0, 50.0) AS who_reliability, prof0.solar0 AS has_solar, prof0.gen0 AS has_generator,
  COALESCE(prof0.stab0, 'moyen') AS grid_stability"""

PROFILE_SQL = """prof0 AS (
  SELECT c_custkey AS site_id, abs(c_acctbal) % 100 AS rel0,
    c_mktsegment <> 'AUTOMOBILE' AS solar0, c_mktsegment <> 'BUILDING' AS gen0,
    CASE WHEN c_acctbal < 1000 THEN 'faible' WHEN c_acctbal < 5000 THEN 'moyen' ELSE 'stable' END AS stab0
  FROM customer)"""


def adjust_sql(p: str) -> str:
    return f"least(0.99, greatest(0.01, {p} * (1 + (50.0 - who_reliability) / 100 * 1.5)))"


def int_text_sql(x: str) -> str:
    return f"CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR)"


def notes_sql() -> str:
    r = "who_reliability"
    rel = (f"CASE WHEN {r} < 30 THEN 'grid ' || grid_stability || ' - very low reliability (' || {int_text_sql(r)} || '%)' "
           f"WHEN {r} < 55 THEN 'grid ' || grid_stability || ' - low reliability (' || {int_text_sql(r)} || '%)' "
           f"WHEN {r} > 90 THEN 'grid ' || grid_stability || ' - high reliability (' || {int_text_sql(r)} || '%)' END")
    parts = [rel, "CASE WHEN NOT COALESCE(has_solar, false) THEN 'no solar panels' END",
             "CASE WHEN NOT COALESCE(has_generator, false) THEN 'no backup generator' END"]
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), '; ')"


@register("profile_adjust", "WITH " + PROFILE_SQL + """,
s AS (SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_discount * 10 AS DOUBLE) AS p, o.o_custkey AS site_id
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)
SELECT s.l_orderkey, s.l_linenumber, s.site_id, """ + r6(adjust_sql("s.p")) + """ AS adjusted_probability,
  """ + rel_band_sql("who_reliability") + """ AS reliability_band, """ + notes_sql() + """ AS notes
FROM s LEFT JOIN prof0 ON prof0.site_id = s.site_id CROSS JOIN LATERAL (""" + PROFILE_LATERAL + """) prof""")
def q_profile_adjust(spark, sf_dir):
    li = scored_lines(spark, sf_dir, ["discount"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    prof = bindings.site_profiles(spark, sf_dir)
    d = with_profile(li.join(o, li.l_orderkey == o.o_orderkey).withColumnRenamed("o_custkey", "site_id"), prof)
    adj = R.adjust_for_profile("score", "who_reliability", "grid_stability", "has_solar", "has_generator")
    d = d.select("l_orderkey", "l_linenumber", "site_id", adj["adjusted_probability"].alias("adjusted_probability"),
                 R.reliability_band("who_reliability").alias("reliability_band"),
                 F.array_join(adj["notes"], "; ").alias("notes"))
    return out(d, ["l_orderkey", "l_linenumber", "site_id", "adjusted_probability", "reliability_band", "notes"])


# ---------------------------------------------------------------- bounds, nearest history, scenarios

STRESS = list(R.STRESS_FEATURES)


def bounds_sql_ctes(src: str = "merged") -> list[str]:
    mx = ", ".join(f"max({f}) AS {f}_max" for f in STRESS)
    return [*S.percentile_ctes("sp95", src, ["site_id"], STRESS, 0.95),
            f"smax AS (SELECT site_id, {mx} FROM {src} GROUP BY site_id)",
            "sbounds AS (SELECT * FROM smax JOIN sp95 USING (site_id))"]


BOUNDS_COLS = ["site_id"] + [f"{f}_{s}" for f in STRESS for s in ("max", "p95")]


@register("bounds_p95", S.with_(*S.MERGED_CHAIN, *bounds_sql_ctes()) + S.select_rounded(
    BOUNDS_COLS, "sbounds", keep=("site_id",)))
def q_bounds_p95(spark, sf_dir):
    return out(R.stress_bounds(P.merged_table(spark, sf_dir)), BOUNDS_COLS)


K_SQL = lambda x: f"CAST({x} AS DOUBLE)"

SCEN_SQL = f"""scen AS (
  SELECT c_custkey AS scenario_id, c_custkey AS site_id,
    CAST(c_custkey % 24 AS INTEGER) AS hour, CAST(c_custkey % 12 + 1 AS INTEGER) AS month,
    CAST(c_custkey % 7 AS INTEGER) AS day_of_week,
    abs(c_acctbal) / 10 AS total_load_kw,
    CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN abs(c_acctbal) / 10 * {K_SQL(0.3)} ELSE 0.0 END AS solar_pv_kw,
    abs(c_acctbal) / 10 * {K_SQL(0.85)} AS base_load_kw, abs(c_acctbal) / 10 * {K_SQL(0.06)} AS sterilization_kw,
    {K_SQL(15.0)} + c_nationkey * {K_SQL(1.5)} AS temperature_2m, {K_SQL(40.0)} + c_nationkey * 2 AS humidity,
    abs(c_acctbal) % 120 AS wind_speed, abs(c_acctbal) % 37 AS precipitation, {K_SQL(1013.0)} AS pressure,
    abs(c_acctbal) % 900 AS radiation
  FROM customer)"""

NEAREST_SQL = """obs AS (SELECT site_id, avg(total_load_kw) AS obs FROM merged m GROUP BY site_id),
target AS (SELECT c_custkey AS site_id, abs(c_acctbal) / 20 + 10 AS avg_load_kw FROM customer),
scenl AS (SELECT s.*, CASE WHEN o.site_id IS NULL THEN r.site_id ELSE s.site_id END AS look_site,
    CASE WHEN o.site_id IS NULL THEN COALESCE(t.avg_load_kw, 133.0) / greatest(r.obs, 1.0) ELSE 1.0 END AS scale
  FROM scen s CROSS JOIN (SELECT * FROM obs ORDER BY site_id LIMIT 1) r
  LEFT JOIN obs o ON o.site_id = s.site_id LEFT JOIN target t ON t.site_id = s.site_id),
near_c AS (
  SELECT s.scenario_id, s.site_id, s.look_site, s.scale, m.hidx,
    3.0 * abs(m.hour - s.hour) + 1.0 * abs(m.month - s.month) + abs(m.total_load_kw * s.scale - s.total_load_kw) / 30.0 AS score
  FROM scenl s JOIN merged m ON m.site_id = s.look_site),
near AS (SELECT scenario_id, site_id, look_site, scale, hidx, score FROM (
  SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY score, hidx) AS rk FROM near_c) WHERE rk = 1)"""


@register("nearest_history", S.with_(*S.MERGED_CHAIN, SCEN_SQL, NEAREST_SQL) + S.select_rounded(
    ["scenario_id", "site_id", "look_site", "scale", "hidx", "score"], "near",
    keep=("scenario_id", "site_id", "look_site", "hidx")))
def q_nearest_history(spark, sf_dir):
    # the weather plays no part in the choice
    m = FE.calendar_features(P.filled_grid(spark, sf_dir)).select("site_id", "hidx", "hour", "month", "total_load_kw")
    m = materialised(m, "history")
    scen = SC.with_lookup(bindings.scenarios(spark, sf_dir), m, bindings.site_profiles(spark, sf_dir))
    return out(SC.nearest_history(scen, m), ["scenario_id", "site_id", "look_site", "scale", "hidx", "score"])


def scen_row_sql(src_scen: str, name: str) -> str:
    """Scenario rows (R7) in SQL: nearest feature row with parameters written over it."""
    return f"""{name} AS (
  SELECT n.scenario_id, n.site_id, n.look_site, n.scale, n.hidx, s.total_load_kw, s.solar_pv_kw, s.base_load_kw, s.sterilization_kw,
    s.temperature_2m, s.humidity AS relative_humidity_2m, s.wind_speed AS wind_speed_10m,
    s.precipitation, s.pressure AS surface_pressure, s.radiation AS shortwave_radiation,
    s.hour, s.month, s.day_of_week, CAST(s.day_of_week >= 5 AS INTEGER) AS is_weekend,
    sin(2 * pi() * s.hour / 24) AS hour_sin, cos(2 * pi() * s.hour / 24) AS hour_cos,
    sin(2 * pi() * s.month / 12) AS month_sin, cos(2 * pi() * s.month / 12) AS month_cos,
    s.solar_pv_kw / greatest(s.total_load_kw, 1.0) AS solar_ratio,
    s.base_load_kw / greatest(s.total_load_kw, 1.0) AS base_load_ratio,
    s.total_load_kw / greatest(f.load_rolling_24h * n.scale, 1.0) AS peak_ratio,
    s.temperature_2m * s.humidity / 100 AS temp_humidity_interaction,
    s.wind_speed * s.precipitation AS wind_precipitation_interaction,
    CAST(s.radiation > 50 AS INTEGER) AS solar_available, CAST(s.temperature_2m > 30 AS INTEGER) AS heat_stress,
    f.load_std_24h * n.scale AS load_std_24h, f.load_rolling_24h * n.scale AS load_rolling_24h, f.storm_risk
  FROM {src_scen} n JOIN {src_scen.replace('near', 'scen')} s ON s.scenario_id = n.scenario_id
  JOIN ft f ON f.site_id = n.look_site AND f.hidx = n.hidx)"""


SCEN_ROW_COLS = ["scenario_id", "site_id", "hidx", "total_load_kw", "solar_pv_kw", "base_load_kw",
                 "sterilization_kw", "temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation",
                 "surface_pressure", "shortwave_radiation", "hour", "month", "day_of_week", "is_weekend",
                 "hour_sin", "hour_cos", "month_sin", "month_cos", "solar_ratio", "base_load_ratio", "peak_ratio",
                 "temp_humidity_interaction", "wind_precipitation_interaction", "solar_available", "heat_stress",
                 "load_std_24h", "load_rolling_24h", "storm_risk"]
SCEN_INTS = {"hour", "month", "day_of_week", "is_weekend", "solar_available", "heat_stress", "storm_risk"}


def shared_features(spark, sf_dir):
    """What scenarios take from the feature table (history, rows, bounds): written once for all branches of a query."""
    return materialised(P.features(spark, sf_dir).select(
        "site_id", "hidx", "hour", "month", *STRESS, "load_rolling_24h", "load_std_24h", "storm_risk"), "features")


def _scenario_rows(spark, sf_dir, scen=None, feats=None):
    feats = feats if feats is not None else shared_features(spark, sf_dir)
    scen = scen if scen is not None else bindings.scenarios(spark, sf_dir)
    scen = SC.with_lookup(scen, feats, bindings.site_profiles(spark, sf_dir))
    near = SC.nearest_history(scen, feats)
    return SC.scenario_rows(scen, feats, near)


@register("scenario_rows", S.with_(*S.FEATURE_CHAIN, SCEN_SQL, NEAREST_SQL.replace("merged m", "ft m"),
                                   scen_row_sql("near", "srow"))
          + S.select_rounded(SCEN_ROW_COLS, "srow", ints=SCEN_INTS, keep=("scenario_id", "site_id", "hidx")))
def q_scenario_rows(spark, sf_dir):
    return out(_scenario_rows(spark, sf_dir), SCEN_ROW_COLS)


STRESS_LABELS = {"total_load_kw": "load", "temperature_2m": "temperature", "wind_speed_10m": "wind",
                 "precipitation": "precipitation"}


def stress_sql() -> str:
    terms, dets = [], []
    vals = {"total_load_kw": "s.total_load_kw", "temperature_2m": "s.temperature_2m",
            "wind_speed_10m": "s.wind_speed_10m", "precipitation": "s.precipitation"}
    for f, v in vals.items():
        mx, p95 = f"b.{f}_max", f"b.{f}_p95"
        span = f"greatest({mx} - {p95}, 1.0)"
        terms.append(f"COALESCE(CASE WHEN {v} > {mx} THEN least(0.25, ({v} - {mx}) / {span} * 0.1) "
                     f"WHEN {v} > {p95} THEN least(0.1, ({v} - {p95}) / {span} * 0.05) ELSE 0.0 END, 0.0)")
        dets.append(f"CASE WHEN {v} > {mx} OR {v} > {p95} THEN 1 ELSE 0 END")
    total = "(" + " + ".join(terms) + ")"
    n = "(" + " + ".join(dets) + ")"
    return total, n


_ST, _SN = stress_sql()


STRESS_CTES = [*S.FEATURE_CHAIN, *bounds_sql_ctes("ft"), SCEN_SQL,
               NEAREST_SQL.replace("merged m", "ft m"), scen_row_sql("near", "srow"), PROFILE_SQL,
               "sb AS (SELECT r.scenario_id, b.* EXCLUDE (site_id) REPLACE (b.total_load_kw_max * r.scale AS total_load_kw_max, "
               "b.total_load_kw_p95 * r.scale AS total_load_kw_p95) FROM srow r JOIN sbounds b ON b.site_id = r.look_site)",
               f"""sc AS (SELECT s.scenario_id, s.site_id, {LIN.probability_sql()} AS p_model,
  CASE WHEN {_SN} >= 2 THEN {_ST} * (1 + 0.3 * ({_SN} - 1)) ELSE {_ST} END AS stress, {_SN} AS n_stressed
  FROM srow s JOIN sb b ON b.scenario_id = s.scenario_id),
sc2 AS (SELECT sc.*, least(0.99, p_model + stress) AS p_stressed FROM sc),
sc3 AS (SELECT sc2.*, {adjust_sql('p_stressed')} AS probability FROM sc2 LEFT JOIN prof0 ON prof0.site_id = sc2.site_id
  CROSS JOIN LATERAL ({PROFILE_LATERAL}) prof)"""]


@register("stress_score", S.with_(*STRESS_CTES) + f"""
SELECT scenario_id, site_id, {r6('p_model')} AS p_model, {r6('stress')} AS stress, CAST(n_stressed AS INTEGER) AS n_stressed,
  {r6('p_stressed')} AS p_stressed, {r6('probability')} AS probability,
  greatest(1.0, {rnd_sql('(1 - probability) * 24', 0)}) AS hours_to_outage,
  CASE WHEN probability > 0.5 THEN {r1('1 + probability * 4')} ELSE 0.5 END AS duration_h,
  {band_sql('probability')} AS risk_band
FROM sc3""")
def q_stress_score(spark, sf_dir):
    return out(stress_scores(spark, sf_dir), STRESS_OUT)


def stress_text_sql() -> str:
    """The texts of the stressed features, in their order."""
    texts = []
    for f in STRESS:
        v, mx, p95 = f"s.{f}", f"b.{f}_max", f"b.{f}_p95"
        say = lambda what, bound: f"'{STRESS_LABELS[f]} (' || {int_text_sql(v)} || ') above {what} (' || {int_text_sql(bound)} || ')'"  # noqa: E731, B023
        texts.append(f"CASE WHEN {v} > {mx} THEN {say('observed max', mx)} WHEN {v} > {p95} THEN {say('95th percentile', p95)} END")
    return "array_to_string(list_filter([" + ", ".join(texts) + "], lambda x: x IS NOT NULL), '; ')"


@register("stress_texts", S.with_(*STRESS_CTES) + f"""
SELECT s.scenario_id, s.site_id, {stress_text_sql()} AS texts FROM srow s JOIN sb b ON b.scenario_id = s.scenario_id""")
def q_stress_texts(spark, sf_dir):
    """What is out of range in each scenario, as text."""
    return stress_scores(spark, sf_dir).select("scenario_id", "site_id", F.array_join("stress_details", "; ").alias("texts"))


STRESS_OUT = ["scenario_id", "site_id", "p_model", "stress", "n_stressed", "p_stressed", "probability",
              "hours_to_outage", "duration_h", "risk_band"]


def stress_scores(spark, sf_dir, scen=None, with_stress=True, feats=None):
    feats = feats if feats is not None else shared_features(spark, sf_dir)
    return scored_rows(spark, sf_dir, _scenario_rows(spark, sf_dir, scen, feats), feats, with_stress)


def scored_rows(spark, sf_dir, rows, feats, with_stress=True):
    """Scenario rows with the model's probability, stress (from the bounds of ``feats``) and the site's adjustment."""
    d = rows.withColumn("p_model", LIN.probability())
    if with_stress:
        bounds = R.stress_bounds(feats)
        # bounds of the series that serves; a borrowed one is rescaled, so its load bounds are too
        d = d.join(bounds.withColumnRenamed("site_id", "look_site"), "look_site", "left")
        d = d.withColumns({f"total_load_kw_{s}": F.col(f"total_load_kw_{s}") * F.col("scale") for s in ("max", "p95")})
        st = R.extrapolation_stress("p_model", {f: F.col(f) for f in STRESS}, STRESS_LABELS)
        d = d.withColumns({"stress": st["stress"], "n_stressed": st["n_stressed"],
                           "p_stressed": st["stressed_probability"], "stress_details": st["stress_details"]})
    else:
        d = d.withColumns({"stress": F.lit(0.0), "n_stressed": F.lit(0), "p_stressed": F.col("p_model")})
    prof = bindings.site_profiles(spark, sf_dir)
    d = with_profile(d, prof)
    adj = R.adjust_for_profile("p_stressed", "who_reliability", "grid_stability", "has_solar", "has_generator")
    d = d.withColumn("probability", adj["adjusted_probability"])
    return d.withColumns({**R.scenario_heuristics("probability"), "risk_band": R.risk_band("probability")})


REF_SCEN_SQL = f"""scen AS (
  SELECT c_custkey AS scenario_id, c_custkey AS site_id, 12 AS hour, 6 AS month, 2 AS day_of_week,
    abs(c_acctbal) / 20 + 10 AS total_load_kw,
    CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN (abs(c_acctbal) / 20 + 10) * {K_SQL(0.3)} ELSE 0.0 END AS solar_pv_kw,
    (abs(c_acctbal) / 20 + 10) * {K_SQL(0.85)} AS base_load_kw, (abs(c_acctbal) / 20 + 10) * {K_SQL(0.06)} AS sterilization_kw,
    {K_SQL(25.0)} AS temperature_2m, {K_SQL(70.0)} AS humidity, {K_SQL(10.0)} AS wind_speed, {K_SQL(0.0)} AS precipitation,
    {K_SQL(1013.0)} AS pressure, {K_SQL(200.0)} AS radiation
  FROM customer)"""


def _reference_sql() -> list[str]:
    """CTEs scoring each site's reference scenario (no stress: the reference scenario skips it)."""
    near = (NEAREST_SQL.replace("merged m", "ft m").replace("FROM scen s", "FROM rscen s")
            .replace("near_c", "rnear_c").replace("near AS", "rnear AS").replace("scenl", "rscenl")
            .replace("obs AS (", "robs AS (").replace("FROM obs ", "FROM robs ").replace("JOIN obs ", "JOIN robs ")
            .replace("target AS (", "rtarget AS (").replace("JOIN target ", "JOIN rtarget "))
    return [REF_SCEN_SQL.replace("scen AS", "rscen AS"), near, scen_row_sql("rnear", "rsrow"),
            f"""rp AS (SELECT s.site_id, {adjust_sql(LIN.probability_sql())} AS probability
  FROM rsrow s LEFT JOIN prof0 ON prof0.site_id = s.site_id CROSS JOIN LATERAL ({PROFILE_LATERAL}) prof)"""]


@register("scenario_delta", S.with_(*STRESS_CTES, *_reference_sql()) + f"""
SELECT sc3.scenario_id, sc3.site_id, {r6('sc3.probability')} AS probability,
  {r6('rp.probability')} AS reference_probability, {r6('sc3.probability - rp.probability')} AS delta
FROM sc3 LEFT JOIN rp ON rp.site_id = sc3.site_id""")
def q_scenario_delta(spark, sf_dir):
    """Scenario (with stress) against the site's reference scenario (without stress)."""
    feats = shared_features(spark, sf_dir)
    # the history is searched once for both; ids 2i and 2i + 1. Written, as both scores read the rows and its shuffles can go
    numbered = [d.withColumn("scenario_id", F.col("scenario_id").cast("long") * 2 + kind) for kind, d in enumerate((
        bindings.scenarios(spark, sf_dir), SC.reference_scenarios(bindings.site_profiles(spark, sf_dir))))]
    rows = materialised(_scenario_rows(spark, sf_dir, numbered[0].unionByName(numbered[1]), feats), "scenario-rows")
    scen, ref = (rows.where(F.pmod("scenario_id", F.lit(2)) == kind).withColumn("scenario_id", F.shiftright("scenario_id", 1)) for kind in (0, 1))
    scen = scored_rows(spark, sf_dir, scen, feats).select("scenario_id", "site_id", "probability")
    ref = scored_rows(spark, sf_dir, ref, feats, with_stress=False).select("site_id", "probability")
    d = SC.delta(scen, ref, ["site_id"])
    return out(d, ["scenario_id", "site_id", "probability", "reference_probability", "delta"])


# ---------------------------------------------------------------- live window

def _live(spark, sf_dir):
    f = P.filled_grid(spark, sf_dir)
    return f.withColumn("p", F.least(F.lit(1.0), F.col("total_load_kw") / F.lit(500.0)))


LIVE_SQL = """live AS (SELECT *, least(1.0, total_load_kw / 500.0) AS p FROM filled),
last72 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY hidx DESC) AS rn FROM live) WHERE rn <= 72)"""


@register("last_n_window", S.with_(*S.FILLED_CHAIN, LIVE_SQL) + S.select_rounded(
    ["site_id", "hidx", "hour_ts", "total_load_kw", "p"], "last72", keep=("site_id", "hidx", "hour_ts")))
def q_last_n_window(spark, sf_dir):
    return out(R.last_n_rows(_live(spark, sf_dir), ["site_id"], "hidx"), ["site_id", "hidx", "hour_ts", "total_load_kw", "p"])


@register("first_alert", S.with_(*S.FILLED_CHAIN, LIVE_SQL, PROFILE_SQL) + """,
agg AS (SELECT site_id, count(*) AS n_rows, max(hidx) AS last_h,
  min(CASE WHEN p > 0.5 THEN hidx END) AS alert_h,
  arg_max(hidx, [p, -hidx]) AS peak_h FROM last72 GROUP BY site_id),
pk AS (SELECT a.site_id, a.n_rows, a.alert_h IS NOT NULL AS has_alert, COALESCE(a.alert_h, a.peak_h) AS pick_h, a.last_h
  FROM agg a),
res AS (SELECT pk.*, l.p AS peak_probability FROM pk JOIN last72 l ON l.site_id = pk.site_id AND l.hidx = pk.pick_h),
adj AS (SELECT res.*, """ + adjust_sql("peak_probability") + """ AS adjusted_probability FROM res LEFT JOIN prof0 ON prof0.site_id = res.site_id
  CROSS JOIN LATERAL (""" + PROFILE_LATERAL + """) prof)
SELECT site_id, n_rows, has_alert, """ + r6("peak_probability") + """ AS peak_probability,
  """ + r6("CASE WHEN has_alert THEN greatest(0.0, CAST(pick_h - last_h AS DOUBLE)) ELSE abs(CAST(pick_h - last_h AS DOUBLE)) END") + """ AS hours_away,
  """ + r6("adjusted_probability") + """ AS adjusted_probability,
  CASE WHEN adjusted_probability > 0.5 THEN """ + r1("1 + adjusted_probability * 4") + """ ELSE 0.5 END AS duration_h
FROM adj""")
def q_first_alert(spark, sf_dir):
    last = R.last_n_rows(_live(spark, sf_dir), ["site_id"], "hidx")
    fa = R.first_alert(last, ["site_id"], "hour_ts", "p")
    prof = bindings.site_profiles(spark, sf_dir)
    d = with_profile(fa, prof)
    adj = R.adjust_for_profile("peak_probability", "who_reliability", "grid_stability", "has_solar", "has_generator")
    d = d.withColumn("adjusted_probability", adj["adjusted_probability"])
    d = d.withColumn("duration_h", F.when(F.col("adjusted_probability") > 0.5,
                                          F.floor((1 + F.col("adjusted_probability") * 4) * 10 + 0.5) / 10)
                     .otherwise(F.lit(0.5)))
    return out(d, ["site_id", "n_rows", "has_alert", "peak_probability", "hours_away", "adjusted_probability", "duration_h"])


@register("latest_row", S.with_(*S.FILLED_CHAIN) + """,
lr AS (SELECT site_id, arg_max(hidx, hidx) AS hidx FROM filled GROUP BY site_id)
SELECT f.site_id, f.hidx, f.hour_ts, """ + r6("f.total_load_kw") + """ AS total_load_kw, f.is_outage
FROM filled f JOIN lr ON lr.site_id = f.site_id AND lr.hidx = f.hidx""")
def q_latest_row(spark, sf_dir):
    d = R.latest_row(P.filled_grid(spark, sf_dir), ["site_id"], "hidx", ["hour_ts", "total_load_kw", "is_outage"])
    return out(d, ["site_id", "hidx", "hour_ts", "total_load_kw", "is_outage"])


@register("site_stats", S.with_(*S.FILLED_CHAIN) + """
SELECT site_id, count(*) AS n_rows, CAST(sum(is_outage) AS BIGINT) AS n_outages,
  """ + r6("avg(CAST(is_outage AS DOUBLE))") + """ AS outage_rate, """ + r6("avg(total_load_kw)") + """ AS mean_load_kw,
  """ + r6("max(total_load_kw)") + """ AS max_load_kw, CAST(min(hour_ts) AS DATE) AS first_day, CAST(max(hour_ts) AS DATE) AS last_day
FROM filled GROUP BY site_id""")
def q_site_stats(spark, sf_dir):
    d = R.site_stats(P.filled_grid(spark, sf_dir), ["site_id"], "hour_ts", "is_outage", "total_load_kw")
    return out(d, ["site_id", "n_rows", "n_outages", "outage_rate", "mean_load_kw", "max_load_kw", "first_day", "last_day"])
