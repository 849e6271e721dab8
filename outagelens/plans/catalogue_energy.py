"""Energy queries: outage runs, storage size, load categories, balance, critical days, best threshold."""

from __future__ import annotations

from outagelens.functions.numeric import fixed_sql, rnd_sql
from outagelens.operators import linear as LIN
from outagelens.operators import metrics as M
from outagelens.operators import outages as O
from outagelens.plans import oracle_sql as S
from outagelens.plans import pipeline as P
from outagelens.plans.catalogue_eval import SCORED
from outagelens.plans.registry import out, register
from outagelens.sources.scored import scored_lines


def r6(e):
    return rnd_sql(e, 6)


def kw(c):
    return fixed_sql(f"coalesce({c}, 0)")


def parts_sql(src):
    return f"""parts AS (SELECT *, {kw('total_load_kw')} - vital_kw AS comfort_kw FROM (
  SELECT *, least({kw('base_load_kw')} + {kw('sterilization_kw')}, {kw('total_load_kw')}) AS vital_kw FROM {src}))"""


PARTS = parts_sql("filled")
RUNS = """numbered AS (SELECT *, hidx - row_number() OVER (PARTITION BY site_id ORDER BY hidx) AS island FROM parts WHERE is_outage = 1),
outage AS (SELECT site_id, min(hidx) AS "first", max(hidx) AS "last", count(*) AS length, CAST(sum(vital_kw) AS DOUBLE) AS vital_kwh,
  CAST(max(vital_kw) AS DOUBLE) AS peak_vital_kw FROM numbered GROUP BY site_id, island)"""


def _outages(spark, sf_dir):
    return O.outage_runs(P.filled_grid(spark, sf_dir))


@register("outage_runs", S.with_(*S.FILLED_CHAIN, PARTS, RUNS) +
          f'SELECT site_id, "first", "last", length, {r6("vital_kwh")} AS vital_kwh, {r6("peak_vital_kw")} AS peak_vital_kw FROM outage')
def q_outage_runs(spark, sf_dir):
    d = _outages(spark, sf_dir)
    return out(d, ["site_id", "first", "last", "length", "vital_kwh", "peak_vital_kw"])


@register("storage_size", S.with_(*S.FILLED_CHAIN, PARTS, RUNS) + f"""
SELECT site_id, count(*) AS n_runs, max(length) AS longest_h, CAST(sum(length) AS BIGINT) AS outage_h,
  {r6('max(vital_kwh) * 1.2')} AS capacity_kwh, {r6('max(peak_vital_kw) * 1.2')} AS power_kw FROM outage GROUP BY site_id""")
def q_storage_size(spark, sf_dir):
    return out(O.storage_size(_outages(spark, sf_dir)), ["site_id", "n_runs", "longest_h", "outage_h", "capacity_kwh", "power_kw"])


@register("load_segments", S.with_(*S.FILLED_CHAIN) + f"""
, dim AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in O.LOAD_CATEGORIES.items())}) t(part, category)),
lp AS (SELECT site_id, 'base_load_kw' AS part, {kw('base_load_kw')} AS kwh FROM filled
  UNION ALL SELECT site_id, 'sterilization_kw', {kw('sterilization_kw')} FROM filled
  UNION ALL SELECT site_id, 'rest_kw', greatest({kw('total_load_kw')} - {kw('base_load_kw')} - {kw('sterilization_kw')}, 0) FROM filled),
cat AS (SELECT site_id, coalesce(category, 'other') AS category, CAST(sum(kwh) AS DOUBLE) AS kwh FROM lp LEFT JOIN dim USING (part) GROUP BY 1, 2)
SELECT site_id, category, {r6('kwh')} AS kwh, {r6('coalesce(kwh / nullif(sum(kwh) OVER (PARTITION BY site_id), 0), 0)')} AS share FROM cat""")
def q_load_segments(spark, sf_dir):
    dim = spark.createDataFrame(list(O.LOAD_CATEGORIES.items()), "part string, category string")
    d = O.load_segments(P.filled_grid(spark, sf_dir), dim)
    return out(d, ["site_id", "category", "kwh", "share"])


BALANCE = ["site_id", "year", "month", "day", "level", "category", "kwh", "peak_kw", "balance_kwh", "share"]


@register("energy_balance", S.with_(*S.FILLED_CHAIN, PARTS) + f"""
, up AS (SELECT site_id, year, month, day, grouping_id(site_id, year, month, day) AS g, CAST(sum(vital_kw) AS DOUBLE) AS vital, CAST(sum(comfort_kw) AS DOUBLE) AS comfort,
    CAST(max({kw('total_load_kw')}) AS DOUBLE) AS peak_kw, sum({kw('solar_pv_kw')} + {kw('generators_kw')}) - sum(vital_kw) - sum(comfort_kw) AS balance
  FROM (SELECT *, CAST(year(hour_ts) AS INTEGER) AS year, CAST(month(hour_ts) AS INTEGER) AS month, CAST(day(hour_ts) AS INTEGER) AS day FROM parts)
  GROUP BY ROLLUP (site_id, year, month, day)),
rows AS (SELECT *, 'vital' AS category, vital AS kwh FROM up UNION ALL SELECT *, 'comfort', comfort FROM up)
SELECT site_id, year, month, day, CAST(CASE g WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 7 THEN 3 ELSE 4 END AS INTEGER) AS level, category,
  {r6('kwh')} AS kwh, {r6('peak_kw')} AS peak_kw, {r6('balance')} AS balance_kwh,
  {r6('coalesce(kwh / nullif(vital + comfort, 0), 0)')} AS share FROM rows""")
def q_energy_balance(spark, sf_dir):
    d = O.energy_balance(P.filled_grid(spark, sf_dir))
    return out(d, BALANCE)


@register("critical_days", S.with_(*S.FEATURE_CHAIN, parts_sql("ft")) + f"""
, risk AS (SELECT site_id, CAST(hour_ts AS DATE) AS day, {LIN.probability_sql()} AS p,
    CAST(vital_kw AS DOUBLE) AS vital FROM parts),
days AS (SELECT site_id, day, CAST(sum({fixed_sql('p * vital')}) AS DOUBLE) AS kwh_at_risk, max(p) AS peak_risk FROM risk GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY kwh_at_risk DESC, day) AS INTEGER) AS rank FROM days)
SELECT site_id, day, {r6('kwh_at_risk')} AS kwh_at_risk, {r6('peak_risk')} AS peak_risk, rank FROM ranked WHERE rank <= 5""")
def q_critical_days(spark, sf_dir):
    d = O.critical_days(P.features(spark, sf_dir), LIN.probability())
    return out(d, ["site_id", "day", "kwh_at_risk", "peak_risk", "rank"])


@register("best_threshold", f"WITH {SCORED}" + f""",
sums AS (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM scored GROUP BY 1, 2),
cum AS (SELECT model, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p FROM sums
  WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
f AS (SELECT *, coalesce(CAST(2 * tp AS DOUBLE) / nullif(CAST(tp + fp + p AS DOUBLE), 0), 0) AS f1 FROM cum),
best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score DESC) AS rk FROM f)
SELECT model, {r6('score')} AS threshold, {r6('f1')} AS f1, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn FROM best WHERE rk = 1""")
def q_best_threshold(spark, sf_dir):
    return out(M.best_threshold(scored_lines(spark, sf_dir)), ["model", "threshold", "f1", "tp", "fp", "fn"])
