"""Raw ingest with quarantine, tolerant ingest, parity fill, half-even rounding, factors and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from outagelens.functions.numeric import rnd_even, rnd_sql
from outagelens.operators import align as AL
from outagelens.operators import importance as IM
from outagelens.operators import metrics as M
from outagelens.operators import scoring as R
from outagelens.plans import manifest as MF
from outagelens.plans import oracle_sql as S
from outagelens.plans import pipeline as P
from outagelens.plans.catalogue_attr import ATTR_SQL, FM_COLS, FLIST_SQL, LABELS_SQL, LATEST_SQL, MEANS_SQL, TOP_SQL, _top
from outagelens.plans.registry import REGISTRY, out, register
from outagelens.session import materialised
from outagelens.sources import bindings, raw, sinks
from outagelens.sources.scored import scored_lines
from outagelens.sources.tables import read_csv, read_table


def r6(e):
    return rnd_sql(e, 6)


#: every so many lines are spoilt: a field too many, no time, no number
BAD = {"columns": 83, "time": 97, "number": 89}


def _spoilt(id_col, kind):
    return F.col(id_col) % BAD[kind] == 0


def _written(df, name):
    """As CSV with a header and without quotes, so that a comma in a value spoils its line."""
    path = sinks.shared_path(df.sparkSession, name)
    df.write.option("header", True).option("quote", "").csv(path)
    return path


def _meter_lines(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "value"])
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    cols = [F.when(_spoilt("event_id", "time"), "n/a").otherwise(text), F.col("value").cast("string"),
            F.when(_spoilt("event_id", "number"), "12.5x").otherwise(F.col("value").cast("string")),
            F.lit("1.5"), F.lit(""), (F.col("value") / 4).cast("string"),
            F.when(_spoilt("event_id", "columns"), "1,extra").otherwise((F.col("event_id") % 2).cast("string"))]
    path = _written(ev.select(*(c.alias(h) for c, (h, _) in zip(cols, raw.METER_TABLE.columns, strict=True))), "raw_meters")
    return raw.scan(spark, path, raw.METER_TABLE)


def _reason_sql(more: str = "") -> str:
    return (f"CASE WHEN event_id % {BAD['columns']} = 0 THEN 'columns' WHEN event_id % {BAD['time']} = 0 {more} THEN 'time' "
            f"WHEN event_id % {BAD['number']} = 0 THEN 'number:{{}}' END")


@register("raw_meter_ingest", f"""WITH r AS (SELECT *, {_reason_sql().format('total_load_kw')} AS reason FROM events)
SELECT date_trunc('second', ts) AS datetime, value AS solar_pv_kw, value AS total_load_kw,
  1.5::DOUBLE AS generators_kw, NULL::DOUBLE AS sterilization_kw, value / 4 AS base_load_kw,
  (event_id % 2)::DOUBLE AS grid_available, CAST(1 - event_id % 2 AS INTEGER) AS is_outage FROM r WHERE reason IS NULL""")
def q_raw_meter_ingest(spark, sf_dir):
    return raw.good_rows(_meter_lines(spark, sf_dir), raw.METER_TABLE)


@register("raw_meter_report", f"""WITH r AS (SELECT {_reason_sql().format('total_load_kw')} AS reason FROM events)
SELECT coalesce(reason, 'ok') AS reason, count(*) AS n_lines FROM r GROUP BY 1""")
def q_raw_meter_report(spark, sf_dir):
    return raw.report(_meter_lines(spark, sf_dir))


def _site_lines(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "value"])
    v = F.col("value").cast("string")
    cols = [F.when(_spoilt("event_id", "time"), "24:00").otherwise(F.concat(F.lit(" "), F.date_format("ts", "MM/dd  HH:mm:ss"))), v,
            F.when(_spoilt("event_id", "number"), "-").otherwise(v), v, v, F.lit(""), v,
            F.when(_spoilt("event_id", "columns"), "2,9").otherwise(v)]
    path = _written(ev.select(*(c.alias(h) for c, (h, _) in zip(cols, raw.SITE_TABLE.columns, strict=True))), "raw_site")
    return raw.scan(spark, path, raw.SITE_TABLE)


_LEAP = "OR (month(ts) = 2 AND day(ts) = 29)"
_V = "value"


@register("raw_site_ingest", f"""WITH r AS (SELECT *, CASE WHEN event_id % {BAD['columns']} = 0 THEN 'columns'
  WHEN event_id % {BAD['time']} = 0 {_LEAP} THEN 'time' WHEN event_id % {BAD['number']} = 0 THEN 'number:fans_kw' END AS reason FROM events)
SELECT make_timestamp(2022, month(ts), day(ts), hour(ts), minute(ts), CAST(second(ts) AS DOUBLE)) AS datetime, {_V} AS total_electricity_kw, {_V} AS fans_kw,
  {_V} AS cooling_kw, {_V} AS heating_kw, NULL::DOUBLE AS lights_kw, {_V} AS equipment_kw, {_V} AS total_gas_kw FROM r WHERE reason IS NULL""")
def q_raw_site_ingest(spark, sf_dir):
    return raw.good_rows(_site_lines(spark, sf_dir), raw.SITE_TABLE)


# ---------------------------------------------------------------- tolerant ingest

def tolerant_run(spark, sf_dir):
    """Meters are there, the weather's path isn't, and the country facts are a page of text saved with a .csv name."""
    junk = sinks.shared_path(spark, "facts_csv")
    read_table(spark, sf_dir, "nation", ["n_name"]).select(F.concat(F.lit("<html>"), "n_name").alias("page")).write.option("header", True).csv(junk)
    facts = "country_code int, year int, area_type string, reliability_pct double"
    found = MF.ingest([
        MF.Source("meters", lambda: bindings.meter_readings(spark, sf_dir), required=True),
        MF.Source("weather", lambda: spark.read.parquet(f"{junk}-absent")),
        MF.Source("facts", lambda: read_csv(spark, junk, facts)),
        MF.Source("stages", lambda: bindings.stage_history(spark, sf_dir)),
        MF.Source("none", lambda: bindings.stage_history(spark, sf_dir).where("stage > 100")),
    ])
    sites = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).select(
        F.col("c_custkey").alias("site_id"), F.col("c_nationkey").alias("country_code"))
    feats = P.tolerant_features(spark, found["meters"].table, found["weather"].table, found["facts"].table, found["stages"].table, sites)
    return found, feats


@register("ingest_status", """SELECT 'meters' AS source, 'ok' AS status, count(*) AS n_rows FROM events UNION ALL SELECT 'weather', 'absent', 0
UNION ALL SELECT 'facts', 'failed', 0 UNION ALL SELECT 'stages', 'ok', count(*) FROM orders UNION ALL SELECT 'none', 'empty', 0""")
def q_ingest_status(spark, sf_dir):
    return MF.status_table(spark, tolerant_run(spark, sf_dir)[0])


_TOLERANT = ["site_id", "hidx", "total_load_kw", "load_rolling_24h", "temperature_2m", "who_reliability_pct", "loadshed_avg_stage", "solar_ratio"]


@register("ingest_features", S.with_(*S.FILLED_CHAIN, S.STAGES) + f"""SELECT site_id, hidx, {r6('total_load_kw')} AS total_load_kw,
  {r6(S.ordered_avg('total_load_kw', 23))} AS load_rolling_24h, 0.0::DOUBLE AS temperature_2m, 50.0::DOUBLE AS who_reliability_pct,
  {r6('loadshed_avg_stage')} AS loadshed_avg_stage, {r6(S.ratio('solar_pv_kw'))} AS solar_ratio FROM filled CROSS JOIN sstats""")
def q_ingest_features(spark, sf_dir):
    return out(tolerant_run(spark, sf_dir)[1], _TOLERANT)


# ---------------------------------------------------------------- parity fill, half-even rounding

_PARITY = "parity AS (SELECT " + S.fill_exprs(S.GRID_COLS, [*S.POWER, "grid_availability_ratio", "is_outage"], []) + \
    " FROM (SELECT * REPLACE (CAST(is_outage AS DOUBLE) AS is_outage) FROM grid))"


@register("gap_parity", S.with_(S.READINGS, S.HOURLY, S.GRID, _PARITY) + S.select_rounded(S.GRID_COLS, "parity", keep=("site_id", "hidx", "hour_ts")))
def q_gap_parity(spark, sf_dir):
    return out(P.filled_grid(spark, sf_dir, fill="reference"), S.GRID_COLS)


@register("round_half_even", """SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4 * 10, 0) / 10 AS tenths,
  CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS whole FROM lineitem""")
def q_round_half_even(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    q = F.col("l_quantity")
    return li.select("l_orderkey", "l_linenumber", rnd_even(q / 4, 1).alias("tenths"), rnd_even(q / 2, 0).alias("whole"))


# ---------------------------------------------------------------- factors, texts, summary

@register("importance_default", f"WITH {LABELS_SQL},\n{FLIST_SQL}" + f"""
SELECT CAST(rk AS INTEGER) AS rank, f.feature, coalesce(label, f.feature) AS label, {r6(f'1.0 / {len(FM_COLS)}')} AS importance
FROM (SELECT feature, row_number() OVER (ORDER BY feature) AS rk FROM flist) f LEFT JOIN labels_dim l USING (feature) WHERE rk <= 5""")
def q_importance_default(spark, sf_dir):
    """Without a table of importances each feature has 1/n (the features are those of the feature table's schema)."""
    flist = spark.createDataFrame([(c,) for c in AL.feature_columns(P.features(spark, sf_dir))], "feature string")
    return out(IM.top_factors(IM.reindex(None, flist), IM.labels_frame(spark)), ["rank", "feature", "label", "importance"])


@register("top_factors_latest", S.with_(*S.FEATURE_CHAIN, MEANS_SQL, ATTR_SQL, LABELS_SQL, FLIST_SQL, TOP_SQL, LATEST_SQL,
                                        "lv AS (" + " UNION ALL ".join(f"SELECT site_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM latest_rows"
                                                                       for c in FM_COLS) + ")") + f"""
SELECT lv.site_id, top.rank, lv.feature, coalesce(label, lv.feature) AS label, {r6('top.share')} AS importance, {r6('lv.value')} AS value
FROM lv JOIN top USING (feature) LEFT JOIN labels_dim l USING (feature)""")
def q_top_factors_latest(spark, sf_dir):
    """Top factors with label, importance and the value in each site's latest row."""
    table = P.features(spark, sf_dir)
    cols = AL.feature_columns(table)
    feats = materialised(table.select("site_id", "hidx", *cols), "features")
    d = IM.explain_rows(R.latest_row(feats, ["site_id"], "hidx", cols), ["site_id"], _top(spark, feats), cols)
    return out(IM.with_labels(d, IM.labels_frame(spark)), ["site_id", "rank", "feature", "label", "importance", "value"])


@register("summary_winner", f"""SELECT model AS winner, f1 AS winner_f1, (SELECT max(f1) FILTER (WHERE model = 'tax') FROM ({REGISTRY['model_compare'][1]}) c) AS tax_f1
FROM ({REGISTRY['model_compare'][1]}) c WHERE rank = 1""")
def q_summary_winner(spark, sf_dir):
    """One nested summary (winner, comparison by model) written as JSON, keys read back."""
    cmp = M.model_compare(scored_lines(spark, sf_dir))
    metrics = F.struct("accuracy", "precision", "recall", "f1", "roc_auc", "brier")
    summary = cmp.agg(F.min_by("model", "rank").alias("winner"), F.map_from_entries(F.collect_list(F.struct("model", metrics))).alias("comparison"))
    text = spark.read.text(sinks.write_json(summary, sinks.shared_path(spark, "training_summary")))
    got = text.select(F.get_json_object("value", "$.winner").alias("winner"), "value")
    of = lambda m: F.get_json_object("value", f"$.comparison.{m}.f1").cast("double")
    return got.select("winner", F.when(F.col("winner") == "discount", of("discount")).when(F.col("winner") == "tax", of("tax")).otherwise(
        of("quantity")).alias("winner_f1"), of("tax").alias("tax_f1"))
