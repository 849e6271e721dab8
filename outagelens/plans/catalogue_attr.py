"""Attribution and importance queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from outagelens.functions.numeric import rnd_sql
from outagelens.operators import align as AL
from outagelens.operators import importance as IM
from outagelens.operators import linear as LIN
from outagelens.operators import scoring as R
from outagelens.plans import oracle_sql as S
from outagelens.plans import pipeline as P
from outagelens.plans.registry import out, register
from outagelens.session import materialised

W = LIN.RISK_WEIGHTS
FEATS = list(W)


def r6(e):
    return rnd_sql(e, 6)


def _feats(spark, sf_dir, cols=FEATS):
    """Keys and ``cols`` of the feature table, written once (several branches read them)."""
    return materialised(P.features(spark, sf_dir).select("site_id", "hidx", *cols), "features")


MEANS_SQL = "mu AS (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS mu_{c}" for c in FEATS) + " FROM ft)"
BASE_SQL = "(" + " + ".join([f"CAST({LIN.RISK_INTERCEPT!r} AS DOUBLE)"] + [f"CAST({W[c]!r} AS DOUBLE) * mu_{c}" for c in FEATS]) + ")"
ATTR_SQL = "attr AS (" + " UNION ALL ".join(
    f"SELECT site_id, hidx, {BASE_SQL} AS base_value, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, "
    f"CAST({W[c]!r} AS DOUBLE) * (CAST({c} AS DOUBLE) - mu_{c}) AS contribution FROM ft CROSS JOIN mu" for c in FEATS) + ")"
ATTR_COLS = ["site_id", "hidx", "base_value", "feature", "value", "contribution"]


def _attr(feats):
    return LIN.attributions(feats, ["site_id", "hidx"], W, LIN.RISK_INTERCEPT)


@register("attribution_linear", S.with_(*S.FEATURE_CHAIN, MEANS_SQL, ATTR_SQL) + S.select_rounded(
    ATTR_COLS, "attr", keep=("site_id", "hidx", "feature")))
def q_attribution_linear(spark, sf_dir):
    return out(_attr(_feats(spark, sf_dir)), ATTR_COLS)


@register("attribution_global", S.with_(*S.FEATURE_CHAIN, MEANS_SQL, ATTR_SQL) +
          f"SELECT feature, {r6('avg(abs(contribution))')} AS mean_abs_contribution FROM attr GROUP BY feature")
def q_attribution_global(spark, sf_dir):
    return out(LIN.mean_abs_attributions(_feats(spark, sf_dir), W), ["feature", "mean_abs_contribution"])


LABELS_SQL = "labels_dim AS (SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in IM.FEATURE_LABELS.items()) + ") t(feature, label))"
FM_COLS = [c for c in S.FEATURE_COLS if c not in AL.EXCLUDED and c not in AL.ID_COLUMNS]
FLIST_SQL = "flist AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in FM_COLS) + ") t(feature))"
TOP_SQL = f"""imp AS (SELECT feature, avg(abs(contribution)) AS importance FROM attr GROUP BY feature),
reix AS (SELECT f.feature, COALESCE(i.importance, 0.0) AS importance FROM flist f LEFT JOIN imp i ON i.feature = f.feature),
shares AS (SELECT feature, COALESCE(importance / NULLIF(sum(importance) OVER (), 0), 0.0) AS share FROM reix),
top AS (SELECT * FROM (SELECT feature, share, CAST(row_number() OVER (ORDER BY share DESC, feature) AS INTEGER) AS rank FROM shares)
  WHERE rank <= 5)"""


def _top(spark, feats):
    flist = spark.createDataFrame([(c,) for c in AL.feature_columns(feats)], "feature string")
    imp = LIN.mean_abs_attributions(feats, W).withColumnRenamed("mean_abs_contribution", "importance")
    return IM.top_factors(IM.reindex(imp, flist), IM.labels_frame(spark))


@register("importance_topk", S.with_(*S.FEATURE_CHAIN, MEANS_SQL, ATTR_SQL, LABELS_SQL, FLIST_SQL, TOP_SQL) + f"""
SELECT top.rank, top.feature, COALESCE(l.label, top.feature) AS label, {r6('top.share')} AS importance
FROM top LEFT JOIN labels_dim l ON l.feature = top.feature""")
def q_importance_topk(spark, sf_dir):
    return out(_top(spark, _feats(spark, sf_dir, FM_COLS)), ["rank", "feature", "label", "importance"])


LATEST_SQL = "latest_rows AS (SELECT f.* FROM ft f JOIN (SELECT site_id, max(hidx) AS hidx FROM ft GROUP BY site_id) m USING (site_id, hidx))"


@register("explain_rows", S.with_(*S.FEATURE_CHAIN, MEANS_SQL, ATTR_SQL, LABELS_SQL, FLIST_SQL, TOP_SQL, LATEST_SQL,
                                  "lv AS (" + " UNION ALL ".join(
                                      f"SELECT site_id, hidx, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM latest_rows"
                                      for c in FM_COLS) + ")") + f"""
SELECT lv.site_id, lv.hidx, lv.feature, {r6('lv.value')} AS value, {r6('top.share')} AS importance, top.rank
FROM lv JOIN top ON top.feature = lv.feature""")
def q_explain_rows(spark, sf_dir):
    feats = _feats(spark, sf_dir, FM_COLS)
    top = _top(spark, feats)
    cols = AL.feature_columns(feats)
    latest = R.latest_row(feats, ["site_id"], "hidx", cols)
    d = IM.explain_rows(latest, ["site_id", "hidx"], top, cols)
    return out(d, ["site_id", "hidx", "feature", "value", "importance", "rank"])


# all model inputs, those outside the stand-in scorer with weight 0: ten of 31 stay
W_ALL = {c: W.get(c, 0.0) for c in FM_COLS}


@register("attribution_topk", S.with_(*S.FEATURE_CHAIN, MEANS_SQL, LATEST_SQL) + """,
la AS (""" + " UNION ALL ".join(
    f"SELECT site_id, hidx, {BASE_SQL} AS base_value, '{c}' AS feature, " +
    (f"CAST({W[c]!r} AS DOUBLE) * (CAST({c} AS DOUBLE) - mu_{c})" if c in W else "0.0") + " AS contribution FROM latest_rows CROSS JOIN mu" for c in FM_COLS) + f"""),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY site_id, hidx ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank FROM la)
SELECT site_id, hidx, feature, {r6('contribution')} AS contribution, {r6('base_value')} AS base_value, rank FROM rk WHERE rank <= 10""")
def q_attribution_topk(spark, sf_dir):
    feats = _feats(spark, sf_dir, FM_COLS)
    latest = R.latest_row(feats, ["site_id"], "hidx", FM_COLS)
    # means come from the whole table; contributions are taken for each site's latest row
    attr = LIN.attributions(latest, ["site_id", "hidx"], W_ALL, LIN.RISK_INTERCEPT, background=feats)
    top = IM.top_contributions(attr, ["site_id", "hidx"], n=10)
    return out(top, ["site_id", "hidx", "feature", "contribution", "base_value", "rank"])
