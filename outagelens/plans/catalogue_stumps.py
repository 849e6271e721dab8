"""Fits that SQL can check: trees of one split over columns of few values, on whole ``lineitem``.

With one split, no sampling and candidate thresholds half way between neighbouring values, the fit is the split of the largest
impurity gain, which SQL finds by running sums. The same library code fits, searches, calibrates and explains as for large models.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from outagelens.functions.numeric import rnd_sql
from outagelens.operators import importance as IM
from outagelens.operators import search as SE
from outagelens.operators import splits as SP
from outagelens.operators import training as T
from outagelens.operators import trees as TR
from outagelens.plans.registry import out, register
from outagelens.session import materialised
from outagelens.sources import sinks
from outagelens.sources.tables import read_table

COLS = ["l_quantity", "l_discount", "l_tax"]
BINS = 64  # more than any of these has values
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber"]
WEIGHT = 3
#: label: depends on the quantity, but not on it alone
LABEL = "l_quantity + 10 * (l_linenumber % 3) > 35"


def r6(e):
    return rnd_sql(e, 6)


def _rows(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate", *COLS])
    return li.select("l_orderkey", "l_linenumber", "l_shipdate", *(F.col(c).cast("double").alias(c) for c in COLS),
                     F.expr(LABEL).cast("int").alias("label"))


def _indexed(spark, sf_dir):
    return materialised(SP.chronological_index(_rows(spark, sf_dir), ORDER), "lines")


BASE = f"""line AS (SELECT l_orderkey, l_linenumber, l_shipdate, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in COLS)},
  CAST({LABEL} AS INTEGER) AS label FROM lineitem)"""
INDEXED = "lines AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS i, count(*) OVER () AS n FROM line)"


def stump(name: str, src: str, keys: str = "", weight: str = str(WEIGHT)) -> str:
    """CTEs ending in ``name``: for each value of ``keys`` the best split (f, feature, t) of ``src`` with weighted counts of both sides."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {k}f"
    on = f"PARTITION BY {keys}" if keys else ""
    longs = " UNION ALL ".join(f"SELECT *, {j} AS f, {c} AS v FROM {src}" for j, c in enumerate(COLS))
    names = " ".join(f"WHEN {j} THEN '{c}'" for j, c in enumerate(COLS))
    gini = lambda p, q: f"(1 - power({p} / ({p} + {q}), 2) - power({q} / ({p} + {q}), 2))"
    return f"""{name}_v AS (SELECT {k}f, v, CAST(sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END) AS DOUBLE) AS p,
  CAST(sum(1 - label) AS DOUBLE) AS q, count(*) AS c FROM ({longs}) GROUP BY {k}f, v),
{name}_c AS (SELECT *, (v + lead(v) OVER ({part} ORDER BY v)) / 2 AS t, sum(p) OVER ({part} ORDER BY v) AS lp, sum(q) OVER ({part} ORDER BY v) AS lq,
  sum(c) OVER ({part} ORDER BY v) AS lc, sum(p) OVER ({part}) AS tp, sum(q) OVER ({part}) AS tq, sum(c) OVER ({part}) AS tc FROM {name}_v),
{name}_g AS (SELECT *, tp - lp AS rp, tq - lq AS rq, tc - lc AS rc,
  {gini('tp', 'tq')} - (lp + lq) / (tp + tq) * {gini('lp', 'lq')} - (tp + tq - lp - lq) / (tp + tq) * {gini('(tp - lp)', '(tq - lq)')} AS gain
  FROM {name}_c WHERE t IS NOT NULL),
{name} AS (SELECT *, CASE f {names} END AS feature FROM (
  SELECT *, row_number() OVER ({on} ORDER BY gain DESC, f, t) AS rk FROM {name}_g) WHERE rk = 1)"""


def _x(alias: str = "s") -> str:
    """The split feature's value of a row."""
    return f"CASE {alias}.f " + " ".join(f"WHEN {j} THEN {c}" for j, c in enumerate(COLS)) + " END"


def _weighted(df):
    return SP.class_weights(df, pos_weight=WEIGHT)


def _forest():
    return T.random_forest(COLS, num_trees=1, max_depth=1, min_leaf=1, bootstrap=False, max_bins=BINS)


def _boosted():
    return T.boosted_trees(COLS, rounds=1, max_depth=1, subsample=1.0, colsample=1.0, max_bins=BINS)


def _split_row(spark, nodes):
    tree = TR.trees_of(nodes)[0]
    left, right = int(tree.left[0]), int(tree.right[0])
    return spark.createDataFrame([(COLS[int(tree.feature[0])], float(tree.threshold[0]), float(tree.value[left]), float(tree.value[right]),
                                   int(tree.cover[left]), int(tree.cover[right]))],
                                 "feature string, threshold double, value_left double, value_right double, n_left long, n_right long")


def _fitted(spark, sf_dir, pipe, name):
    path = sinks.shared_path(spark, name)
    model = T.save_load(pipe.fit(_weighted(_rows(spark, sf_dir))), path)
    return model, T.tree_table(path, spark, forest=name == "stump_forest")


@register("stump_forest", f"WITH {BASE},\n{stump('s', 'line')}\nSELECT feature, {r6('t')} AS threshold, {r6('lp / (lp + lq)')} AS value_left, "
          f"{r6('rp / (rp + rq)')} AS value_right, CAST(lc AS BIGINT) AS n_left, CAST(rc AS BIGINT) AS n_right FROM s")
def q_stump_forest(spark, sf_dir):
    d = _split_row(spark, _fitted(spark, sf_dir, _forest(), "stump_forest")[1])
    return out(d, d.columns)


@register("stump_boosted", f"WITH {BASE},\n{stump('s', 'line')}\nSELECT feature, {r6('t')} AS threshold, {r6('(lp - lq) / (lp + lq)')} AS value_left, "
          f"{r6('(rp - rq) / (rp + rq)')} AS value_right, CAST(lc AS BIGINT) AS n_left, CAST(rc AS BIGINT) AS n_right FROM s")
def q_stump_boosted(spark, sf_dir):
    d = _split_row(spark, _fitted(spark, sf_dir, _boosted(), "stump_boosted")[1])
    return out(d, d.columns)


_SIDE = f"CASE WHEN {_x()} <= s.t THEN (lp - lq) / (lp + lq) ELSE (rp - rq) / (rp + rq) END"


@register("stump_attribution", f"""WITH {BASE},
{stump('s', 'line')},
m AS (SELECT line.*, s.feature AS split, {_SIDE} AS margin, (lc * (lp - lq) / (lp + lq) + rc * (rp - rq) / (rp + rq)) / (lc + rc) AS base FROM line CROSS JOIN s)
SELECT l_orderkey, l_linenumber, feature, {r6('value')} AS value, {r6('CASE WHEN split = feature THEN margin - base ELSE 0 END')} AS contribution,
  {r6('base')} AS base_value FROM ({' UNION ALL '.join(f"SELECT *, '{c}' AS feature, {c} AS value FROM m" for c in COLS)})""")
def q_stump_attribution(spark, sf_dir):
    _, nodes = _fitted(spark, sf_dir, _boosted(), "stump_boosted")
    d = TR.shapley_attributions(_rows(spark, sf_dir), ["l_orderkey", "l_linenumber"], COLS, nodes)
    return out(d, ["l_orderkey", "l_linenumber", "feature", "value", "contribution", "base_value"])


@register("stump_importance", f"""WITH {BASE},
{stump('s', 'line')},
flist AS (SELECT * FROM (VALUES {', '.join(f"('{c}')" for c in COLS)}) t(feature)),
shares AS (SELECT flist.feature, CAST(flist.feature = s.feature AS DOUBLE) AS importance FROM flist CROSS JOIN s)
SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature, feature AS label, importance FROM shares""")
def q_stump_importance(spark, sf_dir):
    model, _ = _fitted(spark, sf_dir, _forest(), "stump_forest")
    return out(IM.top_factors(T.importances(model, COLS), IM.labels_frame(spark)), ["rank", "feature", "label", "importance"])


WEIGHTS = [2, 3, 4]
_FOLDS = """fold AS (SELECT k, w, n - (5 - k) * (n // 6) AS lo, n - (4 - k) * (n // 6) AS hi FROM (SELECT max(n) AS n FROM lines)
  CROSS JOIN (SELECT unnest(range(5)) AS k) CROSS JOIN (SELECT unnest([2, 3, 4]) AS w)),
seen AS (SELECT lines.*, fold.k, fold.w FROM lines JOIN fold ON lines.i < fold.lo)"""


@register("stump_grid", f"""WITH {BASE},
{INDEXED},
{_FOLDS},
{stump('s', 'seen', 'k, w', 'w')},
judged AS (SELECT s.k, s.w, label, CASE WHEN {_x()} <= s.t THEN lp / (lp + lq) ELSE rp / (rp + rq) END > 0.5 AS yes
  FROM s JOIN fold USING (k, w) JOIN lines ON lines.i >= fold.lo AND lines.i < fold.hi),
f AS (SELECT k, w, coalesce(CAST(2 * count(*) FILTER (WHERE yes AND label = 1) AS DOUBLE) /
  nullif(CAST(count(*) FILTER (WHERE yes) + count(*) FILTER (WHERE label = 1) AS DOUBLE), 0), 0) AS f1 FROM judged GROUP BY k, w),
cv AS (SELECT w, avg(f1) AS f1_cv FROM f GROUP BY w)
SELECT CAST(f.w AS INTEGER) AS pos_weight, CAST(f.k AS INTEGER) AS fold, {r6('f1')} AS f1, {r6('f1_cv')} AS f1_cv,
  f.w = (SELECT w FROM cv ORDER BY floor(f1_cv * 1e9 + 0.5) DESC, w LIMIT 1) AS best FROM f JOIN cv USING (w)""")
def q_stump_grid(spark, sf_dir):
    """M6 over class weights: the library's search with its folds and shared fits, all rows."""
    configs = [{"family": "random_forest", "size": 1, "max_depth": 1, "min_leaf": 1, "pos_weight": w, "bootstrap": False, "max_bins": BINS} for w in WEIGHTS]
    lines = _indexed(spark, sf_dir)
    found = SE.grid_search(lines, COLS, configs, fit_rows=lines.count())
    best = max(found, key=lambda r: (round(r["f1_cv"], 9), -r["pos_weight"]))
    rows = [(r["pos_weight"], k, f1, r["f1_cv"], r is best) for r in found for k, f1 in enumerate(r["fold_f1"])]
    return out(spark.createDataFrame(rows, "pos_weight int, fold int, f1 double, f1_cv double, best boolean"), ["pos_weight", "fold", "f1", "f1_cv", "best"])


_TRAIN = "CAST(floor(n * 0.8) AS BIGINT)"
_PARTS = """fold AS (SELECT k, c - (3 - k) * (c // 4) AS lo, c - (2 - k) * (c // 4) AS hi FROM (SELECT max(CAST(floor(n * 0.8) AS BIGINT)) AS c FROM lines)
  CROSS JOIN (SELECT unnest(range(3)) AS k)),
seen AS (SELECT lines.*, fold.k FROM lines JOIN fold ON lines.i < fold.lo)"""


@register("stump_calibrated", f"""WITH {BASE},
{INDEXED},
{_PARTS},
{stump('s', 'seen', 'k')},
held AS (SELECT s.k, {_x()} <= s.t AS is_left, label, CASE WHEN {_x()} <= s.t THEN lp / (lp + lq) ELSE rp / (rp + rq) END AS score
  FROM s JOIN fold USING (k) JOIN lines ON lines.i >= fold.lo AND lines.i < fold.hi),
rate AS (SELECT k, score, avg(CAST(label AS DOUBLE)) AS r, count(*) AS c FROM held GROUP BY k, score),
pooled AS (SELECT a.k, a.score, CASE WHEN b.score IS NULL OR (a.score < b.score AND a.r < b.r) OR (a.score > b.score AND a.r > b.r) THEN a.r
  ELSE (a.r * a.c + b.r * b.c) / (a.c + b.c) END AS cal FROM rate a LEFT JOIN rate b ON a.k = b.k AND a.score <> b.score),
twice AS (SELECT lines.i, label, s.k, CASE WHEN {_x()} <= s.t THEN lp / (lp + lq) ELSE rp / (rp + rq) END AS score
  FROM lines CROSS JOIN s WHERE lines.i >= {_TRAIN}),
ens AS (SELECT twice.i, any_value(label) AS label, avg(twice.score) AS raw, avg(pooled.cal) AS calibrated
  FROM twice JOIN pooled ON pooled.k = twice.k AND abs(pooled.score - twice.score) < 1e-12 GROUP BY twice.i),
u AS (SELECT 'raw' AS model, label, raw AS score FROM ens UNION ALL SELECT 'calibrated', label, calibrated FROM ens)
SELECT model, count(*) AS n, {r6('avg(score)')} AS mean_score, {r6('avg(power(score - label, 2))')} AS brier FROM u GROUP BY model""")
def q_stump_calibrated(spark, sf_dir):
    """M8: three fold models with isotonic maps, averaged, on the last fifth of the rows."""
    lines = _indexed(spark, sf_dir)
    cut = int(lines.count() * 0.8)
    ensemble = T.calibrated_ensemble(_weighted(lines.where(F.col("row_idx") < cut)), _forest())
    scores = ensemble.transform(lines.where(F.col("row_idx") >= cut)).select("label", F.inline(F.array(
        F.struct(F.lit("raw").alias("model"), F.col("raw_score").alias("score")), F.struct(F.lit("calibrated").alias("model"), "score"))))
    d = F.col("score") - F.col("label")
    return out(scores.groupBy("model").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(d * d).alias("brier")),
               ["model", "n", "mean_score", "brier"])


@register("isotonic_continuous", f"""WITH pts AS (SELECT (c_acctbal + 1000) / 11000 AS score, count(*) AS n, CAST(sum(CAST(c_mktsegment = 'BUILDING' AS INTEGER)) AS DOUBLE) AS s
  FROM customer GROUP BY 1),
c AS (SELECT score, n, sum(n) OVER (ORDER BY score) AS cn, sum(s) OVER (ORDER BY score) AS cs, sum(n) OVER (ORDER BY score) - n AS cn0,
  sum(s) OVER (ORDER BY score) - s AS cs0 FROM pts),
mins AS (SELECT a.score AS i, b.score AS k, min((b.cs - a.cs0) / (b.cn - a.cn0)) OVER (PARTITION BY a.score ORDER BY b.score DESC) AS mn
  FROM c a JOIN c b ON a.score <= b.score)
SELECT {r6('k')} AS score, any_value(n) AS n, {r6('max(mn)')} AS fitted FROM mins JOIN pts ON pts.score = k GROUP BY k""")
def q_isotonic_continuous(spark, sf_dir):
    """M8 on continuous scores (a value for nearly each row)."""
    c = read_table(spark, sf_dir, "customer", ["c_acctbal", "c_mktsegment"]).select(
        ((F.col("c_acctbal") + 1000) / 11000).alias("score"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"))
    return out(T.isotonic_fit(c), ["score", "n", "fitted"])
