"""Evaluation and split queries (A9-A13, M1-M3, M7) with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from outagelens.functions.numeric import rnd_sql
from outagelens.operators import metrics as M
from outagelens.operators import splits as SP
from outagelens.plans.registry import out, register
from outagelens.sources.scored import MODELS, scored_lines
from outagelens.sources.tables import read_table


def r4(e):
    return rnd_sql(e, 4)


def r6(e):
    return rnd_sql(e, 6)


SCORED = "scored AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT l_orderkey, l_linenumber, l_shipdate, CAST(l_returnflag = 'R' AS INTEGER) AS label, "
    f"'{m}' AS model, CAST({e} AS DOUBLE) AS score FROM lineitem" for m, e in MODELS.items()) + ")"

CONF = """conf AS (
  SELECT model, count(*) AS n,
    count(*) FILTER (WHERE label = 1 AND score > 0.5) AS tp,
    count(*) FILTER (WHERE label <> 1 AND score > 0.5) AS fp,
    count(*) FILTER (WHERE label = 1 AND NOT (score > 0.5)) AS fn,
    count(*) FILTER (WHERE label <> 1 AND NOT (score > 0.5)) AS tn
  FROM scored GROUP BY model)"""


def d0(a, b):
    return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0)"


METRICS_SEL = (f"model, n, tp, fp, fn, tn, {r4(d0('tp + tn', 'n'))} AS accuracy, {r4(d0('tp', 'tp + fp'))} AS precision, "
               f"{r4(d0('tp', 'tp + fn'))} AS recall, {r4(d0('2 * tp', '2 * tp + fp + fn'))} AS f1")

AUC = """ranked AS (
  SELECT model, label,
    CAST(rank() OVER (PARTITION BY model ORDER BY score) AS DOUBLE)
      + CAST(count(*) OVER (PARTITION BY model, score) - 1 AS DOUBLE) / 2 AS avg_rank
  FROM scored),
auc AS (
  SELECT model, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label <> 1) AS negatives,
    sum(CASE WHEN label = 1 THEN avg_rank ELSE 0 END) AS rsum
  FROM ranked GROUP BY model)"""

AUC_SEL = ("model, positives, negatives, " +
           r4("(rsum - CAST(positives AS DOUBLE) * (positives + 1) / 2) / NULLIF(CAST(positives * negatives AS DOUBLE), 0)")
           + " AS roc_auc")

BRIER = """bri AS (
  SELECT model, avg((score - label) * (score - label)) AS b, avg(CAST(label AS DOUBLE)) AS r FROM scored GROUP BY model)"""


@register("binary_metrics", f"WITH {SCORED},\n{CONF}\nSELECT {METRICS_SEL} FROM conf")
def q_binary_metrics(spark, sf_dir):
    return M.binary_metrics(scored_lines(spark, sf_dir))


@register("roc_auc", f"WITH {SCORED},\n{AUC}\nSELECT {AUC_SEL} FROM auc")
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(scored_lines(spark, sf_dir))


@register("brier", f"WITH {SCORED},\n{BRIER}\nSELECT model, {r6('b')} AS brier, "
          f"{r6('(r * (1 - r) - b) / NULLIF(r * (1 - r), 0) * 100')} AS skill_pct FROM bri")
def q_brier(spark, sf_dir):
    return M.brier(scored_lines(spark, sf_dir))


@register("brier_improvement", f"WITH {SCORED},\n{BRIER}\nSELECT c.model, {r6('a.b')} AS brier_raw, {r6('c.b')} AS brier_calibrated, "
          f"{r6('(a.b - c.b) / NULLIF(a.b, 0) * 100')} AS improvement_pct "
          "FROM bri c JOIN bri a ON a.model = 'discount' AND c.model <> 'discount'")
def q_brier_improvement(spark, sf_dir):
    return M.brier_improvement(scored_lines(spark, sf_dir), "discount")


def _cls(name, t, fp, fn, sup):
    return (f"SELECT model, '{name}' AS class_label, {d0(t, f'{t} + {fp}')} AS precision, "
            f"{d0(t, f'{t} + {fn}')} AS recall, {d0(f'2 * {t}', f'2 * {t} + {fp} + {fn}')} AS f1, "
            f"CAST({sup} AS BIGINT) AS support FROM conf")


REPORT = f"""per AS ({_cls('1', 'tp', 'fp', 'fn', 'tp + fn')} UNION ALL {_cls('0', 'tn', 'fn', 'fp', 'tn + fp')}),
rep AS (
  SELECT * FROM per
  UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per GROUP BY model
  UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM per GROUP BY model)"""


@register("classification_report", f"WITH {SCORED},\n{CONF},\n{REPORT}\nSELECT model, class_label, "
          f"{r4('precision')} AS precision, {r4('recall')} AS recall, {r4('f1')} AS f1, CAST(support AS BIGINT) AS support FROM rep")
def q_classification_report(spark, sf_dir):
    return M.classification_report(scored_lines(spark, sf_dir))


def _edge_ctes():
    from outagelens.plans.oracle_sql import percentile_ctes
    out = []
    for i, q in enumerate((0.2, 0.4, 0.6, 0.8)):
        out += [c.replace("score_p", f"e{i}_p") for c in percentile_ctes(f"pe{i}", "scored", ["model"], ["score"], q)]
    out.append("edges AS (SELECT model, [" + ", ".join(f"pe{i}.e{i}_p{int(q * 100):02d}" for i, q in
                                                      enumerate((0.2, 0.4, 0.6, 0.8))) + "] AS e FROM pe0 "
               + " ".join(f"JOIN pe{i} USING (model)" for i in range(1, 4)) + ")")
    return ",\n".join(out)


CALIB = _edge_ctes() + """,
binned AS (
  SELECT s.model, s.score, s.label,
    CAST((e.e[1] < s.score)::INT + (e.e[2] < s.score)::INT + (e.e[3] < s.score)::INT + (e.e[4] < s.score)::INT AS INTEGER) AS bin
  FROM scored s JOIN edges e ON e.model = s.model)"""


@register("calibration_curve", f"WITH {SCORED},\n{CALIB}\nSELECT model, bin, count(*) AS n, {r6('avg(score)')} AS mean_pred, "
          f"{r6('avg(CAST(label AS DOUBLE))')} AS frac_pos FROM binned GROUP BY model, bin")
def q_calibration_curve(spark, sf_dir):
    return M.calibration_curve(scored_lines(spark, sf_dir))


@register("model_compare", f"""WITH {SCORED},
{CONF},
{AUC},
{BRIER},
met AS (SELECT {METRICS_SEL} FROM conf),
a AS (SELECT {AUC_SEL} FROM auc),
allm AS (SELECT met.model, accuracy, precision, recall, f1, a.roc_auc, {r4('bri.b')} AS brier
  FROM met JOIN a ON a.model = met.model JOIN bri ON bri.model = met.model)
SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, model) AS INTEGER) AS rank FROM allm""")
def q_model_compare(spark, sf_dir):
    return M.model_compare(scored_lines(spark, sf_dir))


# ---------------------------------------------------------------- splits

ORDERS_IDX = """x AS (
  SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_idx,
    count(*) OVER () AS n_rows FROM orders)"""


def _orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])


@register("temporal_split", f"""WITH {ORDERS_IDX}
SELECT o_orderkey, o_orderdate, row_idx, n_rows,
  CASE WHEN row_idx < floor(n_rows * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM x""")
def q_temporal_split(spark, sf_dir):
    d = SP.temporal_split(_orders(spark, sf_dir), ["o_orderdate", "o_orderkey"])
    return d.select("o_orderkey", "o_orderdate", "row_idx", "n_rows", "split")


@register("expanding_folds", f"""WITH {ORDERS_IDX},
f AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold)
SELECT o_orderkey, o_orderdate, row_idx, n_rows, fold,
  CASE WHEN row_idx < n_rows - (5 - fold) * (n_rows // 6) THEN 'train' ELSE 'test' END AS role
FROM x CROSS JOIN f WHERE row_idx < n_rows - (5 - fold - 1) * (n_rows // 6)""")
def q_expanding_folds(spark, sf_dir):
    d = SP.expanding_folds(_orders(spark, sf_dir), ["o_orderdate", "o_orderkey"])
    return d.select("o_orderkey", "o_orderdate", "row_idx", "n_rows", "fold", "role")


@register("class_weights", """WITH lab AS (SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem),
rate AS (SELECT avg(CAST(label AS DOUBLE)) AS r FROM lab)
SELECT l_orderkey, l_linenumber, label, CASE WHEN label = 1 THEN CAST(round(1 / r) AS DOUBLE) ELSE 1.0 END AS weight
FROM lab CROSS JOIN rate""")
def q_class_weights(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"])
    d = li.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return out(SP.class_weights(d), ["l_orderkey", "l_linenumber", "label", "weight"])
