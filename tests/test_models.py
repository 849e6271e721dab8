"""Invariants of the model layer (the reference has no tests; SURVEY section 5 item 4)."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_tree_attributions_are_additive(spark, tmp_path):
    from outagelens.operators import training as T
    from outagelens.plans.catalogue_train import model_data
    train, test, cols = model_data(spark, SF_SMALL)
    model = T.boosted_trees(cols, rounds=5, max_depth=3).fit(train)
    path = str(tmp_path / "gbt")
    model = T.save_load(model, path)
    nodes = T.tree_table(path, spark)
    rows = test.limit(50)
    attr = T.path_attributions(rows, ["site_id", "hidx"], cols, nodes)
    tot = attr.groupBy("site_id", "hidx").agg((F.sum("contribution") + F.first("base_value")).alias("m"))
    raw = model.transform(rows).select("site_id", "hidx", vector_to_array("rawPrediction")[1].alias("margin"))
    j = tot.join(raw, ["site_id", "hidx"]).toPandas()
    assert len(j) == 50
    assert np.allclose(j.m, j.margin, atol=1e-9)


def test_folds_never_leak_forward(spark):
    from outagelens.operators.splits import expanding_folds
    df = spark.range(120).select(F.col("id").alias("k"), F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, id)").alias("t"))
    f = expanding_folds(df, ["t", "k"], n_splits=5).toPandas()
    for k in range(5):
        tr = f[(f.fold == k) & (f.role == "train")].row_idx
        te = f[(f.fold == k) & (f.role == "test")].row_idx
        assert tr.max() < te.min()
        assert len(te) == 120 // 6
        assert len(tr) == 120 - (5 - k) * 20


def test_isotonic_fit_is_monotone(spark):
    from outagelens.operators.training import isotonic_fit
    df = spark.createDataFrame([(float(i % 10) / 10, float((i * 7) % 3 == 0)) for i in range(300)], "score double, label double")
    r = isotonic_fit(df).orderBy("score").toPandas()
    assert (np.diff(r.fitted) >= -1e-12).all()


def test_sequence_number_matches_row_number(spark):
    from outagelens.operators.blocked import sequence_number
    df = spark.range(500).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 500).alias("o"))
    got = sequence_number(df, ["g"], ["o"], "rn").toPandas()
    for g, grp in got.groupby("g"):
        assert list(grp.sort_values("o").rn) == list(range(len(grp)))


def test_forest_attributions_are_additive(spark, tmp_path):
    from outagelens.operators import training as T
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                 ((F.col("id") % 7 > 3) | (F.col("id") % 5 == 2)).cast("int").alias("label"), F.lit(1.0).alias("weight"))
    path = str(tmp_path / "forest")
    model = T.save_load(T.random_forest(["a", "b"], num_trees=5, max_depth=4).fit(df), path)
    attr = T.path_attributions(df, ["id"], ["a", "b"], T.tree_table(path, spark, forest=True))
    tot = attr.groupBy("id").agg((F.sum("contribution") + F.first("base_value")).alias("p"))
    raw = model.transform(df).select("id", vector_to_array("probability")[1].alias("want"))
    j = tot.join(raw, "id").toPandas()
    assert len(j) == 400 and np.allclose(j.p, j.want, atol=1e-9)


def test_depths_are_never_clamped_silently():
    import pytest
    from outagelens.operators.training import depth_of
    assert depth_of(12) == 12 and depth_of(-1) == 30
    with pytest.raises(ValueError):
        depth_of(31)
