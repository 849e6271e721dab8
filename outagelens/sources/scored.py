"""Scored-table binding for evaluation queries: lineitem rows scored by three fixed "models".

label = 1 when l_returnflag = 'R'; scores: discount = 10 * l_discount,
tax = 12.5 * l_tax, quantity = l_quantity / 50 (all in [0, 1]).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outagelens.sources.tables import read_table

# fixed values: score expressions of the three evaluation models
MODELS = {
    "discount": "l_discount * 10",
    "tax": "l_tax * 12.5",
    "quantity": "l_quantity / 50",
}


def scored_lines(spark: SparkSession, sf_dir: str, models: Sequence[str] = tuple(MODELS)) -> DataFrame:
    """A row for each line and each of ``models``."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                                 "l_tax", "l_returnflag", "l_shipdate"])
    label = (F.col("l_returnflag") == "R").cast("int").alias("label")
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).cast("double").alias("score"))
                                  for m, e in MODELS.items() if m in models])).alias("s")
    return li.select("l_orderkey", "l_linenumber", "l_shipdate", label, stacked).select(
        "l_orderkey", "l_linenumber", "l_shipdate", "label", "s.model", "s.score")
