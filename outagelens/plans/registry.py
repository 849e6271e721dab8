"""Query registry shared by the catalogue modules: name -> (builder, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    if name in REGISTRY:
        raise ValueError(f"query {name!r} registered twice")

    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def out(df: DataFrame, cols: list[str]) -> DataFrame:
    from outagelens.plans.pipeline import round_doubles
    return round_doubles(df.select(*cols))
