"""Queries of the training-data operators: name -> (builder, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["line_dedup", "quality", "packing", "decontaminate", "langid", "suffix_dedup", "near_dup", "token_files", "pii", "warc", "whitening", "trie", "jaccard_join"]


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {name: q for m in MODULES for name, q in import_module(f"outagelens.llm.{m}").QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
