"""Corpus pipeline over ``documents``: each stage's rows are written and read again as the next one's documents.

Rows with a null doc_id pass the near-duplicate stage; rows that share a doc_id stay or go together there. An empty
``documents`` gives no rows; empty ``labels`` or ``benchmark`` leave only the base rules, or reject nothing. Extra columns,
whatever their names, pass all stages but the last: while a stage judges a row, its columns are in one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outagelens.llm import decontaminate, line_dedup, near_dup, packing, quality, tokens
from outagelens.llm.common import stored, table


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all columns as the struct ``__row``."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the log-likelihood ratio reject go."""
    rated = quality.with_quality(wrapped(docs), table(spark, sf_dir, "labels"))
    return rated.where("kept").select("__row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated windows go; every document stays, n_chars follows its text."""
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("__row.n_chars"))}
    return line_dedup.dedup_lines(wrapped(docs)).select(*(new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest doc_id stays."""
    others = near_dup.classes(docs.select("doc_id", "text")).where("doc_id <> class_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    judged = decontaminate.with_verdict(wrapped(docs), table(spark, sf_dir, "benchmark"))
    return judged.where("not contaminated").select("__row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place there."""
    return packing.pack_documents(docs, tokens.default_path())


STAGES = [("quality", quality_rules), ("line_dedup", lines), ("near_dup", near_duplicates),
          ("decontaminate", benchmark), ("packing", pack)]

#: SQL cannot express the quality model, the near-duplicate signatures and the packing
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
