"""Line dedup [native]: overlapping windows of three consecutive lines, removed where they occurred before.

A text is cut at ``\\n``. Each three consecutive lines that aren't all blank are a window, known by two 64-bit
hashes made from the hashes of its lines. A window's first occurrence is the one with the smallest
(doc_id, line number); the lines of every other occurrence are removed, overlapping ones merged.

Edge cases: null text stays null; texts of fewer than three lines and rows with a null doc_id stay as they
are; rows that share a doc_id are one document (each gets its removals); no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outagelens.llm.common import others, stored, table

WINDOW = 3


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the sorted line numbers at which a window starts that occurred before."""
    hashed = docs.where("doc_id is not null").select("doc_id", F.expr(
        "transform(split(text, '\\n', -1), l -> struct(xxhash64(l) as a, xxhash64('line', l) as b, trim(l) = '' as c))"
    ).alias("h")).where(F.size("h") >= window)
    each = [f"h[i + {k}]" for k in range(window)]
    starts = (f"filter(sequence(0, size(h) - {window}), i -> not ({' and '.join(x + '.c' for x in each)}))")
    rows = hashed.select("doc_id", F.expr(
        f"inline(transform({starts}, i -> struct(i as line, xxhash64({', '.join(x + '.a' for x in each)}) as w1, "
        f"xxhash64({', '.join(x + '.b' for x in each)}) as w2)))"))
    rows = stored(rows, "line-windows")
    # summed before the shuffle, so a window with very many occurrences is a row for each task;
    # written, so that the join below may split its partitions
    found = stored(rows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"))
                   .where("n > 1").select("w1", "w2", "first"), "repeated-windows")
    later = rows.join(found, ["w1", "w2"]).where(F.struct("doc_id", "line") != F.col("first"))
    return later.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("starts"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the columns ``kept_text``, ``n_lines`` and ``n_removed`` appended (or replaced)."""
    gone = repeated_windows(docs, window).select(F.col("doc_id").alias("__id"), F.col("starts").alias("__starts"))
    both = docs.join(gone, F.col("doc_id") == F.col("__id"), "left").withColumn("__lines", F.expr("split(text, '\\n', -1)"))
    # what stays lies before, between and after the removed windows
    both = both.withColumn("__keep", F.expr(
        f"filter(transform(sequence(0, size(__starts)), i -> struct("
        f"if(i = 0, 0, __starts[i - 1] + {window}) as lo, if(i = size(__starts), size(__lines), __starts[i]) as hi)), "
        f"r -> r.hi > r.lo)"))
    kept = F.expr("flatten(transform(__keep, r -> slice(__lines, r.lo + 1, r.hi - r.lo)))")
    same = F.col("__starts").isNull()
    return both.select(
        *others(docs, "kept_text", "n_lines", "n_removed"), F.when(same, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.when(same, 0).otherwise(F.size("__lines") - F.expr("aggregate(__keep, 0, (s, r) -> s + r.hi - r.lo)"))
        .cast("long").alias("n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed",
                                    F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents),
w AS (
  SELECT doc_id, i, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS win
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth
  FROM w WHERE trim(win, ' ' || chr(10)) <> ''),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1)
SELECT d.doc_id, coalesce(a.n, 0) AS n_lines, coalesce(a.r, 0) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(*) AS n, count(g.i) AS r,
         string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i) AS kept
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id) a ON d.doc_id = a.doc_id
"""

QUERIES = {"op1_line_dedup": (op1_line_dedup, SQL)}
