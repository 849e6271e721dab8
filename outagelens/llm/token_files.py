"""Token-ID / binary output: ORC files of token ids, sorted by document id.

Each row of a file is a document: ``doc_id``, the ``part`` (range of document ids) that it was written in,
``part_start`` (ids of the part before it), ``n_tokens`` and ``ids``, whose integers ORC stores run-length encoded.
Files have row indexes and a Bloom filter on ``doc_id``, so a read for some ids skips stripes and row groups, and a
full read is split by stripes. A document's place among all ids is the sizes of the parts before plus ``part_start``.

Edge cases: a null or empty text has only the end id; null doc_ids come first; rows that share a doc_id
follow each other in order of a hash of the text; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagelens.llm.common import scratch_path, table
from outagelens.llm.tokens import crc32_le, default_path, encoded

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()),
                       T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                       T.StructField("ids", T.ArrayType(T.IntegerType()))])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, bloom_fpp: float = 0.01,
                      row_index_stride: int = 10_000) -> None:
    """Encode all whole texts and write them to ``path`` in ascending order of doc_id."""
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi, ids, starts in encoded(b.column(1), tokenizer_path):
                n = hi - lo
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, n), pa.array(np.full(n, part, np.int32)), pa.array(before + starts[:-1]),
                    pa.array(np.diff(starts)), pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(ids))],
                    names=SCHEMA.names)
                before += len(ids)

    # the hash and the row number split documents that share an id
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                 F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
     .repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
     .mapInArrow(encode, SCHEMA).write.format("orc").option("orc.compress", "ZSTD")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(bloom_fpp))
     .option("orc.row.index.stride", str(row_index_stride)).save(path))


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with ``doc_ids`` only those, by a filter that the ORC reader pushes down."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(list(doc_ids)))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    def crc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at, ids = np.asarray(lists.offsets), np.asarray(lists.values)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(3)), pa.array(np.diff(at).astype(np.int64)),
                 pa.array([crc32_le(ids[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], type=pa.int64())],
                names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    rows = read_token_files(spark, path).select("doc_id", "part", "part_start", "ids").mapInArrow(
        crc, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    # one row for each part, not for each document
    sizes = read_token_files(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(offsets, "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, default_path())
    return read_places(spark, path)


QUERIES = {"op8_token_files": (op8_token_files, None)}
