"""Shared helpers of the training-data operators: scratch tables, Arrow word splitting, row keys.

Every intermediate table that an operator needs more than once is written to the shared folder
(``spark.checkpoint.dir``) and read back. That cuts the lineage, survives lost executors and makes
the row order and the ids stored in it stable. ``temporary`` deletes those of an operator once its result is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outagelens.session import checkpoint_dir, shuffles_removed

#: texts of an Arrow batch are worked on in runs of about so many bytes
SLICE_BYTES = 4 << 20
#: bytes of an Arrow batch that goes to a Python worker, about (a setting of the session, lowered where it is higher)
BATCH_BYTES = 8 << 20
#: paths of intermediate tables, a list for each open ``temporary``
_open: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing else uses it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/outagelens-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back; with ``keep``, ``temporary`` leaves it there."""
    spark = df.sparkSession
    _small_batches(spark)
    path = scratch_path(spark, name)
    if _open and not keep:
        _open[-1].append(path)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession, delete: bool = True) -> Iterator[None]:
    """Tables that ``stored`` writes within are deleted at the end, so what leaves must not read them (``delete`` off: they stay)."""
    _open.append([])
    try:
        yield
    finally:
        paths = _open.pop()
        for path in paths if delete else ():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _small_batches(spark: SparkSession) -> None:
    """Rows may be whole texts: batches are bounded by bytes besides rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` but those that have one of ``names``, in any case of letters: they are replaced."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


class Words(NamedTuple):
    """The words of some texts: ``vocab[ids[starts[i]:starts[i + 1]]]`` are those of text i."""

    vocab: pa.Array
    ids: np.ndarray
    starts: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def _offsets(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    _, off, data = texts.buffers()
    at = np.frombuffer(off, dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    return at, memoryview(data) if data is not None else memoryview(b"")


def as_strings(texts: pa.Array) -> pa.Array:
    """Plain string array without nulls (a null text is an empty text)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    return pc.fill_null(texts, "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` (from ``as_strings``) holding about ``limit`` bytes; a longer text stands alone."""
    if not len(texts):
        return
    at, _ = _offsets(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, int(at[lo]) + limit, side="right")) - 1)
        yield lo, min(hi, len(texts))
        lo = hi


def translated(texts: pa.Array, byte_table: bytes) -> pa.Array:
    """Every byte mapped through ``byte_table``, which maps ASCII to ASCII and leaves the rest."""
    if not len(texts):
        return texts
    at, data = _offsets(texts)
    new = bytes(data[at[0]:at[-1]]).translate(byte_table)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(new))


def split_words(texts: pa.Array) -> Words:
    """Words between ASCII white space (code points 9-13 and 32), dictionary encoded."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    counts = np.diff(np.asarray(lists.offsets))
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        doc = np.repeat(np.arange(len(texts)), counts)
        counts = np.bincount(doc[full], minlength=len(texts))
        flat = flat.filter(pa.array(full))
    enc = flat.dictionary_encode()
    return Words(enc.dictionary, np.asarray(enc.indices), np.concatenate(([0], np.cumsum(counts))))


def hash64(values: pa.Array) -> np.ndarray:
    """64-bit hash of each string of a (small, distinct) array."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(v) for v in values.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(values))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit integers (splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes (of one flat array; callers mask document edges)."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    acc = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        acc = mix64(acc + h[j:len(h) - n + 1 + j] + np.uint64(0x9E3779B97F4A7C15 + j))
    return acc
