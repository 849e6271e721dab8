"""Embedding whitening: float32 eigenvectors of a distributed covariance, refined in higher precision.

Entries become integers on a fixed grid, so the sums of every dimension are exact. One pass gives them, a second one the
covariance: rows are centred on the integers next to the mean, multiplied batch by batch, and the products are added up by
matrix entry (dimension^2 rows a task, whatever its rows). Its eigenvectors are first found in float32 on the driver and then
corrected by iterations of matrix products in extended precision (Ogita and Aishima): the products tell how far the vectors
are from orthogonal and the matrix from diagonal, and give the correction. Where eigenvalues lie too close together for that,
their vectors span the right space but are mixed; a small eigenproblem of the matrix, shifted by their mean and seen in that
space, turns them. A third pass measures the covariance of the whitened rows; the last one writes them.

Edge cases: rows whose vector is null, or holds a null or an entry that isn't finite, go, and so do rows whose vector is not as
long as that of most other rows (of the longer vectors, if two lengths are as frequent). A null id stays; repeated rows
count as often as they are there. Components without variance (constant or dependent dimensions, a single row) can't be
whitened and are left out; so a table without variance, like an empty one, gives no rows. Extra columns are ignored.
Sums beyond 64 bits raise an ArithmeticError.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outagelens.llm.common import table

#: an entry c becomes floor(SCALE * c) + SHIFT
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: entries beyond this cannot be held on the grid
LARGEST = 2.0 ** 52
#: corrections end when what is left off the diagonal is under so many units of double precision for each dimension
ULPS, MOST_STEPS = 8, 40

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    """What the passes over all rows give: rows, sum of each dimension on the grid, eigenvalues (falling) and unit vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def grid(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the clean vectors of this width, their entries on the grid)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    at = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), width), False)))
    flat = lists.take(pa.array(at)).flatten().cast(pa.float64())
    c = np.asarray(pc.fill_null(flat, np.nan), dtype=np.float64).reshape(len(at), width)
    good = np.isfinite(c).all(axis=1)
    c = c[good]
    if c.size and np.abs(c).max() >= LARGEST / SCALE:
        raise ArithmeticError(f"an entry of {np.abs(c).max()} is beyond the grid's exact range")
    return at[good], np.floor(SCALE * c).astype(np.int64) + SHIFT


def _totals(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and sums of the vectors' most frequent length."""
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            lists = b.column(0)
            for width in pc.unique(pc.list_value_length(lists).drop_null()).to_pylist():
                _, x = grid(lists, width)
                if width and len(x):
                    have = found.setdefault(width, [0, np.zeros(width, dtype=np.int64)])
                    have[0] += len(x)
                    have[1] += x.sum(axis=0)
        for width, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width, width)), pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(s)],
                names=["width", "dim", "n", "s"])

    by_dim = rows.mapInArrow(add, "width long, dim long, n long, s long").groupBy("width", "dim").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    # one row for each length, with an entry for each dimension
    best = (by_dim.groupBy("width").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "s"))).alias("sums"))
            .orderBy(F.desc("n"), F.desc("width")).limit(1).collect())
    if not best:
        return 0, np.zeros(0, dtype=np.int64)
    return best[0]["n"], np.array([r["s"] for r in best[0]["sums"]], dtype=np.int64)


def _products(rows: DataFrame, width: int, batch) -> np.ndarray:
    """Sum over all tasks of the symmetric matrix that ``batch`` gives for grid rows, added up by entry."""
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            _, x = grid(b.column(0), width)
            if len(x):
                part = batch(x)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    got = rows.mapInArrow(add, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # dimension^2 / 2 rows
    side = int(got["i"].max()) + 1
    out = np.zeros((side, side))
    out[got["i"], got["j"]] = got["v"]
    out[got["j"], got["i"]] = got["v"]
    return out


def covariance(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance of the grid rows, divisor n, from rows centred on the integers next to the mean (exact while sums stay under 2^53)."""
    middle = np.array([(2 * int(s) + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([float(int(s) - n * int(m)) / n for s, m in zip(sums, middle, strict=True)])

    def batch(x: np.ndarray) -> np.ndarray:
        d = (x - middle).astype(np.float64)
        return d.T @ d

    return _products(rows, len(sums), batch) / n - np.outer(rest, rest)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, from float32 vectors corrected step by step."""
    scale = np.abs(a).max()
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    a = (a / scale).astype(np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(np.longdouble)
    eps, norm = float(np.finfo(np.float64).eps), float(np.linalg.norm(a.astype(np.float64), 2))
    for _ in range(MOST_STEPS):
        r = np.eye(len(a)) - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        values = s.diagonal() / (1 - r.diagonal())
        order = np.argsort(-values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        # what two eigenvalues must differ by for their vectors to be told apart at this step
        near = 2 * float(np.linalg.norm((s - np.diag(values)).astype(np.float64), 2) + norm * np.linalg.norm(r.astype(np.float64), 2))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > near
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        cuts = np.flatnonzero(-np.diff(values) > near) + 1
        for lo, hi in zip((0, *cuts), (*cuts, len(a)), strict=True):
            if hi - lo > 1:
                x[:, lo:hi] = x[:, lo:hi] @ _turn(a, x[:, lo:hi], values[lo:hi].mean())
        if near <= ULPS * len(a) * eps * norm:
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


def _turn(a: np.ndarray, x: np.ndarray, middle: np.longdouble) -> np.ndarray:
    """Sub-solve of a cluster: the rotation within the span of ``x`` that makes ``a`` diagonal there."""
    small = x.T @ (a @ x - middle * x)
    small = (small + small.T) / 2
    size = np.abs(small).max()
    if not size:
        return np.eye(x.shape[1])
    # shifted and scaled, the differences between the cluster's values fill the whole mantissa
    return np.linalg.eigh((small / size).astype(np.float64))[1][:, ::-1].astype(np.longdouble)


def fit(rows: DataFrame) -> Fit | None:
    """Rows, sums and eigenvectors of all clean vectors of ``rows`` (one column); None without any."""
    n, sums = _totals(rows)
    if not n:
        return None
    v = covariance(rows, n, sums)
    values, vectors = eigen(v)
    return Fit(n, sums, values, vectors, float(np.trace(v)))


def _projector(found: Fit, most: int):
    """(number of components, function from grid rows to whitened rows): components with a variance above rounding, ``most`` of them at most."""
    limit = found.values[0] * len(found.values) * np.finfo(np.float64).eps if len(found.values) else 0.0
    k = min(most, int((found.values > max(limit, 0.0)).sum()))
    w = found.vectors[:, :k] / np.sqrt(found.values[:k])
    whole = np.array([int(s) // found.n for s in found.sums], dtype=np.int64)
    rest = np.array([float(int(s) % found.n) / found.n for s in found.sums])

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - whole).astype(np.float64) - rest) @ w

    return k, project


def identity_error(rows: DataFrame, found: Fit, most: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k, project = _projector(found, most)

    def batch(x: np.ndarray) -> np.ndarray:
        z = np.concatenate((project(x), np.ones((len(x), 1))), axis=1)  # the last row holds the sums
        return z.T @ z

    total = _products(rows, len(found.sums), batch)
    mean = total[:k, k] / found.n
    return float(np.abs(total[:k, :k] / found.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS) -> DataFrame:
    """A row for each clean vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = df.select(F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    found = fit(vectors)
    empty = df.sparkSession.createDataFrame([], OUT)
    if found is None:
        return empty
    k, project = _projector(found, components)
    if not k:
        return empty
    error, n, sums, width = identity_error(vectors, found, components), found.n, found.sums, len(found.sums)
    explained = found.values[:k] / found.trace

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = grid(b.column(1), width)
            if not len(at):
                continue
            far = float(n) * np.abs(x).max() + float(np.abs(sums).max())
            d = n * x - sums if far < 2.0 ** 63 else None
            if d is None or float(np.abs(d).max()) ** 2 * width >= 2.0 ** 63:
                raise ArithmeticError("the squared deviations are beyond 64 bits")
            ids = b.column(0).take(pa.array(np.repeat(at, k)))
            m = len(at)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                 pa.array(np.repeat((d * d).sum(axis=1), k)), pa.array(project(x).ravel()), pa.array(np.tile(explained, m)),
                 pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).mapInArrow(write, OUT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


QUERIES = {"op11_whitening": (op11_whitening, None)}
