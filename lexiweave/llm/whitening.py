"""Whitening of embeddings by a tall-and-skinny QR (TSQR), without forming a covariance.

Entries become whole numbers (floor(1024 c) + 100000), so sums are exact. Rows are centred by these sums, each
partition folds its rows into one triangular factor R by repeated QR, factors are merged in a tree, and the right
singular vectors of the last R are the components: R'R is the sum over centred rows of their outer products. What
reaches the driver is bounded by the dimension: a sum a dimension, one R, and the products of a few components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

SCALE, SHIFT = 1024, 100000
LARGEST = float(1 << 52)  # of a scaled entry: beyond it a double has no halves left, and floor() means nothing
FAN_IN = 4
COMPONENTS = 8


@dataclass
class Whitening:
    """n rows with the sums of their whole numbers; components as columns, falling by eigenvalue."""

    dimension: int
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (doubles) of the rows whose vector is neither null nor empty and holds finite entries only."""
    vec = F.transform(F.col(f"`{vec_col}`"), lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    picked = rows.select(F.col(f"`{id_col}`").alias("id"), vec.alias("vec"))
    return picked.filter((F.size("vec") > 0) & F.forall("vec", lambda v: F.abs(v * SCALE) <= LARGEST))  # a NaN is above every number


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension) * SCALE).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size, pos, n, s: counts and exact sums of a partition by length of vector; entries are added in two halves."""
    total: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        vec = batch.column(0)
        sizes = vec.value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            x = _matrix(vec.filter(pa.array(sizes == size)), size)
            high, low = (x >> 24).sum(axis=0).tolist(), (x & 0xFFFFFF).sum(axis=0).tolist()
            n, s = total.get(size, (0, [0] * size))
            total[size] = (n + len(x), [a + (h << 24) + b for a, h, b in zip(s, high, low)])
    rows = [(size, pos, n, Decimal(v)) for size, (n, s) in total.items() for pos, v in enumerate(s)]
    columns = list(zip(*rows)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)))], ["size", "pos", "n", "s"])


def exact_sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(dimension, n, sums) of the most frequent length of vector, the longer one on a tie; (0, 0, []) of an empty table."""
    parts = vectors.select("vec").mapInArrow(_sums, "size int, pos int, n long, s decimal(38,0)")
    sums = checkpoint(parts.groupBy("size", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    top = sums.filter("pos = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not top:
        return 0, 0, []
    size = top[0]["size"]
    return size, int(top[0]["n"]), [int(r.s) for r in sums.filter(F.col("size") == size).orderBy("pos").collect()]


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exact: of 64-bit integers where they hold it, else of Python's."""
    if len(x) and n * int(np.abs(x).max()) + max(map(abs, sums)) >= 1 << 62:
        return n * x.astype(object) - np.array(sums, dtype=object)
    return n * x - np.array(sums, dtype=np.int64)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_scaled(x, n, sums) / n).astype(np.float64)


def _deviation(d: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    if d.dtype != object and len(d) and int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    d = d.astype(object)
    return (d * d).sum(axis=1).tolist()


def _factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _partition_factor(dimension: int, n: int, sums: list[int]):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r, waiting, held = np.zeros((0, dimension)), [], 0
        for batch in batches:
            waiting.append(_centred(_matrix(batch.column(0), dimension), n, sums))
            held += len(waiting[-1])
            if held > 4 * dimension:
                r, waiting, held = _factor(np.vstack([r, *waiting])), [], 0
        if held:
            r = _factor(np.vstack([r, *waiting]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    return fold


def _merge(dimension: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        r = _factor(np.vstack([np.frombuffer(b).reshape(-1, dimension) for b in pdf["r"]]))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "r": [r.tobytes()]})

    return merge


def tsqr(vectors: DataFrame, dimension: int, n: int, sums: list[int], fan_in: int = FAN_IN) -> np.ndarray:
    """R of the centred rows: a factor a partition, then fan_in of them merged in a task, level by level."""
    factors = checkpoint(vectors.select("vec").mapInArrow(_partition_factor(dimension, n, sums), "part long, r binary"))
    width = 1
    while factors.count() > 1:
        width *= fan_in
        factors = checkpoint(factors.groupBy(F.floor(F.col("part") / width).alias("g")).applyInPandas(_merge(dimension), "part long, r binary"))
    return np.frombuffer(factors.first()["r"]).reshape(-1, dimension)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors of the most frequent length (other lengths are left out); None of an empty table.

    Components without variance (as of one row, or of rows that are all equal) cannot be whitened and are left out.
    """
    dimension, n, sums = exact_sums(vectors)
    if not n:
        return None
    r = tsqr(vectors.filter(F.size("vec") == dimension), dimension, n, sums)
    _, s, right = np.linalg.svd(r)
    s = np.pad(s, (0, dimension - len(s)))
    kept = int((s[:components] > max(s[0] * 1e-12, 0.0)).sum())
    v = right[:kept].T.copy()
    v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(kept)])
    e = s * s / n
    return Whitening(dimension, n, sums, v, e[:kept], e[:kept] / e.sum() if kept else e[:0])


def _whitened(model: Whitening, d: np.ndarray) -> np.ndarray:
    return (d / model.n).astype(np.float64) @ model.components / np.sqrt(model.eigenvalues)


def _products(model: Whitening):
    k = len(model.eigenvalues)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean, n = np.zeros((k, k)), np.zeros(k), 0  # Chan's way: products about the running mean
        for batch in batches:
            w = _whitened(model, _scaled(_matrix(batch.column(0), model.dimension), model.n, model.sums))
            if not len(w):
                continue
            m = w.mean(axis=0)
            shift, c = m - mean, w - m
            total += c.T @ c + np.outer(shift, shift) * (n * len(w) / (n + len(w)))
            mean, n = mean + shift * (len(w) / (n + len(w))), n + len(w)
        if n:
            i, j = np.triu_indices(k)
            total += n * np.outer(mean, mean)  # about the exact mean, which is zero
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "c"])

    return products


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of whitened rows, less the identity."""
    sums = vectors.select("vec").mapInArrow(_products(model), "i int, j int, c double").groupBy("i", "j").agg(F.sum("c").alias("c"))
    return max((abs(r.c / model.n - (r.i == r.j)) for r in sums.collect()), default=0.0)


def _apply(model: Whitening, error: float, id_type: pa.DataType):
    k = len(model.eigenvalues)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _scaled(_matrix(batch.column(1), model.dimension), model.n, model.sums)
            rows = len(d)
            if not rows:
                continue
            at = pa.array(np.repeat(np.arange(rows), k))
            deviation = pa.array([Decimal(v) for v in _deviation(d)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at).cast(id_type), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n, np.int64)), deviation.take(at),
                    pa.array(_whitened(model, d).ravel()), pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return apply


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Left out: vectors that are null, empty, hold a null or a number that is not finite (or whose scaled value is over
    2^52), or are not of the most frequent length. Repeated rows count and are returned as often as they are there, a
    null vec_id stays null, other columns are not read, an empty table gives no rows. Fewer components are returned
    where the vectors have fewer dimensions or vary in fewer directions; none, and so no rows, if all are equal.
    deviation, the sum over dimensions of (n x - sums)^2, is exact, a decimal.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    vectors = usable(rows, id_col, vec_col)
    kind = vectors.schema["id"].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(vectors, components)
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], schema)
    vectors = vectors.filter(F.size("vec") == model.dimension)
    error = identity_error(vectors, model)
    return vectors.mapInArrow(_apply(model, error, to_arrow_type(kind)), schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as a long; null where it does not fit into one."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
