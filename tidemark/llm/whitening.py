"""Embedding whitening: principal components of all vectors, and each vector's coordinates on them at unit variance.

Vectors are quantised to whole numbers, so that their sums and squared deviations are exact. Spark MLlib's singular value
decomposition of the centred rows gives components and singular values; these divided by the square root of the number of
rows are standard deviations. The total variance does not come from the decomposition but from the exact deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: An entry c is kept as floor(STEPS * c) + OFFSET.
STEPS, OFFSET = 1024, 100_000
#: A component whose standard deviation is a smaller share of the first one's is rounding, and left out.
LEAST = 1e-6
#: Dimensions up to which the decomposition is of the whole matrix of products, which is exact to double precision.
WHOLE = 15_000


@dataclass(frozen=True)
class Model:
    """n vectors with sums by dimension and their range; components as columns, and their variances, falling."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    components: np.ndarray
    variances: np.ndarray

    @property
    def mean(self) -> list[float]:
        """Each quotient is rounded once."""
        return [float(Fraction(s, self.n)) for s in self.sums]


def usable(vector: Column) -> Column:
    """Whether a vector is there, and all its entries are finite numbers."""
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _whole(values: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * values).astype(np.int64) + OFFSET


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of a batch, all of this length, as whole numbers."""
    return _whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def vectors_of(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): usable vectors as doubles. Vectors have one length: the one that most rows have, of such the greatest."""
    out = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    lengths = out.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    size = lengths.agg(F.max_by("size", F.struct("n", "size"))).first()[0]
    return out.where(F.size("v") == (size or 0))


def totals(vectors: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """Rows, and by dimension the exact sum, least and greatest: a row for each dimension and task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), len(batch.column(0)[0]))
            n += len(x)
            if sums is None:
                sums, low, high = x.sum(axis=0), x.min(axis=0), x.max(axis=0)
            else:
                sums, low, high = sums + x.sum(axis=0), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if sums is not None:
            yield pa.RecordBatch.from_pydict({"dim": np.arange(len(sums), dtype=np.int32), "n": np.full(len(sums), n), "sum": sums, "low": low, "high": high})

    told = vectors.select("v").mapInArrow(run, "dim int, n long, sum long, low long, high long")
    each = told.groupBy("dim").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "sum")], F.min("low").alias("low"), F.max("high").alias("high"))
    each = sorted(each.collect(), key=lambda r: r["dim"])
    return int(each[0]["n"]) if each else 0, *[[int(r[c]) for r in each] for c in ("sum", "low", "high")]


def fit(vectors: DataFrame, most: int) -> Model:
    """The model of vectors (id, v), with `most` components or as many as vary."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    n, sums, low, high = totals(vectors)
    model = Model(n, sums, low, high, np.zeros((len(sums), 0)), np.zeros(0))
    if low == high:  # no row, no dimension, or nothing that varies
        return model
    whole = F.transform("v", lambda v: (F.floor(v * STEPS) + OFFSET).cast("double"))
    centred = vectors.select(array_to_vector(F.zip_with(whole, F.array(*map(F.lit, model.mean)), lambda x, m: x - m)).alias("v"))
    size = len(sums)
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, size)
    found = matrix.computeSVD(size if size <= WHOLE else min(most, size), computeU=False, rCond=LEAST)
    deviations = found.s.toArray()[:most]
    components = found.V.toArray()[:, : len(deviations)]
    return Model(n, sums, low, high, components, deviations**2 / n)


def whiten(rows: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable vector and component, from 1.

    deviation: the squared distance of n times the vector from the sums, exact (an error where it is beyond a long);
    explained: the component's share of the total variance; identity_error: the largest entry by which the covariance of
    all whitened vectors is off the identity. Vectors that are null, hold null or no finite number, or are of another
    length than most, are left out. Repeated rows and null ids have rows each. Components of equal variance may be any of
    their plane. There are at most as many as dimensions vary; no vectors, or equal ones, give no rows. Driver and tasks
    hold a matrix of dimensions by dimensions, whatever the number of rows.
    """
    spark = rows.sparkSession
    scratch = common.Scratch(spark)
    vectors = vectors_of(rows, id_col, vector_col)
    model = fit(vectors, most)
    k = len(model.variances)
    kind = common.ddl(rows, id_col, "id")
    if not k:
        return spark.createDataFrame([], f"{kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    n, sums, mean = model.n, np.array(model.sums, np.int64), np.array(model.mean)
    weights = model.components / np.sqrt(model.variances)
    # No row's deviation is beyond this; above a long, whole numbers of any size are used.
    bound = sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for s, a, b in zip(model.sums, model.low, model.high, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(sums))
            off = x * n - sums if bound < 1 << 63 else x.astype(object) * n - sums.astype(object)
            w = (x - mean) @ weights
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((off * off).sum(axis=1).tolist(), pa.int64()), flat], names=["id", "deviation", "w"])

    out = scratch.write("whitened", vectors.mapInArrow(run, f"{kind}, deviation long, w array<double>"))
    first = out.agg(F.sum(F.col("deviation").cast("decimal(38,0)")).alias("total"), *[(F.sum(F.col("w")[j]) / n).alias(f"m{j}") for j in range(k)]).first()
    total = float(Fraction(int(first["total"]), n**3))
    centred = [F.col("w")[j] - first[f"m{j}"] for j in range(k)]
    products = out.agg(*[(F.sum(centred[i] * centred[j]) / n - int(i == j)).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    shares = F.array(*[F.lit(float(e / total)) for e in model.variances])
    return out.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(float(max(abs(c) for c in products))).alias("identity_error"),
    )
