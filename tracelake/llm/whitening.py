"""PCA whitening of embeddings by a distributed singular value decomposition.

Entries are scaled to whole numbers, so that sums and deviations from the mean are exact: with n vectors and
sums S, n * x - S is a whole number, and its quotient by n is the centred entry. The centred rows are MLlib's
RowMatrix; its singular value decomposition gives the components, and a singular value's square over n is a
component's variance. All components are asked for, for which MLlib sums the rows' outer products in the
executors and decomposes that matrix (as wide as a vector) in double precision on the driver. The variance in
all is not taken from there but from the exact deviations. Rows are projected in blocks by numpy.

What the driver holds is as large as the square of a vector's length, not as the table.

Defined cases
- null vectors, and ones with null or non-finite entries or none, take no part; nor do vectors of another than the most
  frequent length (the smaller one of two equally frequent), or with entries so large that they aren't exact as whole
  numbers (2^43 and beyond). Null ids and repeated rows: rows of their own.
- Components whose variance is below SMALLEST times the largest (as of columns that are constant or repeat others) can't be
  scaled and are left out. No variance at all (one vector, or equal ones), or an empty table: no rows.
- ``deviation`` is a decimal, null beyond 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialise

SCALE, SHIFT = 64, 1_000_000
#: Components in the result; variance, over the largest, below which a component has none.
COMPONENTS, SMALLEST = 32, 1e-13
#: Entries below this are exact as whole numbers after scaling.
_LARGEST = float(1 << 43)


def scaled_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): whole numbers of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < _LARGEST), F.lit(False))))
    rows = rows.select("id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (sizes["d"] if sizes else 0))


def column_sums(rows: DataFrame, column: str) -> tuple[int, list]:
    """The number of rows and the sums of an array's places: sums of blocks first, then one row for each place."""
    kind = "double" if dict(rows.dtypes)[column] == "array<double>" else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                sums = _matrix(batch.column(0)).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(np.full(len(sums), n), pa.int64()), pa.array(sums)], ["place", "n", "total"])

    # Added up as decimals, which whole numbers of any table fit.
    total = F.sum("total") if kind == "double" else F.sum(F.col("total").cast("decimal(30,0)"))
    found = in_small_batches(rows).select(column).mapInArrow(run, f"place int, n long, total {kind}").groupBy("place").agg(F.sum("n").alias("n"), total.alias("total")).orderBy("place").collect()
    return (found[0]["n"] if found else 0), [r["total"] if kind == "double" else int(r["total"]) for r in found]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: Column, sums: list[int], n: int) -> Column:
    """x - S / n as doubles. The whole part of the mean comes off first, exactly, so that nothing is lost of entries far from 0."""
    whole, rest = zip(*[divmod(s, n) for s in sums], strict=True)
    near = F.zip_with(x, F.array(*[F.lit(w).cast("long") for w in whole]), lambda a, w: a - w)
    return F.zip_with(near, F.array(*[F.lit(r / n) for r in rest]), lambda a, r: a - r)


def row_matrix(vectors: Column, rows: DataFrame) -> RowMatrix:
    """A distributed matrix of a column of arrays; built in the JVM."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(vectors).alias("v")), "v"))


def decompose(vectors: Column, rows: DataFrame, n: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances (divisor n), falling, and unit components as columns, of ``n`` centred vectors of length ``d``."""
    found = row_matrix(vectors, rows).computeSVD(d, computeU=False, rCond=SMALLEST**0.5)
    # Singular values belong to sums over the rows; divided by n their squares are variances.
    variances, basis = np.array(found.s.toArray()) ** 2 / n, np.array(found.V.toArray())
    some = variances > SMALLEST * variances.max(initial=0)
    return variances[some], basis[:, some]


def second_moments(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """The covariance (divisor n) of an array column, centred before multiplying."""
    mean = [s / n for s in column_sums(rows, column)[1]]
    vectors = F.zip_with(column, F.array(*map(F.lit, mean)), lambda a, m: a - m)
    return np.array(row_matrix(vectors, rows).computeGramianMatrix().toArray()) / n


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every row that takes part and each of the
    first ``components`` components.

    ``deviation``: the row's squared distance from the mean times n^2, exact. ``explained``: the component's share of
    all variance. ``identity_error``: the largest entry of the whitened rows' covariance less the identity."""
    spark = table.sparkSession
    none = spark.createDataFrame([], "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = materialise(scaled_vectors(table, id_col, vector_col), "scaled")
    n, sums = column_sums(rows, "x")
    if not n:
        return none
    variances, basis = decompose(centred(F.col("x"), sums, n), rows, n, len(sums))
    if not len(variances):
        return none
    k = min(components, len(variances))
    scaled = basis[:, :k] / np.sqrt(variances[:k])
    whole, rest = (np.array(part, np.int64) for part in zip(*[divmod(s, n) for s in sums], strict=True))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column(1)) - whole
                squares = _squares(near, rest, n)
                flat = pa.array(((near - rest / n) @ scaled).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * k, pa.int32()), flat)
                exact = pa.array([Decimal(s) if s < 10**38 else None for s in squares], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column(0), exact, pa.array([s / n**2 for s in squares]), lists], ["id", "deviation", "distance", "w"])

    found = materialise(rows.mapInArrow(project, "id long, deviation decimal(38,0), distance double, w array<double>"), "whitened")
    # The mean squared distance is the variance in all; each distance is of an exact deviation.
    total = found.agg(F.sum("distance")).first()[0] / n
    error = float(np.abs(second_moments(found, "w", n) - np.eye(k)).max())
    shares = F.array(*[F.lit(float(e / total)) for e in variances[:k]])
    each = found.select("id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def _squares(near: np.ndarray, rest: np.ndarray, n: int) -> list[int]:
    """The exact sums of squares of n * near - rest, by rows."""
    d, largest = near.shape[1], (int(np.abs(near).max()) + 1) * n
    if largest >= 1 << 62 or d > 1 << 20:
        return [sum(v * v for v in row) for row in (near.astype(object) * n - rest.astype(object)).tolist()]
    size = np.abs(near * n - rest)
    if d * largest**2 < 1 << 63:
        return (size * size).sum(axis=1).tolist()
    # Halves of 31 bits, whose products fit in 62; sums of those are taken in two parts.
    high, low, part = size >> 31, size & ((1 << 31) - 1), (1 << 20) - 1
    sums = lambda p: (p >> 20).sum(axis=1).astype(object) * (1 << 20) + (p & part).sum(axis=1).astype(object)
    return (sums(high * high) * (1 << 62) + sums(high * low) * (1 << 32) + sums(low * low)).tolist()
