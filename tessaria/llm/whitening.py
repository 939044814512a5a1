"""Operator 12, embedding whitening: covariances from variances of dimensions and of sums of two dimensions.

An entry becomes an integer, so all sums are exact. One pass counts the vectors and sums each dimension; a second sums
the squares of every centred dimension and of every sum of two centred dimensions. With var(a + b) = var(a) + var(b) +
2 cov(a, b), differences of these variances are all covariances, the matrix is assembled on the driver (dimensions
squared, whatever the number of rows) and decomposed there. Tasks send one row for each pair of dimensions, never one
for each vector. A third pass sums the whitened vectors' products for the identity check, a last one writes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StructField, StructType

from .common import carried, table

#: Entries times SCALE, rounded down, plus SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Integers up to INT64 keep int64 arithmetic; larger ones are computed with Python's integers. Scaled entries are held within HELD.
INT64, HELD = 1 << 62, 1 << 53
#: A component whose variance is no more than this share of the total has none.
NO_VARIANCE = 1e-12
EXACT = DecimalType(38, 0)


def _integers(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vector in the column (or the one asked for): the length, the rows' places and their integers."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths) if size is None else [size]:
        at = np.flatnonzero(lengths == n)
        if n > 0 and len(at):
            values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
            ok = np.isfinite(values).all(axis=1)
            scaled = np.clip(np.floor(SCALE * values[ok]), -float(HELD), float(HELD))
            yield int(n), at[ok], scaled.astype(np.int64) + SHIFT


def _exact(x: np.ndarray, factor: int = 1) -> np.ndarray:
    """x, as Python integers where int64 might not hold factor times its largest entry."""
    largest = max(int(x.max()), -int(x.min())) if x.size else 0
    return x if largest * factor < INT64 else x.astype(object)


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for n, at, x in _integers(batch.column(0)):
            count[n] = count.get(n, 0) + len(at)
            total[n] = total.get(n, np.zeros(n, object)) + _exact(x, len(x) + 1).sum(axis=0).astype(object)
    for n, s in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([n] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([count[n]] * n, pa.int64()), _decimals(s)], ["size", "d", "n", "s"])


def _squares(size: int, centre: np.ndarray):
    """Sums of squares of centred dimensions (j = i) and of sums of two (i < j); centre holds the integers next to the means."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = [np.zeros(size - i, object) for i in range(size)], 0
        for batch in batches:
            for _, _, x in _integers(batch.column(0), size):
                z = _exact(x - centre)
                largest = int(np.abs(z).max()) if z.size else 0
                z = z if 4 * largest * largest * (len(z) + 1) < INT64 else z.astype(object)
                rows += len(z)
                for i in range(size):
                    y = z[:, i:] + z[:, i : i + 1]
                    y[:, 0] = z[:, i]
                    total[i] = total[i] + (y * y).sum(axis=0).astype(object)
        if rows:
            for i in range(size):
                yield pa.RecordBatch.from_arrays([pa.array([i] * (size - i), pa.int64()), pa.array(range(i, size), pa.int64()), _decimals(total[i])], ["i", "j", "q"])
    return run


class Whitening:
    """What the fit list says: n, the sums of its dimensions, and its components by falling variance.

    components is dimensions x k, each column a unit eigenvector; scale holds 1 / sqrt(eigenvalue), 0 without variance.
    """

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, most: int) -> None:
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:most]
        trace = float(np.trace(covariance))
        self.n, self.sums, self.covariance = n, sums, covariance
        self.values, self.components = values[order], vectors[:, order]
        self.varies = self.values > NO_VARIANCE * trace if trace > 0 else np.zeros(len(order), bool)
        self.scale = np.where(self.varies, 1 / np.sqrt(np.where(self.varies, self.values, 1.0)), 0.0)
        self.explained = np.where(self.varies, self.values / (trace or 1.0), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        largest = max(map(abs, [*self.sums, 0])) + self.n * int(np.abs(x).max() if x.size else 0)
        if largest < INT64:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows of n * x - sums, whitened."""
        return (y.astype(np.float64) / self.n) @ self.components * self.scale


def fit(vectors: DataFrame, column: str = "embedding", most: int = 32) -> Whitening | None:
    """Fits the whitening to all rows with a vector of finite entries; None if there is none.

    The vectors' length is that of most rows (of equally many the larger); vectors of another length are left out.
    """
    only = vectors.select(column)
    sums = only.mapInArrow(_sums, StructType([StructField(x, LongType()) for x in ("size", "d", "n")] + [StructField("s", EXACT)]))
    sums = sums.groupBy("size", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    largest = sums.filter("d = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if largest is None:
        return None
    size, n = largest["size"], largest["n"]
    s = [0] * size
    for r in sums.filter(F.col("size") == size).collect():  # as many rows as dimensions
        s[r["d"]] = int(r["s"])
    centre = [(2 * x + n) // (2 * n) for x in s]
    pairs = only.mapInArrow(_squares(size, np.array(centre, np.int64)), StructType([StructField("i", LongType()), StructField("j", LongType()), StructField("q", EXACT)]))
    rest = [x - n * c for x, c in zip(s, centre, strict=True)]  # sums of the centred integers, under n
    # n * n times the variance of a dimension or a sum of two is n * (sum of squares) - (sum)^2, in whole numbers.
    spread = {}
    for r in pairs.groupBy("i", "j").agg(F.sum("q").alias("q")).collect():  # dimensions squared, half
        i, j = r["i"], r["j"]
        t = rest[i] if i == j else rest[i] + rest[j]
        spread[i, j] = n * int(r["q"]) - t * t
    covariance = np.zeros((size, size))
    for (i, j), v in spread.items():
        exact = v if i == j else v - spread[i, i] - spread[j, j]
        covariance[i, j] = covariance[j, i] = exact / (n * n if i == j else 2 * n * n)
    return Whitening(n, s, covariance, most)


def identity_error(vectors: DataFrame, fitted: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance.

    Vectors are centred in whole numbers before they are projected; what rounding leaves of their means is taken off at the end.
    """
    size, k, sent = len(fitted.sums), len(fitted.values), vectors.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, total = sent.value, np.zeros((k + 1, k))
        for batch in batches:
            for _, _, x in _integers(batch.column(0), size):
                w = f.whitened(f.centred(x))
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    total = np.zeros((k + 1, k))
    for r in vectors.select(column).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # (k + 1) * k rows
        total[r["i"], r["j"]] = r["v"] / fitted.n
    error = np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k))[np.ix_(fitted.varies, fitted.varies)]
    return float(error.max()) if error.size else 0.0


def whiten(vectors: DataFrame, column: str = "embedding", most: int = 32, carry: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """One row per vector of the fit list and component: carried columns, component, n, deviation, whitened, explained, identity_error.

    vectors has the array column and the carried ones. Rows whose vector is null, empty or holds null or non-finite
    entries are dropped, so are vectors of another length than most rows have. An entry c becomes floor(64 c) +
    1,000,000, 64 c held within 2^53. All that remains, repeated rows included, is the fit list. Components are numbered from
    1 by falling variance, `most` at most; one without variance (equal vectors, fewer vectors than dimensions) has
    whitened 0 and no part in identity_error. deviation is null where it doesn't fit a long. A carried column named
    like an output gets `_carried` after its name. No vectors give an empty result.
    """
    spark, outputs = vectors.sparkSession, ("component", "n", "deviation", "whitened", "explained", "identity_error")
    kept = carried(carry, outputs)
    fitted = fit(vectors, column, most)
    names = vectors.select(*kept).columns
    mark, out_schema = "tessaria_vector", vectors.select(*kept).schema
    schema = StructType([*out_schema.fields, *StructType.fromDDL("deviation long, tessaria_w array<double>").fields])
    if fitted is None:
        empty = spark.createDataFrame([], schema)
        n, explained, error = 0, [], 0.0
    else:
        n, explained, error = fitted.n, [float(x) for x in fitted.explained], identity_error(vectors, fitted, column)
        size, k, sent = len(fitted.sums), len(fitted.values), spark.sparkContext.broadcast(fitted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = sent.value
            for batch in batches:
                for _, at, x in _integers(batch.column(batch.num_columns - 1), size):
                    y = f.centred(x)
                    w = f.whitened(y)
                    big = y.dtype == object or (y.size and int(np.abs(y).max()) ** 2 * size >= INT64)
                    d = (y.astype(object) ** 2).sum(axis=1).tolist() if big else (y * y).sum(axis=1).tolist()
                    d = pa.array([v if v < 1 << 63 else None for v in d], pa.int64())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array(w.ravel()))
                    rest = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*(rest.column(rest.schema.get_field_index(c)) for c in names), d, lists], [*names, "deviation", "tessaria_w"])

        empty = vectors.select(*kept, F.col(column).alias(mark)).mapInArrow(run, schema)
    rows = empty.select(*[F.col(f"`{c}`") for c in names], "deviation", F.posexplode("tessaria_w").alias("tessaria_at", "whitened"))
    share = F.array(*map(F.lit, explained)) if explained else F.expr("cast(array() as array<double>)")
    return rows.select(*[F.col(f"`{c}`") for c in names], (F.col("tessaria_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("tessaria_at")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
#: SQL has no eigenvectors; tests compare with a brute-force version.
ORACLE: dict[str, str] = {}
