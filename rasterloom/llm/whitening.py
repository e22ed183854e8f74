"""Whitening of embeddings by a compensated covariance.

Three passes over the vectors and two over the results:

1. number of vectors and exact sums of every dimension;
2. covariance: every vector is centred on the mean before anything is multiplied.  Centred entries, products and
   running sums are double-doubles (a high and a low part) made by error-free transformations: the sum of
   two doubles and its rounding error, the product of two doubles and its rounding error.  Each task keeps one
   pair of d x d arrays; high and low parts of the tasks are merged by the same sums, first among ``FAN`` tasks, then
   among the merged, row by row of the matrix, so no place holds more than d rows of each of its tasks;
3. the covariance (d x d, high and low part) goes to the driver, where LAPACK's ``syevd`` (Householder
   reduction to tridiagonal form, then divide and conquer) finds eigenvalues and vectors; one round of
   corrections with residuals in double-double takes off what the solver's rounding left;
4. every vector is projected; a scratch table holds the results;
5. their own covariance, centred and compensated in the same way, tells how far they are from white.

What is broadcast or collected is d x d numbers, never rows.

Vectors that are null, or hold null or non-finite entries, are left out; so are those of another length than
``dimension`` (by default the most frequent length, of equally frequent ones the largest).  Null ids and
repeated rows are rows like others.  Scaled entries beyond 2^50 are refused (ValueError).  A component
without variance has ``whitened`` 0 (its covariance can't be 1, which ``identity_error`` then shows) and, if there is no variance at
all, ``explained`` 0.  A deviation beyond a long is null.  An empty table, or one without usable vectors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

FAN = 256  # tasks whose parts are merged at once
BLOCK = 32  # vectors multiplied at once
LARGEST = 1 << 50
_SPLIT = 134217729.0  # 2^27 + 1 halves a double's digits


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and exactly what the rounding took off."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b rounded, and exactly what the rounding took off."""
    p = a * b
    t = _SPLIT * a
    a1 = t - (t - a)
    t = _SPLIT * b
    b1 = t - (t - b)
    a2, b2 = a - a1, b - b1
    return p, a2 * b2 - (((p - a1 * b1) - a2 * b1) - a1 * b2)


def dd_add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def dd_total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the first axis, halving it again and again."""
    while len(high) > 1:
        if len(high) % 2:
            high, low = np.concatenate([high, np.zeros_like(high[:1])]), np.concatenate([low, np.zeros_like(low[:1])])
        half = len(high) // 2
        high, low = dd_add((high[:half], low[:half]), (high[half:], low[half:]))
    return (high[0], low[0]) if len(high) else (np.zeros(high.shape[1:]), np.zeros(low.shape[1:]))


def outer_products(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of (x - mean)(x - mean)' over the rows of x, as a double-double matrix (upper triangle and its mirror)."""
    d = x.shape[1]
    i, j = np.triu_indices(d)
    total = np.zeros(len(i)), np.zeros(len(i))
    for a in range(0, len(x), BLOCK):
        high, low = dd_add((x[a : a + BLOCK], np.zeros_like(x[a : a + BLOCK])), (-mean[0], -mean[1]))
        p, e = two_product(high[:, i], high[:, j])
        total = dd_add(total, dd_total(p, e + (high[:, i] * low[:, j] + low[:, i] * high[:, j])))
    out = np.zeros((2, d, d))
    for k in (0, 1):
        out[k][i, j] = out[k][j, i] = total[k]
    return out[0], out[1]


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """Arrays of equal length d as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


_PART = "task int, i int, high array<double>, low array<double>"


def _arrays(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1)))


def _parts(d: int, mean: tuple[np.ndarray, np.ndarray]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((d, d)), np.zeros((d, d))
        for batch in batches:
            if len(batch):
                total = dd_add(total, outer_products(_matrix(batch.column(0), d).astype(float), mean))
        task = TaskContext.get().partitionId()
        yield pa.record_batch([pa.array(np.full(d, task, np.int32)), pa.array(np.arange(d, dtype=np.int32)), _arrays(total[0]), _arrays(total[1])], ["task", "i", "high", "low"])

    return each


def _merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("task")
    width = len(rows.column("high")[0])
    high, low = dd_total(_matrix(rows.column("high"), width), _matrix(rows.column("low"), width))
    return pa.table({"task": rows.column("task")[:1], "i": rows.column("i")[:1], "high": _arrays(high[None]), "low": _arrays(low[None])})


def covariance(vectors: DataFrame, column: str, n: int, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Covariance (divisor n) of arrays of one length about ``mean`` (a double-double), as a double-double."""
    d = len(mean[0])
    parts = vectors.select(column).mapInArrow(_parts(d, mean), _PART)
    some = parts.groupBy("i", F.floor(F.col("task") / FAN).alias("_fan")).applyInArrow(_merge, _PART)
    rows = some.groupBy("i").applyInArrow(_merge, _PART).orderBy("i").toArrow()  # d rows of d numbers
    high, low = _matrix(rows.column("high"), d), _matrix(rows.column("low"), d)
    return dd_divide((high, low), float(n))


def dd_divide(a: tuple[np.ndarray, np.ndarray], n: float) -> tuple[np.ndarray, np.ndarray]:
    q = a[0] / n
    p, e = two_product(q, np.full_like(q, n))
    return two_sum(q, ((a[0] - p) - e + a[1]) / n)


def exact_mean(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """S / n of whole numbers as a double-double."""
    whole = [divmod(s, n) for s in sums]
    return two_sum(np.array([float(q) for q, _ in whole]), np.array([r / n for _, r in whole]))


def _times(a: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A double-double matrix times a matrix of doubles."""
    p, e = two_product(a[0][:, :, None], b[None])
    return dd_total(np.swapaxes(p, 0, 1), np.swapaxes(e + a[1][:, :, None] * b[None], 0, 1))


def eigen(v: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns.

    LAPACK's divide-and-conquer solver on the high part; then X (1 + E) with E from residuals R = 1 - X'X and S = X'VX
    in double-double: e_ij = (s_ij + l_j r_ij) / (l_j - l_i), and r_ij / 2 where two eigenvalues are too close to be told apart.
    """
    _, x = np.linalg.eigh(v[0])
    d = x.shape[1]
    left = x.T.copy()
    g = _times((left, np.zeros_like(left)), x)
    r = (np.eye(d) - g[0]) - g[1]
    vx = _times(v, x)
    s = dd_total(*_products(left, vx))
    value = (s[0].diagonal() + s[1].diagonal()) / (1.0 - r.diagonal())
    total = s[0] + s[1]
    gap = value[None, :] - value[:, None]
    near = np.abs(gap) <= 4 * np.finfo(float).eps * d * max(float(np.abs(value).max(initial=0.0)), np.finfo(float).tiny)
    e = np.where(near, r / 2, (total + value[None, :] * r) / np.where(near, 1.0, gap))
    x = x + x @ e
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order] / np.linalg.norm(x[:, order], axis=0)


def _products(a: np.ndarray, b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a @ b, by the inner index."""
    p, e = two_product(a.T[:, :, None], b[0][:, None, :])
    return p, e + a.T[:, :, None] * b[1][:, None, :]


def usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    return F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))), F.lit(False))


def whole(entry: Column, scale: float) -> Column:
    """floor(scale * entry) as a long; what is beyond 2^52 stops there, to be refused."""
    return F.floor(F.greatest(F.least(entry * F.lit(scale), F.lit(2.0**52)), F.lit(-(2.0**52)))).cast("long")


def _project(n: int, sums: list[int], mean: np.ndarray, axes: np.ndarray):
    """Deviation and whitened components of each row; n x - S is exact in whole numbers."""
    d, k = axes.shape
    s = np.array([v & (2**64 - 1) for v in sums], np.uint64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("_x"), d)
            rough = np.abs(x - mean).max(axis=1) * n
            far = x.astype(np.uint64) * np.uint64(n) - s  # modulo 2^64: right wherever |n x - S| < 2^63
            u = far.view(np.int64)
            size = (u.astype(float) ** 2).sum(axis=1)
            ok = (rough < 2.0**62) & (size < 2.0**62)
            square = (far * far).sum(axis=1, dtype=np.uint64).view(np.int64)
            centred = np.where((rough < 2.0**62)[:, None], u / float(n), x - mean)
            yield pa.record_batch([batch.column("_id"), pa.array(square, mask=~ok), _arrays(centred @ axes)], ["_id", "deviation", "_w"])

    return each


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: x = floor(scale * c) + offset, whitened = axes' (x - mean)."""

    n: int
    sums: list[int]
    scale: float
    offset: int
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float
    axes: np.ndarray  # eigenvectors over the roots of their eigenvalues, for the components kept


def _scaled(df: DataFrame, vector_col: str, id_col: str, scale: float, offset: int, dimension: int | None) -> tuple[DataFrame, int | None]:
    rows = df.where(usable(F.col(vector_col))).select(F.col(id_col).alias("_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda c: whole(c, scale) + F.lit(offset)).alias("_x"))
    if dimension is None:
        sizes = rows.groupBy(F.size("_x").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
        dimension = sizes["d"] if sizes else None
    return rows.where(F.size("_x") == F.lit(dimension)), dimension


def fit(rows: DataFrame, d: int, scale: float, offset: int, components: int) -> Whitening | None:
    """rows: a column _x of whole numbers, d of them."""
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)], F.max(F.array_max(F.transform("_x", F.abs))).alias("m")).first()
    n = first["n"]
    if not n:
        return None
    if first["m"] >= LARGEST:
        raise ValueError(f"a scaled entry is {first['m']}; entries must stay below 2^50")
    sums = [int(first[f"s{i}"]) for i in range(d)]
    v = covariance(rows, "_x", n, exact_mean(sums, n))
    values, vectors = eigen(v)
    trace = float(v[0].diagonal().sum())
    floor = max(float(values[0]), 0.0) * d * np.finfo(float).eps
    k = min(components, d)
    axes = np.stack([vectors[:, i] / np.sqrt(values[i]) if values[i] > floor else np.zeros(d) for i in range(k)], axis=1)
    return Whitening(n, sums, scale, offset, values, vectors, trace, axes)


def whiten(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", scale: float = 1024.0, offset: int = 100_000, components: int = 8, dimension: int | None = None) -> tuple[DataFrame, Whitening | None, float | None]:
    """(rows of _id, deviation and the array _w of whitened components; the fit; largest entry of their covariance minus the identity)."""
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    schema = f"_id {id_type}, deviation long, _w array<double>"
    rows, d = _scaled(df, vector_col, id_col, scale, offset, dimension)
    found = fit(rows, d, scale, offset, components) if d else None
    if found is None:
        return df.sparkSession.createDataFrame([], schema), None, None
    mean = np.array(exact_mean(found.sums, found.n)).sum(axis=0)
    out = scratch(rows.mapInArrow(_project(found.n, found.sums, mean, found.axes), schema), "whitened")
    k = found.axes.shape[1]
    centre = out.agg(*[F.avg(F.col("_w")[i]).alias(f"m{i}") for i in range(k)]).first()
    own = covariance(out, "_w", found.n, (np.array([centre[i] for i in range(k)], float), np.zeros(k)))
    return out, found, float(np.abs(own[0] - np.eye(k)).max())


def op11(embeddings: DataFrame) -> DataFrame:
    out, found, error = whiten(embeddings)
    columns = "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    if found is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*[F.lit(float(v / found.trace) if found.trace > 0 else 0.0) for v in found.values[: found.axes.shape[1]]])
    rows = out.select(F.col("_id").alias("vec_id"), F.lit(found.n).cast("long").alias("n"), "deviation", F.posexplode("_w").alias("_k", "whitened"))
    return rows.select("vec_id", (F.col("_k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(share, F.col("_k")).alias("explained"), F.lit(error).alias("identity_error")).select(*columns)
