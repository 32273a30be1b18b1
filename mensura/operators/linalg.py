"""Matrices as rows (row, col, val): products and norms are joins and sums; factorisations, of matrices that fit a machine, NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of vectors (i, x)."""
    return a.select("i", F.col("x").alias("xa")).join(b.select("i", F.col("x").alias("xb")), "i").agg(F.coalesce(F.sum(F.col("xa") * F.col("xb")), F.lit(0.0)).alias("dot"))


def mat_mul(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("row", F.col("col").alias("k"), F.col("val").alias("va"))
    return left.join(b.select(F.col("row").alias("k"), "col", F.col("val").alias("vb")), "k").groupBy("row", "col").agg(F.sum(F.col("va") * F.col("vb")).alias("val"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def identity(spark: SparkSession, n: int) -> DataFrame:
    i = spark.range(n).select(F.col("id").cast("int").alias("row"))
    return i.crossJoin(F.broadcast(i.withColumnRenamed("row", "col"))).withColumn("val", (F.col("row") == F.col("col")).cast("double"))


def matrix_trace(m: DataFrame) -> DataFrame:
    return m.where("row = col").agg(F.coalesce(F.sum("val"), F.lit(0.0)).alias("trace"))


def frobenius_norm(m: DataFrame) -> DataFrame:
    return m.agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))


def vector_norm(v: DataFrame, p: float = 2.0) -> DataFrame:
    if p <= 0:
        raise ValueError("p must be positive")
    return v.agg(F.pow(F.sum(F.pow(F.abs("x"), F.lit(p))), F.lit(1 / p)).alias("norm"))


def dense(m: DataFrame, most: int = 4_000_000) -> np.ndarray:
    """A matrix on the driver, if it has at most so many cells; ragged ones are refused."""
    shape = m.agg(F.max("row"), F.max("col"), F.count(F.lit(1))).first()
    n, k = (shape[0] or 0) + 1, (shape[1] or 0) + 1
    if shape[2] > most:
        raise ValueError("too large to factorise on one machine")
    if shape[2] != n * k:
        raise ValueError("the matrix is ragged")
    out = np.zeros((n, k))
    cells = m.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("val").cast("double")).toArrow()
    row, col, val = (c.to_numpy() for c in cells.columns)
    out[row, col] = val
    return out


def frame(spark: SparkSession, a: np.ndarray) -> DataFrame:
    row, col = (x.ravel().astype(np.int32) for x in np.indices(a.shape))
    return spark.createDataFrame(pa.table({"row": row, "col": col, "val": np.ascontiguousarray(a, float).ravel()}))


def _square(m: DataFrame) -> np.ndarray:
    a = dense(m)
    if a.shape[0] != a.shape[1]:
        raise ValueError("the matrix is not square")
    return a


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P, L, U with P A = L U, by partial pivoting."""
    u, n = a.astype(float).copy(), len(a)
    p, low = np.eye(n), np.zeros((n, n))
    for k in range(n):
        pivot = k + int(np.argmax(np.abs(u[k:, k])))
        for x in (u, p, low):
            x[[k, pivot]] = x[[pivot, k]]
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return p, low + np.eye(n), np.triu(u)


def lu_decomposition(m: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(frame(m.sparkSession, x) for x in lu(_square(m)))


def determinant(m: DataFrame) -> float:
    return float(np.linalg.det(_square(m)))


def solve_linear(m: DataFrame, b: DataFrame) -> DataFrame:
    """(i, x) with A x = b, b as (i, x); a singular A is an error."""
    a = _square(m)
    rhs = np.array([r["x"] for r in b.orderBy("i").collect()], float)
    try:
        x = np.linalg.solve(a, rhs)
    except np.linalg.LinAlgError as e:
        raise ValueError("the matrix is singular") from e
    return m.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")


def matrix_inverse(m: DataFrame) -> DataFrame:
    try:
        return frame(m.sparkSession, np.linalg.inv(_square(m)))
    except np.linalg.LinAlgError as e:
        raise ValueError("the matrix is singular") from e


def power_iteration(m: DataFrame, max_iter: int = 1000, tol: float = 1e-10) -> tuple[float, list[float]]:
    """The dominant eigenpair; an error where none strictly dominates."""
    a = _square(m)
    v = 1.0 / np.arange(1, len(a) + 1)
    v /= np.linalg.norm(v)
    for _ in range(max_iter):
        w = a @ v
        value = float(v @ w)
        if np.linalg.norm(w - value * v) <= tol * max(1.0, abs(value)):
            return value, v.tolist()
        if not (size := np.linalg.norm(w)):
            return 0.0, v.tolist()
        v = w / size
    raise ValueError("no strictly dominant eigenvalue")


def gram_schmidt(m: DataFrame) -> DataFrame:
    """Rows made orthonormal in their order; dependent rows are an error."""
    out: list[np.ndarray] = []
    for v in dense(m):
        for q in out:
            v = v - (q @ v) * q
        if (size := np.linalg.norm(v)) < 1e-12:
            raise ValueError("the rows are dependent")
        out.append(v / size)
    return frame(m.sparkSession, np.array(out))


def qr_decomposition(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(frame(m.sparkSession, x) for x in np.linalg.qr(dense(m), mode="complete"))


def cholesky(m: DataFrame) -> DataFrame:
    a = _square(m)
    if not np.allclose(a, a.T):
        raise ValueError("the matrix is not symmetric")
    try:
        return frame(m.sparkSession, np.linalg.cholesky(a))
    except np.linalg.LinAlgError as e:
        raise ValueError("the matrix is not positive definite") from e


@dataclass
class SVDResult:
    U: DataFrame
    singular_values: list[float]
    Vt: DataFrame


def svd(m: DataFrame) -> SVDResult:
    u, s, vt = np.linalg.svd(dense(m), full_matrices=True)
    return SVDResult(frame(m.sparkSession, u), s.tolist(), frame(m.sparkSession, vt))


def rank(m: DataFrame, tol: float = 1e-10) -> int:
    return int((np.linalg.svd(dense(m), compute_uv=False) > tol).sum())


def condition_number(m: DataFrame, tol: float = 1e-12) -> float:
    s = np.linalg.svd(dense(m), compute_uv=False)
    return float("inf") if s[-1] <= tol else float(s[0] / s[-1])


# ---- attention ---------------------------------------------------------------------------


def softmax_rows(m: DataFrame) -> DataFrame:
    """Softmax along each row, shifted by its largest value."""
    top = m.groupBy("row").agg(F.max("val").alias("_top"))
    e = m.join(top, "row").withColumn("_e", F.exp(F.col("val") - F.col("_top")))
    return e.join(e.groupBy("row").agg(F.sum("_e").alias("_s")), "row").select("row", "col", (F.col("_e") / F.col("_s")).alias("val"))


def scaled_dot_product_attention(q: DataFrame, k: DataFrame, v: DataFrame, width: int, causal: bool = False) -> DataFrame:
    """softmax(Q K' / root of width) V as joins; causal leaves out later keys."""
    s = mat_mul(q, transpose(k)).withColumn("val", F.col("val") / float(np.sqrt(width)))
    return mat_mul(softmax_rows(s.where("col <= row") if causal else s), v)


def layer_norm(m: DataFrame, eps: float = 1e-5, gamma: float = 1.0, beta: float = 0.0) -> DataFrame:
    s = m.groupBy("row").agg(F.avg("val").alias("_m"), F.var_pop("val").alias("_v"))
    return m.join(s, "row").select("row", "col", ((F.col("val") - F.col("_m")) / F.sqrt(F.col("_v") + eps) * gamma + beta).alias("val"))


def place_code(row: Column, col: Column, width: int) -> Column:
    """What a place adds to a sequence's element: sines in even dimensions, cosines in odd ones."""
    # the divisors come from the driver: Spark's pow is off by a bit in some, which far along a sequence shows in the eighth digit
    angle = row / F.get(F.array(*[F.lit(10000.0 ** ((c - c % 2) / width)) for c in range(width)]), col)
    return F.when(col % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def positional_encoding(spark: SparkSession, length: int, width: int) -> DataFrame:
    """(row, col, val) of all places.  A sequence that is already a table takes place_code: Spark guesses far too few rows here and would broadcast them to a join."""
    cells = spark.range(length).select(F.col("id").cast("int").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return cells.withColumn("val", place_code(F.col("row"), F.col("col"), width))
