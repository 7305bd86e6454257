"""Dense linear algebra on packed matrices, for ``raster.map_images`` (stacks of (n, rows, cols)), and products of
matrices held as relations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the product of two matrices (i, j, v) of any size: one join on the inner index, one sum."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("_a")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("_b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def gram(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(i, j, v): sums over rows of products of the coordinates of ``vec``; the rows never meet."""
    long = df.select(F.posexplode(vec).alias("i", "x"), F.col(vec).alias("_v"))
    return long.select("i", "x", F.posexplode("_v").alias("j", "y")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def inverse(a: np.ndarray) -> np.ndarray:
    """NaN where a matrix is singular."""
    out = np.full(a.shape, np.nan)
    ok = np.abs(np.linalg.det(a)) > 1e-12
    out[ok] = np.linalg.inv(a[ok])
    return out


def pseudo_inverse(a: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(a)


def determinant(a: np.ndarray) -> np.ndarray:
    return np.linalg.det(a)[:, None, None]


def trace(a: np.ndarray) -> np.ndarray:
    return np.trace(a, axis1=1, axis2=2)[:, None, None]


def solve(ab: np.ndarray) -> np.ndarray:
    """The last column is the right-hand side; least squares where there are more rows than unknowns."""
    return np.stack([np.linalg.lstsq(m[:, :-1], m[:, -1:], rcond=None)[0] for m in np.asarray(ab, float)])


def eigen_symmetric(a: np.ndarray) -> np.ndarray:
    """First row eigenvalues, falling; below them the eigenvectors as rows, their largest entry positive."""
    w, v = np.linalg.eigh((a + a.transpose(0, 2, 1)) / 2)
    w, v = w[:, ::-1], v[:, :, ::-1].transpose(0, 2, 1)
    big = np.take_along_axis(v, np.abs(v).argmax(axis=2)[..., None], axis=2)
    return np.concatenate([w[:, None], v * np.sign(big)], axis=1)


def singular_values(a: np.ndarray) -> np.ndarray:
    return np.linalg.svd(np.asarray(a, float), compute_uv=False)[:, None]


def cholesky(a: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(a)
