"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rotations are fitted on at most so many vectors; they order dimensions and never decide a result.
SAMPLE = 4096


def usable(vector: Column) -> Column:
    """True where the vector is not null and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def rotations(vectors: DataFrame, column: str) -> dict[int, np.ndarray]:
    """By dimension, an orthonormal basis in order of falling second moment, from a bounded sample."""
    rows = vectors.select(column).orderBy(F.xxhash64(column)).limit(SAMPLE).collect()
    by_size: dict[int, list] = {}
    for r in rows:
        if r[0]:
            by_size.setdefault(len(r[0]), []).append(r[0])
    out = {}
    for d, some in by_size.items():
        x = np.array(some, dtype=np.float64)
        out[d] = np.linalg.svd(x / max(1e-300, np.abs(x).max()), full_matrices=True)[2].T
    return out


def rotated(x: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    """x in the basis of its dimension; a dimension that the sample missed stays as it is."""
    v = basis.get(x.shape[1])
    return x if v is None else x @ v


def suffix_norms(x: np.ndarray, at: int) -> np.ndarray:
    """Lengths of the rows without their first `at` components."""
    return np.sqrt((x[:, at:] ** 2).sum(axis=1))
