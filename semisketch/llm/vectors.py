"""What both operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with a null or non-finite component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def usable_rows(rows: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the vectors that take part; ids are not null. Single
    precision components stay so, which halves what moves and loses nothing."""
    kind = "array<float>" if "float" in rows.schema["embedding"].dataType.simpleString() else "array<double>"
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("embedding")), F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")
    )


def dimension(rows: DataFrame) -> int:
    """The one length of all vectors, 0 for an empty table; more than one is an error."""
    found = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if found[0] != found[1]:
        raise ValueError(f"vectors of {found[0]} and of {found[1]} components cannot be compared")
    return found[0] or 0


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix that depends on its arguments alone."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64, copy=False)


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed from the first component to the last, so that a
    pair has one value wherever and in whatever order it is computed."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total
