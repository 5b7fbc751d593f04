"""Principal components of a fingerprint table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``i, j, s``: sums of products of cells i and j, of cells (j = -1) and rows
    (both -1) in one partition, taken about its first row."""
    total = None
    for batch in batches:
        cells = batch.column("fp").flatten().to_numpy(zero_copy_only=False)
        if not batch.num_rows:
            continue
        rows = cells.reshape(batch.num_rows, -1)
        # a column of ones gives sums and count along with the products
        rows = np.column_stack([rows, np.ones(len(rows))])
        total = rows.T @ rows if total is None else total + rows.T @ rows
    if total is not None:
        n = len(total)
        place = np.r_[np.arange(n - 1), -1].astype(np.int32)
        columns = [pa.array(np.repeat(place, n)), pa.array(np.tile(place, n)), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "s"])


def moments(fps: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, sums and sums of products of the cells of ``fp``.

    Partitions send a matrix each, which are added in one aggregate by cell; L squared
    rows reach the driver, however many fingerprints there are.
    """
    parts = fps.select(F.transform("fp", lambda x: x.cast("double")).alias("fp"))
    parts = parts.mapInArrow(_partial_moments, "i int, j int, s double")
    held = parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    if not held:
        return 0.0, np.zeros(0), np.zeros((0, 0))
    size = max(r.i for r in held) + 2
    table = np.zeros((size, size))
    for r in held:
        table[r.i, r.j] = r.s
    return table[-1, -1], table[:-1, -1], table[:-1, :-1]


def pca_fp(fps: DataFrame, components: int = 2) -> DataFrame:
    """``(doc_id, statements, pc, size)``: centred and scaled principal components.

    ``size`` is the marker size used for plots.  Cells without variance count as 0.  The
    sign of a component is arbitrary, so it is fixed by making its largest loading
    positive.
    """
    kept = [c for c in ("doc_id", "statements") if c in fps.columns]
    n, sums, products = moments(fps)
    out = fps.select(*kept, F.lit(None).cast("array<double>").alias("pc"))
    if n > 1:
        mean = sums / n
        covariance = (products - n * np.outer(mean, mean)) / (n - 1)
        deviation = np.sqrt(np.maximum(np.diag(covariance), 0.0))
        # rounding leaves a trace of variance on constant cells
        deviation[deviation <= 1e-7 * np.maximum(1.0, np.abs(mean))] = 0.0
        scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
        _, vectors = np.linalg.eigh(covariance * np.outer(scale, scale))
        loadings = vectors[:, ::-1][:, :components].T
        loadings = loadings * np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(1)])[:, None]
        array = lambda values: F.array(*map(F.lit, values.tolist()))
        scaled = F.zip_with(F.zip_with("fp", array(mean), lambda x, m: x - m), array(scale), lambda x, s: x * s)
        score = lambda row: F.aggregate(F.zip_with("z", array(row), lambda z, w: z * w), F.lit(0.0), lambda a, x: a + x)
        rows = fps.select(*kept, scaled.alias("z"))
        out = rows.select(*kept, F.array(*[score(row) for row in loadings]).alias("pc"))
    if "statements" in kept:
        out = out.withColumn("size", F.sqrt("statements") / 50)
    return out
