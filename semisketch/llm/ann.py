"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector's code is the signs of its rotated components. The inner product of a query
with the code, divided by that of the vector itself with its code, estimates the inner
product without bias, and the spread of the error is known from the same scalar. Only
vectors whose estimate plus bound reaches a query's k-th best so far are ranked anew on
the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import dimension, dots, matrix, rotation, usable_rows

#: Rotations whose codes are kept; the error shrinks with the square root.
ROTATIONS = 4
#: Width of the error bound in standard deviations.
SIGMAS = 4.0
#: Rows and queries that meet in one task.
BLOCK = 8192
STRIP = 2048
#: Queries estimated at a time.
QUERIES = 128


def encode(vectors: np.ndarray, turns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, and for each rotation the correction and the spread of the error.

    With o a vector's direction and c its code scaled to length 1, the estimate of
    <o, q> is <c, q> / <c, o>; its error has the standard deviation
    |q| sqrt((1 - <c, o>^2) / <c, o>^2 / (dim - 1)).
    """
    norm = np.sqrt(dots(vectors, vectors))
    dim = vectors.shape[1]
    codes, correct, spread = [], [], []
    for turn in turns:
        turned = vectors / norm[:, None] @ turn
        codes.append(np.packbits(turned > 0, axis=1))
        own = np.abs(turned).sum(1) / np.sqrt(dim)
        correct.append(norm / own)
        spread.append(norm * np.sqrt(np.maximum(1 - own**2, 0) / own**2 / max(dim - 1, 1)))
    return np.stack(codes), np.stack(correct), np.sqrt((np.stack(spread) ** 2).sum(0)) / len(turns)


def nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, turns: list[np.ndarray]):
    """Each query's ``k`` nearest of a block: query ids, ids and scores."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    codes, correct, spread = encode(vectors, turns)
    dim = vectors.shape[1]
    signs = [np.unpackbits(c, axis=1, count=dim).astype(np.float32) * 2 - 1 for c in codes]
    out = [], [], []
    for at in range(0, len(queries), QUERIES):
        some = queries[at : at + QUERIES]
        estimate = np.zeros((len(some), len(vectors)), np.float32)
        for sign, by, turn in zip(signs, correct, turns, strict=True):
            estimate += (some @ turn / np.sqrt(dim)).astype(np.float32) @ sign.T * by.astype(np.float32)
        estimate /= len(turns)
        reach = np.sqrt(dots(some, some))[:, None] * (SIGMAS * spread + 1e-6)[None, :]
        for row, (query, own) in enumerate(zip(some, query_ids[at : at + QUERIES], strict=True)):
            near = estimate[row]
            near[ids == own] = -np.inf
            first = np.argpartition(-near, min(2 * k, len(near) - 1))[: 2 * k]
            first = first[near[first] > -np.inf]
            if not len(first):
                continue
            scores = dots(vectors[first], np.broadcast_to(query, (len(first), dim)))
            least = np.sort(scores)[-k] if len(first) >= k else -np.inf
            found = np.flatnonzero((near + reach[row] >= least) & (near > -np.inf))
            scores = dots(vectors[found], np.broadcast_to(query, (len(found), dim)))
            best = found[np.lexsort((ids[found], -scores))[:k]]
            out[0].append(np.full(len(best), own))
            out[1].append(ids[best])
            out[2].append(np.sort(-scores)[:k] * -1)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def search(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest rows.

    Both tables are ``(vec_id, embedding)``. Score is the inner product in double
    precision; ties go to the smaller id; rows of the query's own id do not count.
    Vectors that are null, zero or hold null or non-finite components, and null ids,
    take no part; fewer than ``k`` candidates are all returned, an empty table gives
    none. Of equal vectors the ``k + 1`` smallest ids can be among the nearest at most,
    so the others are left out before anything is compared, however many there are.
    Queries and rows meet in blocks of bounded size, and each block gives at most ``k``
    rows a query.
    """
    wanted, rows = usable_rows(queries), usable_rows(rows)
    turn = Window.partitionBy("embedding").orderBy("vec_id")
    rows = stored(rows.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= k + 1).drop("turn"))
    dim = max(dimension(rows), 1)
    spread = lambda parts: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(parts)).cast("int")
    blocks, strips = (max(1, -(-n // size)) for n, size in ((rows.count(), BLOCK), (wanted.count(), STRIP)))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    met = rows.select("vec_id", "embedding", F.lit(False).alias("asks"), spread(blocks).alias("block"), every(strips).alias("strip")).union(
        wanted.select("vec_id", "embedding", F.lit(True), every(blocks), spread(strips))
    )
    turns = [rotation(dim, seed) for seed in range(ROTATIONS)]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        found = [[], [], []]
        if asks.any() and not asks.all():
            ids, vectors = pdf["vec_id"].to_numpy(), matrix(pdf["embedding"])
            found = nearest(vectors[asks], ids[asks], vectors[~asks], ids[~asks], k, turns)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True))).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = met.groupBy("block", "strip").applyInPandas(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
