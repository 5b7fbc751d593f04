"""Vector columns (ARRAY<DOUBLE>) as built-in array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import let


def array_total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def stretch_unit(v: Column) -> Column:
    """Subtract the minimum, then divide by the sum unless that is 0."""
    low = F.array_min(v)
    shifted = F.transform(v, lambda x: x - low)
    return let(
        F.struct(shifted.alias("v"), array_total(shifted).alias("total")),
        lambda s: F.when(
            s["total"] != 0, F.transform(s["v"], lambda x: x / s["total"])
        ).otherwise(s["v"]),
    )


def zscore(v: Column, dialect: str = "v2") -> Column:
    """Centre and scale the cells of one vector.

    v1 divides by the population deviation (NULL cells if that is 0), v2 by the
    sample deviation, or by 1 if that is 0.
    """
    n = F.size(v)
    free = n if dialect == "v1" else n - 1

    def scaled(s):
        return F.transform(s["d"], lambda x: F.try_divide(x, s["std"]))

    def spread(d):
        std = F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x) / free)
        if dialect == "v2":
            std = F.when(std == 0, F.lit(1.0)).otherwise(std)
        return F.struct(d.alias("d"), std.alias("std"))

    centred = let(array_total(v) / n, lambda avg: F.transform(v, lambda x: x - avg))
    return let(let(centred, spread), scaled)


def round_cells(v: Column, decimals: int = 3) -> Column:
    return F.transform(v, lambda x: F.round(x, decimals))


def ordinal_ranks(v: Column) -> Column:
    """Rank 0..L-1 of each cell; equal cells rank by position."""
    order = F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    back = F.array_sort(F.transform(order, lambda s, r: F.struct(s["i"].alias("i"), r.alias("r"))))
    return F.transform(back, lambda s: s["r"])


def rank_corr(a: Column, b: Column) -> Column:
    """Correlation of two ordinal rank vectors of the same length."""
    n = F.size(a).cast("double")
    gap = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0), lambda acc, d: acc + d
    )
    return F.lit(1.0) - F.lit(6.0) * gap / (n * (n * n - 1))


def cells(df: DataFrame, vector: str = "fp", *keys: str, decimals: int = 6) -> DataFrame:
    """One row per cell: keys, ``i`` and the rounded ``v``.

    A small shift keeps values off rounding ties, where the last bit would decide.
    """
    df = df.select(*keys, F.posexplode(vector).alias("i", "v"))
    return df.withColumn("v", F.round(F.col("v") + 1e-9, decimals) + F.lit(0.0))
