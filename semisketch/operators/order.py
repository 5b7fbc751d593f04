"""Positions in a global order, without a task that sees all rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows that one part of the order has, more or less.
PART_ROWS = 1_000_000
# a generated identifier counts the rows of its part in the lower bits
_BITS = 33


def numbered(
    rows: DataFrame, order: list, name: str = "pos", weight: str | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``rows`` and their position from 0, or with ``weight`` the sum of that column over
    all rows before.

    Rows are sorted by ranges; a row of sums per range reaches the driver. Rows that
    are equal in ``order`` may come in any order.
    """
    parts = max(1, -(-rows.count() // part_rows))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(sorted_rows.withColumn("_place", F.monotonically_increasing_id()))
    if parts == 1 and weight is None:
        return placed.withColumnRenamed("_place", name)
    part = F.shiftright("_place", _BITS)
    size = F.count("*") if weight is None else F.sum(weight)
    starts, ahead = [], 0
    for row in placed.groupBy(part.alias("_part")).agg(size.alias("size")).orderBy("_part").collect():
        starts.append((row._part, ahead))
        ahead += row["size"]
    # as Arrow, which the JVM reads by itself; a list of rows starts workers that stay
    starts = rows.sparkSession.createDataFrame(pa.table(
        {"_part": pa.array([p for p, _ in starts], pa.int64()), "_start": pa.array([s for _, s in starts], pa.int64())}
    ))
    if weight is None:
        within = F.col("_place").bitwiseAND((1 << _BITS) - 1)
    else:
        before = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        within = F.coalesce(F.sum(weight).over(before), F.lit(0))
    placed = placed.withColumn("_part", part).withColumn("_within", within)
    # one row per range
    placed = placed.join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_within")).drop("_place", "_part", "_within", "_start")
