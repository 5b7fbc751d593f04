"""Short names for a set of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def simplify_names(names: DataFrame, column: str = "name") -> DataFrame:
    """Adds ``simple``: the name without the path parts that all names share.

    Names are cut at ``/`` and ``.``; parts shared by all, at the front and at the
    end of the longest name, are dropped and the rest is joined by dots.  Where
    nothing differs ``simple`` is NULL.
    """
    # trailing separators make no parts
    parts = F.split(F.regexp_replace(column, "[/.]+$", ""), "[/.]")
    # per position only: does the part vary? (one small row per position)
    places = names.select(F.posexplode(parts).alias("place", "part")).groupBy("place").agg(
        (F.min("part") != F.max("part")).alias("varies")
    )
    span = places.where("varies").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    first, last = span.first()
    if first is None:
        return names.withColumn("simple", F.lit(None).cast("string"))
    kept = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(first, last + 1)]
    return names.withColumn("simple", F.concat_ws(".", *kept))
