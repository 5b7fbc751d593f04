"""Files that hold one large JSON array or object of entities.

Such a file is read in many tasks and never as one value.  The text reader cuts it
after every ``}``; how deep in brackets and whether inside a string a piece begins
follows from running sums, first within each block of the file and then over the
few rows that sum up its blocks.  Pieces between two closings at the top level are
put together again and parsed.

A file whose brackets or quotes do not close is left out as a whole; an entity that
is no JSON is left out alone.  Both are told by ``rejects``.  A file that lacks only
its very last ``}`` cannot be told from a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_folder
from .documents import parse_documents

BLOCK = ("file", "block")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _net_depth(outside: Column, closed: Column) -> Column:
    """Brackets opened less brackets closed by a piece, the cut-off ``}`` included."""
    return _count(outside, "{[") - _count(outside, "}]") - closed.cast("int")


def _pieces(spark: SparkSession, path) -> DataFrame:
    """``(file, block, id, value, odd, plain, quoted)``: a row per ``}``.

    ``odd`` quotes turn the string state; ``plain`` and ``quoted`` are the changes of
    depth should the piece begin outside or inside a string.
    """
    text = spark.read.option("lineSep", "}").text(path)
    rows = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
        F.regexp_replace("value", r"(?s)\\.", "").alias("bare"),
    )
    odd = _count(F.col("bare"), '"') % 2
    strings = r'"[^"]*"?'
    plain = F.regexp_replace("bare", strings, "")
    quoted = F.regexp_replace(F.regexp_replace("bare", r'^[^"]*"?', ""), strings, "")
    return rows.select(
        *BLOCK, "id", "value", odd.alias("odd"),
        _net_depth(plain, odd == 0).alias("plain"), _net_depth(quoted, odd == 1).alias("quoted"),
    )


def _placed(spark: SparkSession, path) -> DataFrame:
    """Pieces with running sums within their blocks, as a written table."""
    order = Window.partitionBy(*BLOCK).orderBy("id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    rows = _pieces(spark, path).withColumn("turned", turned)
    # depth after the piece, should its block begin outside (0) or inside (1) a string
    outside, inside = (F.when(F.col("turned") == s, F.col("plain")).otherwise(F.col("quoted")) for s in (0, 1))
    rows = rows.select(
        *BLOCK, "id", "value", ((F.col("turned") + F.col("odd")) % 2).alias("odd"),
        F.sum(outside).over(order).alias("depth_0"), F.sum(inside).over(order).alias("depth_1"),
    )
    table = scratch_folder(spark)
    rows.write.parquet(table)
    return spark.read.parquet(table)


def _before(column: Column) -> Column:
    """Sum over the earlier blocks of the file: one row per block."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def _numbered(placed: DataFrame) -> DataFrame:
    """``(file, no, block, id, value, ended)`` of files whose brackets close."""
    last = F.max_by(F.struct("odd", "depth_0", "depth_1"), "id").alias("last")
    blocks = placed.groupBy(*BLOCK).agg(last).select(*BLOCK, "last.*")
    blocks = blocks.withColumn("inside", _before(F.col("odd")) % 2)
    gain = F.when(F.col("inside") == 0, F.col("depth_0")).otherwise(F.col("depth_1"))
    blocks = blocks.withColumn("depth", _before(gain)).withColumn("gain", gain)
    whole = Window.partitionBy("file")
    final = F.sum("gain").over(whole)
    # a last piece that no } ended was counted as if one had
    closes = final.between(-1, 0)
    starts = blocks.select(*BLOCK, "inside", "depth", closes.alias("closes"))
    rows = placed.join(starts, [*BLOCK])
    depth = F.col("depth") + F.when(F.col("inside") == 0, F.col("depth_0")).otherwise(F.col("depth_1"))
    ended = (depth == 1) & ((F.col("inside") + F.col("odd")) % 2 == 0)
    rows = rows.select(*BLOCK, "id", "value", "closes", ended.cast("long").alias("ended"))
    counts = rows.groupBy(*BLOCK).agg(F.sum("ended").alias("n"))
    counts = counts.select(*BLOCK, _before(F.col("n")).alias("first"))
    in_block = Window.partitionBy(*BLOCK).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    number = F.col("first") + F.coalesce(F.sum("ended").over(in_block), F.lit(0))
    return rows.join(counts, [*BLOCK]).withColumn("no", number)


def entity_texts(spark: SparkSession, path, root: str) -> DataFrame:
    """``(file, no, text, closes)``: JSON arrays (root ``[``) or objects (root ``{``)
    that hold one entity each, behind a first filler item.

    Items that are no objects come along with the object after them.
    """
    parts = F.array_sort(F.collect_list(F.struct("block", "id", "value")))
    groups = _numbered(_placed(spark, path)).groupBy("file", "no").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "}").alias("text"),
        F.max("ended").alias("ended"),
        F.first("closes").alias("closes"),
    )
    end = r"\]\s*$" if root == "[" else r"\}?\s*$"
    is_last, is_first = F.col("ended") == 0, F.col("no") == 0
    opened = F.col("text").rlike(rf"^\s*\{root}")
    proper = F.when(is_last & F.lit(root == "["), F.col("text").rlike(end)).otherwise(True)
    proper &= F.when(is_first, opened).otherwise(True)
    body = F.when(is_last, F.regexp_replace("text", end, "")).otherwise(F.concat("text", F.lit("}")))
    inner = F.regexp_replace(body, rf"^\s*\{root}\s*", "")
    body = F.when(is_first, F.when(inner.rlike(r"^\s*$"), "").otherwise(F.concat(F.lit(","), inner))).otherwise(body)
    filler, close = ("[0", "]") if root == "[" else ('{"":0', "}")
    text = F.when(proper & F.col("closes"), F.concat(F.lit(filler), body, F.lit(close)))
    return groups.select("file", "no", F.coalesce(text, F.lit("[")).alias("text"))


def parsed_entities(spark: SparkSession, path, root: str) -> DataFrame:
    """``(file, no, body, reason)`` as ``parse_documents`` gives them."""
    return parse_documents(entity_texts(spark, path, root))
