"""Documents derived from the given tables, one per row and in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import parse_documents, valid_docs


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows that one task walks at most, in the mean.
TASK_ROWS = 50_000


def spread(rows: DataFrame) -> DataFrame:
    """Spread rows over the cores where the files give fewer splits than there are, and
    over more tasks where there are more rows than so many tasks should walk."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def order_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text)``: an order as JSON with every kind of structure."""
    text = F.concat(
        F.lit('{"customer":'), F.col("o_custkey").cast("string"),
        F.lit(',"status":"'), F.col("o_orderstatus"),
        F.lit('","price":{"total":'), F.col("o_totalprice").cast("string"),
        F.lit(',"code":'), (F.col("o_custkey") % 3).cast("string"),
        F.lit('},"dates":["'), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit('",{"year":'), F.year("o_orderdate").cast("string"),
        F.lit(',"month":'), F.month("o_orderdate").cast("string"),
        F.lit(',"day":'), F.dayofmonth("o_orderdate").cast("string"),
        F.lit('}],"priority":[["'), F.col("o_orderpriority"),
        F.lit('"]],"parts":["'), F.substring_index("o_orderpriority", "-", 1),
        F.lit('","'), F.substring_index("o_orderpriority", "-", -1),
        F.lit('"],"empty":{},"nothing":null,"zero":0}'),
    )
    orders = table(spark, folder, "orders")
    return orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), text.alias("text"))


def order_docs(spark: SparkSession, folder: str) -> DataFrame:
    return valid_docs(parse_documents(spread(order_texts(spark, folder))))


def lineitem_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as documents with nested objects and arrays."""
    lines = table(spark, folder, "lineitem")
    body = F.struct(
        F.struct("l_partkey", "l_suppkey").alias("part"),
        F.struct("l_quantity", "l_extendedprice", F.array("l_discount", "l_tax").alias("rates"))
        .alias("price"),
        F.array("l_returnflag", "l_linestatus").alias("flags"),
        F.array(F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))).alias("ship"),
    )
    key = F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"))
    rows = lines.select(key.alias("doc_id"), F.to_json(body).alias("text"))
    return valid_docs(parse_documents(spread(rows)))


def supplier_records(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, name, nation STRUCT, cents, tags)`` of the suppliers."""
    return table(spark, folder, "supplier").select(
        F.concat(F.lit("s "), F.col("s_suppkey")).alias("id"),
        F.col("s_name").alias("name"),
        F.struct(F.col("s_nationkey").alias("key")).alias("nation"),
        F.round(F.col("s_acctbal") * 100).cast("long").alias("cents"),
        F.split("s_name", "#").alias("tags"),
    )


def supplier_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = supplier_records(spark, folder)
    return rows.select("id", F.to_json(F.struct(*rows.columns)).alias("text"))


def turn_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns: running text as values."""
    turns = table(spark, folder, "conversations")
    key = F.concat_ws("-", F.col("conv_id"), F.col("turn"))
    body = F.to_json(F.struct("role", F.array("text").alias("said"), "turn"))
    rows = turns.select(key.alias("doc_id"), body.alias("text"))
    return valid_docs(parse_documents(spread(rows)))


def event_docs(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON column of the event table."""
    events = table(spark, folder, "events")
    rows = events.select(F.col("event_id").cast("string").alias("doc_id"), F.col("props").alias("text"))
    return valid_docs(parse_documents(spread(rows)))


def embedding_fps(spark: SparkSession, folder: str) -> DataFrame:
    """The embedding table as fingerprints of length 64."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("doc_id"),
        F.size("embedding").alias("L"),
        F.col("label").cast("long").alias("statements"),
        F.transform("embedding", lambda x: x.cast("double")).alias("fp"),
    )
