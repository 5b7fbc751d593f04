"""Structured Streaming jobs.

A document is closed within its row, so fingerprint streams need no state: the batch
operators run on every micro-batch.  An index stream keeps the ids it has seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fingerprint import fingerprint
from ..operators.index import append_index
from ..sources.documents import json_lines
from ..sources.tables import slice_columns


def stream_json_lines(spark: SparkSession, folder: str, id_field: str, **settings) -> DataFrame:
    """Fingerprints of JSON lines as files arrive in ``folder``, as a stream."""
    return fingerprint(json_lines(spark.readStream.text(folder), id_field), **settings)


def write_stream(fps: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a fingerprint stream to a Parquet table, exactly once per file."""
    writer = fps.writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: Where the state of a stream is kept, unless the session names a provider: on disk.
STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_index(
    spark: SparkSession,
    folder: str,
    index: str,
    length: int,
    checkpoint: str,
    ignore_columns: int = 1,
    once: bool = True,
) -> StreamingQuery:
    """Keep a rank index up to date with fingerprint files arriving in ``folder``.

    Only new ids are added, the first row of each.  The ids that the stream has seen are
    its keyed state, so a micro-batch does not search the batches that the stream wrote
    before, after a restart neither; only batches of other writers are asked.  A
    micro-batch that is run again after a failure is told by its number and adds nothing
    twice.
    """
    lines = spark.readStream.text(folder).where(~F.col("value").startswith("#"))
    parts = lines.select(F.split("value", "\t").alias("parts"))
    fps = slice_columns(parts, length, ignore_columns).dropDuplicates(["doc_id"])

    def add(batch: DataFrame, turn: int) -> None:
        append_index(batch, index, length, writer=checkpoint, turn=turn)

    writer = fps.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    if spark.conf.get(STATE, None) is not None:
        return writer.start()
    # a query keeps the settings that it was started with
    spark.conf.set(STATE, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.unset(STATE)
