"""Rank index: an append-only Parquet table of rank vectors.

Layout: ``<path>/batch-*/part-*.parquet`` with ``id, meta, L, ranks``; ``_commits`` tells
which batches there are, in order, and ``_files`` what each file of a batch holds: its
rows, where they start, its least and largest id and a Bloom filter of all of them.  An
entry's position follows from where it is stored (batch, file, row in file), so
appending needs neither a sort nor a counter, and reading none either.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import ordinal_ranks, zscore
from ..session import materialize
from .commits import Commits
from .order import numbered

#: Files up to which the table of their first positions is sent to every task.
FEW_FILES = 100_000
#: Ids up to which every file is asked whether it may hold one of them.
FEW_IDS = 100_000
#: Bits and probes for each id of a file's Bloom filter.
BITS_PER_ID = 10
HASHES = 5
INDEX_SCHEMA = "id string, meta array<string>, L int, ranks array<int>"


def rank_fp(fps: DataFrame, normalize: bool = False) -> DataFrame:
    """``ranks`` (0..L-1, ties by position) of ``fp``.

    Scaling keeps the order of cells, so ``normalize`` changes nothing but the
    handling of values that scaling rounds together; it is there for parity.
    """
    fp = zscore(F.col("fp")) if normalize else F.col("fp")
    return fps.withColumn("ranks", ordinal_ranks(fp))


def index_entries(fps: DataFrame, normalize: bool = False) -> DataFrame:
    """``(id, meta, L, ranks)`` rows of a fingerprint table."""
    ranked = rank_fp(fps, normalize)
    meta = F.col("meta") if "meta" in fps.columns else F.array().cast("array<string>")
    if "meta" not in fps.columns and "statements" in fps.columns:
        meta = F.array(F.col("statements").cast("string"))
    return ranked.select(
        F.col("doc_id").alias("id"), meta.alias("meta"), F.size("ranks").alias("L"), "ranks"
    )


def new_only(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Entries whose id is not in the index yet.

    Of the index only ids that are among the entries reach the second join; where
    the entries are small, the first one broadcasts them and moves nothing else.
    """
    wanted = entries.select("id").distinct()
    held = index.select("id").join(wanted, "id", "left_semi").distinct()
    return entries.join(held, "id", "left_anti")


def check_length(entries: DataFrame, length: int) -> DataFrame:
    """End the job at the first entry of another length."""
    wrong = F.raise_error(
        F.concat(F.lit(f"the index takes vectors of length {length}, not "), F.col("L").cast("string"))
    )
    return entries.withColumn("L", F.when(F.col("L") == length, F.col("L")).otherwise(wrong.cast("int")))


# --- the stored index -----------------------------------------------------------


def _data(path: str, batch: dict) -> str:
    return f"{path}/{batch['folder']}"


def _notes(path: str, batch: dict) -> str:
    """The table of a batch's files, in a folder that readers of data pass over."""
    return f"{path}/_files/{batch['folder']}"


def _note_files(spark: SparkSession, path: str, batch: dict) -> int:
    """Write what the files of a new batch hold: ``file, rows, start, low, high, bits``.

    Ids are read from the new files only.  ``bits`` is a Bloom filter of a file's ids.
    Returns the rows of the batch.
    """
    ids = spark.read.schema(INDEX_SCHEMA).parquet(_data(path, batch)).select(
        F.col("_metadata.file_name").alias("file"), F.xxhash64("id").alias("hash"), "id"
    )
    sizes = materialize(ids.groupBy("file").agg(F.count("*").alias("rows"), F.min("id").alias("low"), F.max("id").alias("high")))
    files, rows, most = sizes.agg(F.count("*"), F.sum("rows"), F.max("rows")).first()
    sizes = numbered(sizes, ["file"], "start", "rows")
    few = F.broadcast(sizes.select("file", "rows")) if files <= FEW_FILES else sizes.select("file", "rows")
    bits = ids.select("file", "hash").join(few, "file").mapInArrow(_partial_bits, "file string, bits binary")
    bits = bits.groupBy("file").applyInArrow(_merged_bits, "file string, bits binary")
    sizes.join(bits, "file").select("file", "rows", "start", "low", "high", "bits").write.parquet(_notes(path, batch))
    return rows


def _bit_places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The HASHES bits of each id in a filter of ``size`` bits, a power of two."""
    low, high = hashes.astype(np.uint64) & np.uint64(0xFFFFFFFF), hashes.astype(np.uint64) >> np.uint64(32) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((low[:, None] + steps * high[:, None]) & np.uint64(size - 1)).astype(np.int64)


def _filter_bits(rows: int) -> int:
    return max(64, 1 << (rows * BITS_PER_ID - 1).bit_length())


def _partial_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        names, hashes = np.array(batch.column("file").to_pylist()), batch.column("hash").to_numpy()
        rows = batch.column("rows").to_numpy()
        for name in np.unique(names):
            own = names == name
            size = _filter_bits(int(rows[own][0]))
            bits = held.setdefault(str(name), np.zeros(size, bool))
            bits[_bit_places(hashes[own], size).ravel()] = True
    for name, bits in held.items():
        yield pa.RecordBatch.from_pydict({"file": [name], "bits": [np.packbits(bits).tobytes()]})


def _merged_bits(rows: pa.Table) -> pa.Table:
    merged = np.frombuffer(rows.column("bits")[0].as_py(), np.uint8)
    for other in rows.column("bits")[1:]:
        merged = merged | np.frombuffer(other.as_py(), np.uint8)
    return pa.table({"file": rows.column("file")[:1], "bits": pa.array([merged.tobytes()], pa.binary())})


def _files_of(spark: SparkSession, path: str, batches: list[dict]) -> DataFrame:
    """``file, start, low, high, bits`` and the batch's ``folder`` of every file."""
    schema = "file string, rows long, start long, low string, high string, bits binary"
    noted = spark.read.schema(schema).parquet(*[_notes(path, b) for b in batches])
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return noted.withColumn("folder", folder)


def files_with(ids: DataFrame, path: str, batches: list[dict]) -> list[str] | None:
    """Paths of the files that may hold any of ``ids`` (a column ``id``); None stands
    for all of them, where there are too many ids to try on every file.

    Ids go to the tables of files, not the other way round: at most FEW_IDS of them.
    """
    spark = ids.sparkSession
    wanted = ids.select("id", F.xxhash64("id").alias("hash")).distinct().limit(FEW_IDS + 1).collect()
    if len(wanted) > FEW_IDS:
        return None
    wanted = sorted(r for r in wanted if r.id is not None)
    shared = spark.sparkContext.broadcast(([r.id for r in wanted], np.array([r.hash for r in wanted], np.int64)))

    def probe(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hashes = shared.value
        for table in tables:
            hit = []
            for at in range(table.num_rows):
                low, high, bits = (table.column(c)[at].as_py() for c in ("low", "high", "bits"))
                if low is None:
                    hit.append(False)
                    continue
                bits = np.unpackbits(np.frombuffer(bits, np.uint8))
                near = hashes[bisect_left(names, low) : bisect_right(names, high)]
                hit.append(bool(bits[_bit_places(near, len(bits))].all(1).any()))
            yield table.filter(pa.array(hit, pa.bool_())).select(["folder", "file"])

    noted = _files_of(spark, path, batches).select("folder", "file", "low", "high", "bits")
    found = noted.mapInArrow(probe, "folder string, file string").collect()
    return [f"{path}/{r.folder}/{r.file}" for r in found]


def _held(spark: SparkSession, path: str, batches: list[dict], ids: DataFrame) -> DataFrame:
    """The entries of ``batches`` in the files that may hold any of ``ids``."""
    files = files_with(ids, path, batches) if batches else []
    if files is None:
        files = [_data(path, b) for b in batches]
    if not files:
        return spark.createDataFrame([], INDEX_SCHEMA)
    return spark.read.schema(INDEX_SCHEMA).parquet(*files)


def append_index(
    fps: DataFrame, path: str, length: int, normalize: bool = False, writer: str | None = None,
    turn: int | None = None,
) -> None:
    """Add the entities that are new to the index at ``path``; create it if absent.

    Nothing is written where the index has them all.  The new batch is written beside
    the others and then committed; where another writer was faster, the entities that
    its batch holds are left out and the next number is tried.  A failed attempt leaves
    files that no reader sees.  Of the stored index only files are read that may hold
    one of the new ids.

    ``writer`` and ``turn`` name a source that takes care of repeated ids itself, such
    as a stream and its micro-batches: its own batches are not searched, and a turn
    that is committed is not added again.
    """
    spark, path = fps.sparkSession, path.rstrip("/")
    commits = Commits(spark, path)
    entries = materialize(check_length(index_entries(fps, normalize), length))
    checked, batch = 0, None
    while True:
        known = commits.batches()
        lengths = {b["length"] for b in known if b["length"] is not None}
        if lengths - {length}:
            raise ValueError(f"the index takes vectors of length {lengths.pop()}, not {length}")
        if writer is not None and any((b["writer"], b["turn"]) == (writer, turn) for b in known):
            return
        others = [b for b in known if b["number"] > checked and b["rows"] and (writer is None or b["writer"] != writer)]
        kept = entries
        if others:
            kept = materialize(new_only(entries, _held(spark, path, others, entries)))
        if batch is None or others and kept.count() < batch["rows"]:
            entries = kept
            if entries.isEmpty():
                return
            batch = {"folder": f"batch-{uuid.uuid4().hex}", "length": length, "writer": writer, "turn": turn}
            entries.write.parquet(_data(path, batch))
            batch["rows"] = _note_files(spark, path, batch)
        checked = known[-1]["number"] if known else 0
        if commits.put(batch, known):
            return


def _stored(spark: SparkSession, path: str, batches: list[dict]) -> DataFrame:
    folders = [_data(path, b) for b in batches if b["rows"]]
    if not folders:
        return spark.createDataFrame([], INDEX_SCHEMA)
    return spark.read.schema(INDEX_SCHEMA).parquet(*folders)


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    """``(id, meta, L, ranks)`` of all committed batches."""
    path = path.rstrip("/")
    return _stored(spark, path, Commits(spark, path).batches())


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, id, meta, L, ranks)``: the index with the position of each entry.

    Where a file starts is noted when it is committed, so nothing is counted here.
    """
    path = path.rstrip("/")
    batches = [b for b in Commits(spark, path).batches() if b["rows"]]
    columns = ["id", "meta", "L", "ranks"]
    if not batches:
        return spark.createDataFrame([], f"pos long, {INDEX_SCHEMA}")
    located = _stored(spark, path, batches).select(
        *columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    files = _files_of(spark, path, batches).select("folder", "file", "start")
    ahead = spark.createDataFrame([(b["folder"], b["start"]) for b in batches], "folder string, ahead long")
    # one row per batch
    starts = materialize(files.join(F.broadcast(ahead), "folder").select("file", (F.col("ahead") + F.col("start")).alias("start")))
    if starts.count() <= FEW_FILES:
        starts = F.broadcast(starts)
    return located.join(starts, "file").select((F.col("start") + F.col("row")).alias("pos"), *columns)
