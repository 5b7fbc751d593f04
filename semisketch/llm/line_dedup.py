"""Reversible line deduplication over documents that come and go.

The exact tables are the truth: ``postings`` holds every (key, document), ``refs`` how
many documents hold a key and the largest of them. Cuckoo filters, one per shard of
the key space, hold the keys found in at least ``min_docs`` documents. Lines meet the
filter of their shard in one group, which keeps all others out of the join with
``refs``; unlike Bloom filters these forget a key when deletions bring it below the
threshold. Shards grow in number with the keys. The few keys that make up a large share
of all postings are looked up by a broadcast of bounded size, so no shard is hot.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import let
from .common import BLANKS, ascii_lower, stored

MIN_CHARS = 20
MIN_DOCS = 3
#: Repeated keys and postings that a shard has at most when its filters are dealt anew.
SHARD_KEYS = 50_000
SHARD_POSTINGS = 500_000
#: A key with more than this share of all postings is hot; so there are at most as many.
HOT_SHARE = 10_000
SLOTS = 4
KICKS = 500


# --- the filter -----------------------------------------------------------------


class CuckooFilter:
    """Partial-key cuckoo filter: four 16-bit tags a bucket, two buckets a key.

    Keys are digests of 16 bytes. ``add`` doubles and refills from ``keys()`` are up to
    the caller: it returns False when no place was found.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 16
        while buckets * SLOTS * 0.85 < n:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tag (never 0) and both buckets of keys given as rows of two 64-bit words."""
        last = np.uint64(len(self.table) - 1)
        tag = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        tag[tag == 0] = 1
        one = keys[:, 1] >> np.uint64(24) & last
        return tag, one.astype(np.int64), self.other(one.astype(np.int64), tag)

    def other(self, bucket, tag):
        spread = np.asarray(tag, np.int64) * 0x5BD1E995
        return (bucket ^ spread) & (len(self.table) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        tag, one, two = self.places(keys)
        tag = tag[:, None]
        return (self.table[one] == tag).any(1) | (self.table[two] == tag).any(1)

    def add(self, keys: np.ndarray) -> bool:
        move = np.random.default_rng(len(keys))
        for tag, one, two in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            bucket = one
            for turn in range(KICKS):
                row = self.table[bucket]
                free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = tag
                    break
                if turn == 0 and bucket == one and one != two:
                    bucket = two
                    continue
                slot = int(move.integers(SLOTS))
                tag, row[slot] = int(row[slot]), tag
                bucket = int(self.other(bucket, tag))
            else:
                return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        """Forget keys that were added; one copy of the tag each."""
        for tag, one, two in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == tag)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def words_of(keys) -> np.ndarray:
    """Digests as rows of two 64-bit words."""
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


# --- keys of lines --------------------------------------------------------------


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_keys(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Distinct digests of the keys of at least ``min_chars`` code points."""
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line_key)
    long = F.filter(keys, lambda k: F.length(k) >= min_chars)
    return F.array_distinct(F.transform(long, lambda k: F.unhex(F.md5(k))))


def long_lines(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """STRUCT(key, at) of the lines whose keys have at least ``min_chars`` code points."""
    keys = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda line, at: F.struct(line_key(line).alias("key"), at.alias("at")),
    )
    long = F.filter(keys, lambda x: F.length(x["key"]) >= min_chars)
    return F.transform(long, lambda x: F.struct(F.unhex(F.md5(x["key"])).alias("key"), x["at"].alias("at")))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines at the positions ``gone``; all of it where that is null."""
    kept = let(
        F.struct(F.split(text, "\n", -1).alias("lines"), gone.alias("gone")),
        lambda s: F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]), lambda i: F.get(s["lines"], i)
        ),
    )
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


# --- the index ------------------------------------------------------------------


@dataclass(frozen=True)
class LineIndex:
    """A version of the index, in a folder that all executors share.

    Each change writes the next version beside the last and returns it; older versions
    stay readable.
    """

    folder: str
    version: int = 0
    shards: int = 0
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    def _path(self, table: str) -> str:
        return f"{self.folder}/v{self.version}/{table}"

    def _read(self, spark: SparkSession, table: str) -> DataFrame:
        schema = {
            "postings": "key binary, doc_id long",
            "refs": "key binary, n_docs long, last_doc long",
            "filters": "shard long, bytes binary",
        }[table]
        if not self.version:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self._path(table))

    def postings_of(self, docs: DataFrame) -> DataFrame:
        """Distinct ``(key, doc_id)`` of documents; rows without an id take no part."""
        keys = F.explode(line_keys(F.col("text"), self.min_chars)).alias("key")
        return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), keys).select("key", "doc_id").distinct()

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents. Lines that a document already has in the index count once."""
        spark = docs.sparkSession
        new = self.postings_of(docs)
        if self.version:
            old = self._read(spark, "postings")
            new = old.union(new).distinct()
        return self._next(spark, new)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents out again, by ``doc_id``; unknown ids are passed over."""
        spark = doc_ids.sparkSession
        gone = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        return self._next(spark, self._read(spark, "postings").join(gone, "doc_id", "left_anti").select("key", "doc_id"))

    def _next(self, spark: SparkSession, postings: DataFrame) -> LineIndex:
        """Write the tables of the next version and bring the filters up to date."""
        step = replace(self, version=self.version + 1)
        postings.write.parquet(step._path("postings"))
        refs = step._read(spark, "postings").groupBy("key").agg(
            F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")
        )
        refs.write.parquet(step._path("refs"))
        held = lambda index: index._read(spark, "refs").filter(F.col("n_docs") >= self.min_docs).select("key")
        was, now = held(self), held(step)
        sizes = step._read(spark, "refs").agg(
            F.sum("n_docs").alias("postings"), F.count_if(F.col("n_docs") >= self.min_docs).alias("keys")
        ).first()
        needed = max(-(-sizes["keys"] // SHARD_KEYS), -(-(sizes["postings"] or 0) // SHARD_POSTINGS))
        fresh = needed > 2 * self.shards or not self.version
        if fresh:
            step = replace(step, shards=max(16, needed))
        filters = self._read(spark, "filters")
        changes = now.withColumn("added", F.lit(True))
        if fresh:
            filters = filters.limit(0)
        else:
            changes = now.join(was, "key", "left_anti").withColumn("added", F.lit(True)).union(
                was.join(now, "key", "left_anti").withColumn("added", F.lit(False))
            )
        changes = changes.select(step._shard(), "key", "added")
        # a shard that overflows is refilled from the exact table, so a filter never lacks a key
        changed = filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_updated, "shard long, bytes binary, full boolean")
        changed.write.parquet(step._path("tried"))
        tried = spark.read.parquet(step._path("tried"))
        full = tried.filter("full").select("shard")
        refilled = now.select(step._shard(), "key").join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_refilled, "shard long, bytes binary")
        tried.filter("not full").select("shard", "bytes").union(refilled).write.parquet(step._path("filters"))
        return step

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).alias("shard")

    def repeated(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, mark, key, at)`` of the lines that have to go: held by enough
        documents, the largest of which is another one. ``mark`` tells texts of one id
        apart, ``at`` is the line's number from 0."""
        spark = docs.sparkSession
        lines = docs.filter("doc_id is not null").select(
            F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"),
            F.inline(long_lines(F.col("text"), self.min_chars)),
        )
        refs = self._read(spark, "refs").filter(F.col("n_docs") >= self.min_docs)
        every = self._read(spark, "refs").agg(F.sum("n_docs")).first()[0] or 0
        # at most HOT_SHARE keys can have more than that share of the postings
        hot = refs.filter(F.col("n_docs") * HOT_SHARE > every).select("key", F.col("last_doc").alias("hot_doc"))
        lines = stored(lines.join(F.broadcast(hot), "key", "left"))
        found = lines.filter("hot_doc is not null and doc_id < hot_doc").select("doc_id", "mark", "key", "at")
        others = lines.filter("hot_doc is null").select(self._shard(), "doc_id", "mark", "key", "at")
        probed = self._read(spark, "filters").groupBy("shard").cogroup(others.groupBy("shard")).applyInPandas(
            _probed, "doc_id long, mark long, key binary, at int"
        )
        return found.unionByName(probed.join(refs, "key").filter("doc_id < last_doc").select("doc_id", "mark", "key", "at"))

    def cleaned(self, docs: DataFrame) -> DataFrame:
        """Documents without their repeated lines: ``row, doc_id, n_lines, n_dropped, kept``.

        ``row`` is the struct of all columns of ``docs``. Rows without an id keep all
        lines; rows of one id are treated alike; a null text counts as one empty line.
        """
        gone = self.repeated(docs).groupBy("doc_id", "mark").agg(F.collect_set("at").alias("gone"))
        rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"))
        text = F.coalesce(F.col("row.text"), F.lit(""))
        return rows.join(gone, ["doc_id", "mark"], "left").select(
            "row", "doc_id", F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
            without_lines(text, F.col("gone")).alias("kept"),
        )


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _updated(filters: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    shard = int((changes if len(changes) else filters)["shard"].iloc[0])
    added, removed = (changes["key"][changes["added"] == on] for on in (True, False))
    table = CuckooFilter.of_bytes(filters["bytes"].iloc[0]) if len(filters) else CuckooFilter.sized(len(added))
    if len(removed):
        table.remove(words_of(removed))
    full = bool(len(added)) and not table.add(words_of(added))
    return pd.DataFrame({"shard": [shard], "bytes": [table.to_bytes()], "full": [full]})


def _refilled(keys: pd.DataFrame) -> pd.DataFrame:
    size, words = len(keys), words_of(keys["key"])
    while True:
        size *= 2
        table = CuckooFilter.sized(size)
        if table.add(words):
            return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "bytes": [table.to_bytes()]})


def _probed(filters: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
    """The lines of one shard that its filter has."""
    found = np.zeros(len(lines), bool)
    if len(filters) and len(lines):
        found = CuckooFilter.of_bytes(filters["bytes"].iloc[0]).has(words_of(lines["key"]))
    return lines.loc[found, ["doc_id", "mark", "key", "at"]]


def with_kept_lines(index: LineIndex, docs: DataFrame) -> DataFrame:
    """Documents as they were, their texts cleaned and ``n_chars``, where there is such a
    column, counted anew. A text of which no line is left is empty; a null stays null."""
    rows = index.cleaned(docs)
    text = F.when(F.col("row.text").isNull() & (F.col("kept") == ""), None).otherwise(F.col("kept"))
    columns = [text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return rows.select(*columns)
