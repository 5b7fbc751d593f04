"""Importance resampling towards a target distribution.

Hashed word and word-pair features of all documents and of the target texts are counted
in arrays of one cell a bucket; the log ratios of both are the array that scores every
document. Scores get Gumbel noise from a digest of the id, so that the highest of them
are a draw without replacement in proportion to the weights. The cutoff is found by
bisection: exact count jobs over the stored scores, each of which halves the interval
several times, then the same over the ids of those that tie. Rows beyond it are ranked by
a range partitioning and the sizes of its parts.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALPHANUMERIC, slices, stored, text_bytes

BUCKETS = 10_000
MIN_WORDS = 20
#: Share of the documents with enough words that is drawn, in hundredths.
PERCENT = 25
SEED = 7
#: Words a worker remembers before it starts afresh.
REMEMBERED = 500_000
#: Bytes of text that are cut and counted at a time.
SLICE = 1_000_000
#: Thresholds of one count job: each halves the interval five times.
THRESHOLDS = 31


# --- buckets of features ----------------------------------------------------------


def _after_zeros() -> tuple[np.ndarray, np.ndarray]:
    """What zero bytes make of a checksum, as tables by byte: for 0 to 63 of them, and
    for 64 times each power of two."""

    def twice(step):
        return applied(step, applied(step, unit))

    def applied(step, x):
        return step[0][x & 255] ^ step[1][x >> 8 & 255] ^ step[2][x >> 16 & 255] ^ step[3][x >> 24]

    unit = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    none = zlib.crc32(b"\0", 0)
    one = np.array([[zlib.crc32(b"\0", int(x)) ^ none for x in row] for row in unit], np.uint32)
    few = [unit]
    for _ in range(64):
        few.append(applied(one, few[-1]))
    powers = [few.pop()]
    for _ in range(25):
        powers.append(twice(powers[-1]))
    return np.array(few), np.array(powers)


class Words(dict):
    """A worker's memory of words: a number for each, and by it the checksum of the
    word, that of the word and a blank, and its length.

    CRC-32 is affine over the bits, so the checksum of two words is that of the first
    and a blank moved by the second's length, xor that of the second: pairs are never
    put together.
    """

    _here: Words | None = None

    def __init__(self):
        self.alone, self.begun, self.size = array("I"), array("I"), array("Q")
        self.few, self.powers = _after_zeros()

    @classmethod
    def here(cls) -> Words:
        if cls._here is None:
            cls._here = cls()
        return cls._here

    def __missing__(self, word: bytes) -> int:
        crc = zlib.crc32(word)
        self.alone.append(crc)
        self.begun.append(zlib.crc32(b" ", crc))
        self.size.append(len(word))
        self[word] = number = len(self)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def forget(self) -> None:
        self.clear()
        self.alone, self.begun, self.size = array("I"), array("I"), array("Q")

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Checksums of word, blank, word."""
        x = np.frombuffer(self.begun, np.uint32)[first]
        size = np.frombuffer(self.size, np.uint64)[second].astype(np.int64)
        low = size & 63
        moved = np.zeros(len(x), np.uint32)
        for byte in range(4):
            moved ^= self.few[low, byte, x >> np.uint32(8 * byte) & np.uint32(255)]
        size >>= 6
        power = 0
        while size.any():
            at = np.flatnonzero(size & 1)
            x = moved[at]
            moved[at] = self.powers[power][0][x & 255] ^ self.powers[power][1][x >> 8 & 255] ^ self.powers[power][2][x >> 16 & 255] ^ self.powers[power][3][x >> 24]
            size >>= 1
            power += 1
        return moved ^ np.frombuffer(self.alone, np.uint32)[second]


def buckets_of(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text; bucket and text of every feature."""
    memory = Words.here()
    if len(memory) > REMEMBERED:
        memory.forget()
    words = [memory.numbers(t.translate(ALPHANUMERIC).split()) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    every = np.concatenate([*words, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(texts)), n)
    alone = np.frombuffer(memory.alone, np.uint32)[every]
    first = np.flatnonzero(owner[1:] == owner[:-1])
    crc = np.concatenate([alone, memory.pairs(every[first], every[first + 1])])
    return n, (crc % np.uint32(buckets)).astype(np.int64), np.concatenate([owner, owner[first]])


def _sliced(batches: Iterator[pa.RecordBatch], buckets: int):
    """Rows of a batch from one place to another, with their features."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for at, to in slices(texts, SLICE):
            yield batch, at, to, *buckets_of(texts[at:to], buckets)


def feature_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: features of all texts, repeats counted; buckets without any have
    no row. A task sends one array of counts, so what is shuffled grows with tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, _, _, bucket, _ in _sliced(batches, buckets):
            total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    rows = texts.select(text_bytes(F.col("text")).alias("text"))
    return rows.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The array of gains: floor(1000 ln) of the smoothed target share over the smoothed
    share of all documents. A row per bucket reaches the driver."""

    def counted(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for row in feature_counts(texts, buckets).collect():
            out[row.bucket] = row.n
        return out

    s, t = counted(docs), counted(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch, at, to, n, bucket, owner in _sliced(batches, len(gain)):
            features = np.maximum(2 * n - 1, 0)
            total = np.zeros(to - at, np.int64)
            np.add.at(total, owner, gain[bucket])
            columns = [batch.column("doc_id").slice(at, to - at), pa.array(n), pa.array(features), pa.array(total // np.maximum(features, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text"))
    rows = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


# --- cutoff and ranks -------------------------------------------------------------


def nth_largest(rows: DataFrame, key: str, n: int) -> tuple[int, int]:
    """The n-th largest value of a whole-number column without nulls, and how many
    values lie above it, for 1 <= n <= rows: repeated counts over thresholds."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    while low < high:
        # thresholds over (low, high]: the n-th largest is at least low
        step = -(-(high - low) // (THRESHOLDS + 1))
        marks = list(range(low + step, high + 1, step))
        counts = rows.agg(*(F.count_if(F.col(key) >= m).alias(f"m{i}") for i, m in enumerate(marks))).first()
        reached = [m for m, c in zip(marks, counts, strict=True) if c >= n]
        beyond = [(m, c) for m, c in zip(marks, counts, strict=True) if c < n]
        low = reached[-1] if reached else low
        if beyond:
            high, above = beyond[0][0] - 1, beyond[0][1]
    return low, above


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
    buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document; ``rank`` from 1
    by falling score, then rising id, null where it is not drawn.

    ``docs`` has ``doc_id`` and ``text``, ``target`` has ``text``; other columns are
    passed over. Whole texts count. Null and empty texts have no features and weight 0.
    Of the N documents with at least ``min_words`` words floor(percent N / 100) are
    drawn. A null id counts as the largest in ties, and has the noise of an empty id.
    Repeated rows are documents of their own, ranked side by side. An empty target gives
    all documents the gains of the smoothing; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    tie = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    rows = scores(docs, gains(docs, target, buckets), seed)
    rows = stored(rows.withColumn("tie", tie).withColumn("item", F.monotonically_increasing_id()))
    able = rows.filter(F.col("n_words") >= min_words)
    draws = percent * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not draws:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    cutoff, above = nth_largest(able, "score", draws)
    level = able.filter(F.col("score") == cutoff).select((-1 - F.col("tie")).alias("turned"))
    last = -1 - nth_largest(level, "turned", draws - above)[0]
    taken = (F.col("n_words") >= min_words) & ((F.col("score") > cutoff) | ((F.col("score") == cutoff) & (F.col("tie") <= last)))
    order = [F.desc("score"), "tie", "item"]
    drawn = rows.filter(taken).repartitionByRange(*order).sortWithinPartitions(*order)
    drawn = stored(drawn.withColumn("place", F.monotonically_increasing_id()))
    # the identifier counts a part's rows in its lower 33 bits; a row per part reaches the driver
    part = F.shiftright("place", 33)
    starts, ahead = [], 0
    for row in drawn.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((row.part, ahead))
        ahead += row["count"]
    starts = spark.createDataFrame(starts, "part long, start long")
    rank = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = drawn.withColumn("part", part).join(F.broadcast(starts), "part")
    # rows that repeat score and id may reach beyond the draws
    ranked = ranked.select(*columns, F.when(rank <= draws, rank).alias("rank"))
    return ranked.unionByName(rows.filter(~taken).select(*columns, F.lit(None).cast("long").alias("rank")))
