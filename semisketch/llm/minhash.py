"""Document fingerprints by one-permutation MinHash.

Every shingle of five words is hashed once. The upper bits of the hash choose one of
``BINS`` bins, each of which keeps its least hash. Empty bins are filled by optimal
densification: a bin draws others in an order of its own, the same for all documents,
until it meets one that is filled, and copies it. Of each bin the ``BITS`` low-order
bits are stored, packed. Two fingerprints agree by chance in one of ``2**BITS`` bins,
for which the estimate of the shingle sets' Jaccard similarity is corrected.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, slices, stored

WORDS = 5
BINS = 256
BITS = 4
#: Words a worker remembers before it starts afresh.
REMEMBERED = 500_000
#: Characters that are cut and hashed at a time.
SLICE = 500_000
_EMPTY = np.uint64(2**64 - 1)


# --- hashes -----------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finaliser of SplitMix64; its multipliers are fixed values)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Words(dict):
    """A worker's memory of words: a number for each, and by it a 64-bit hash."""

    _here: Words | None = None

    def __init__(self):
        self.hashes = array("Q")

    @classmethod
    def here(cls) -> Words:
        if cls._here is None or len(cls._here) > REMEMBERED:
            cls._here = cls()
        return cls._here

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
        return number


def shingle_hashes(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every shingle and the number of its text. A text of fewer words is one
    shingle, one without words has none."""
    memory = Words.here()
    found = [t.encode("utf-8", "surrogatepass").translate(LOWERED).split() for t in texts]
    n = np.array([len(f) for f in found], np.int64)
    numbers = np.fromiter((memory[w] for f in found for w in f), np.int64, int(n.sum()))
    # a blank word of hash 0 after each text lets short ones be one shingle
    ends = np.cumsum(n + words)
    hashes = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(numbers)) + owner * words
    hashes[at] = np.frombuffer(memory.hashes, np.uint64)[numbers] if len(numbers) else 0
    first = np.arange(len(numbers)) - np.repeat(np.cumsum(n) - n, n)
    begins = (first + words <= n[owner]) | (first == 0)
    at, owner = at[begins], owner[begins]
    total = np.zeros(len(at), np.uint64)
    for i in range(words):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[at + i]
    return mixed(total), owner


def _drawn(bins: int, turn: int) -> np.ndarray:
    """The bin that each bin draws in a turn: one of a family of hashes of both."""
    own = np.arange(bins, dtype=np.uint64) + np.uint64(turn + 1 << 32)
    return (mixed(own) % np.uint64(bins)).astype(np.int64)


def densified(least: np.ndarray) -> np.ndarray:
    """Rows of bins with every empty bin filled; a row without any value stays empty."""
    out = least.copy()
    row, col = np.nonzero((least == _EMPTY) & (least != _EMPTY).any(1)[:, None])
    turn = 0
    while len(row):
        copied = least[row, _drawn(least.shape[1], turn)[col]]
        filled = copied != _EMPTY
        out[row[filled], col[filled]] = copied[filled]
        row, col = row[~filled], col[~filled]
        turn += 1
    return out


def signatures(texts: list[str], words: int = WORDS, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """The packed low-order bits of each text; no bytes for a text without words.
    ``bins`` is a power of two, ``bits`` 1, 2, 4 or 8."""
    out = []
    for at, to in slices(texts, SLICE):
        hashes, owner = shingle_hashes(texts[at:to], words)
        least = np.full((to - at) * bins, _EMPTY)
        np.minimum.at(least, owner * bins + (hashes >> np.uint64(65 - bins.bit_length())).astype(np.int64), hashes)
        least = least.reshape(to - at, bins)
        held = (least != _EMPTY).any(1)
        low = (densified(least) & np.uint64((1 << bits) - 1)).astype(np.uint8)
        shifts = np.arange(0, 8, bits, dtype=np.uint8)
        packed = (low.reshape(to - at, -1, 8 // bits) << shifts).sum(2, dtype=np.uint8)
        out += [p.tobytes() if h else b"" for p, h in zip(packed, held, strict=True)]
    return out


def likeness(left: list[bytes], right: list[bytes], bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity, 0 to 1, of pairs of signatures: the share of bins
    that agree, less what agrees by chance. Two texts without words are alike."""
    out = np.array([float(not x and not y) for x, y in zip(left, right, strict=True)])
    both = [i for i, (x, y) in enumerate(zip(left, right, strict=True)) if x and y]
    if both:
        differ = np.frombuffer(b"".join(left[i] for i in both), np.uint8) ^ np.frombuffer(b"".join(right[i] for i in both), np.uint8)
        cells = differ[:, None] >> np.arange(0, 8, bits, dtype=np.uint8) & np.uint8((1 << bits) - 1)
        chance = 1 / (1 << bits)
        out[both] = np.clip(((cells == 0).reshape(len(both), -1).mean(1) - chance) / (1 - chance), 0, 1)
    return out


# --- documents --------------------------------------------------------------------


def fingerprints(docs: DataFrame, **shape: int) -> DataFrame:
    """``docs`` and ``fingerprint``, the packed bits as hexadecimal digits.

    Every row keeps its columns, a column ``fingerprint`` is replaced. Whole texts are
    read; equal texts have equal fingerprints. Null and empty texts, and those without
    words, have an empty one; fewer than ``words`` words are one shingle. Rows stay in
    their partition, an empty table stays empty.
    """

    @F.arrow_udf("binary")
    def sign(texts: pa.Array) -> pa.Array:
        return pa.array(signatures(texts.to_pylist(), **shape), pa.binary())

    return docs.withColumn("fingerprint", F.lower(F.hex(sign(F.coalesce("text", F.lit(""))))))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of another."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_EDGE = pa.schema([("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
EDGE = "part int, edge string, text string"


def _compared(ids: list, texts: list[str], signs: list[bytes], after: list[str], after_signs: list[bytes]) -> list:
    """Columns of ROW for documents and those that follow them."""
    new = [edited(t, f) for t, f in zip(texts, after, strict=True)]
    new_signs = signatures(new)
    return [
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
        signs, new_signs, likeness(signs, new_signs), likeness(signs, after_signs),
    ]


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted partition with the next; its first and last row,
    which have a neighbour in another partition, come out with their texts."""
    part, last = TaskContext.get().partitionId(), None
    schema = pa.schema([*_ROW, *_EDGE])

    def edge(kind: str, doc_id, text: str, sign: bytes) -> pa.RecordBatch:
        return _batch([[doc_id], [len(text)], [None], [sign], [None], [None], [None], [part], [kind], [text]], schema)

    for batch in batches:
        every, rows = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for at, to in slices(rows, SLICE):
            ids, texts = every[at:to], rows[at:to]
            signs = signatures(texts)
            if last is None:
                yield edge("first", ids[0], texts[0], signs[0])
            else:
                ids, texts, signs = [last[0], *ids], [last[1], *texts], [last[2], *signs]
            last = ids[-1], texts[-1], signs[-1]
            if len(ids) > 1:
                columns = _compared(ids[:-1], texts[:-1], signs[:-1], texts[1:], signs[1:])
                yield _batch([*columns, *([None] * (len(ids) - 1) for _ in _EDGE)], schema)
    if last is not None:
        yield edge("last", *last)


def _over_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):  # texts of any length: one at a time
            row = batch.slice(at, 1).to_pydict()
            yield _batch(_compared(row["doc_id"], row["text"], row["fingerprint"], row["next_text"], row["next_fingerprint"]), _ROW)


def edit_comparison(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``: every document against itself edited and against the next one.

    The next document is that of the next smaller ``doc_id``, after the last the first;
    the edited text has the last third of its code points replaced by as many, or all,
    of the next one's first. ``docs`` has ``doc_id`` and ``text``; other columns are
    passed over. Null texts count as empty. Null ids come last; rows of one id follow
    each other by a hash of their texts, and rows that repeat both are alike. A single
    document follows itself; an empty table gives an empty one. Texts are sorted by
    ranges of ids and compared as they stream by; only the first and last text of each
    range are kept for a second step.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("item", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), "mark", "item"]
    found = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_in_order, f"{ROW}, {EDGE}"))
    names = [f.name for f in _ROW]
    # a number per range that has rows
    parts = sorted(r.part for r in found.filter("edge = 'first'").select("part").collect())
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, following int")
    firsts = found.filter("edge = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    lasts = found.filter("edge = 'last'").select("part", "doc_id", "text", "fingerprint")
    edges = lasts.join(F.broadcast(following), "part").join(firsts, "following").drop("part", "following")
    out = found.filter("edge is null").select(*names).unionByName(edges.mapInArrow(_over_edges, ROW))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
