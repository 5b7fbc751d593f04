"""Best-fit packing of documents into sequences of bounded length.

Lengths are whole numbers up to the capacity, so the sorted order of documents and of
gaps is a table of at most ``capacity`` classes. Ranks inside a class come from a range
sort; the sweep that matches classes runs over class counts alone and says for whole
runs of ranks where they go.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

CAPACITY = 4096
#: Closes every document.
END = 1
#: Distinct chunks a worker remembers before it starts afresh.
REMEMBERED = 500_000
#: Characters that are cut and looked up at a time.
SLICE = 250_000
#: Marks that are one pre-token after letters; no apostrophe, which can open another.
MARKS = '!"#$%&()*+,-./:;<=?@[]^_`{|}~'
#: Blanks for ``str.split`` that are none for the tokenizer's pattern.
_ODD = re.compile("[\x1c-\x1f]")
PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


class Words(dict):
    """A worker's memory: chunk between blanks to its ids, as bytes.

    The vocabulary drops white space and closes words at it, so the ids of a text are
    those of its chunks in order.
    """

    _of: dict[str, Words] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.closing = np.zeros(self.library.get_vocab_size(), bool)
        self.closing[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True

    @classmethod
    def here(cls, path: str) -> Words:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks. Letters alone are one word, and so are marks after them, so
        such a chunk's ids are those of both; other chunks are encoded one by one."""
        words, marked, others = set(), [], set()
        for chunk in chunks:
            core = chunk if chunk.isalpha() else chunk.rstrip(MARKS)
            if not core.isalpha() or not (core.isascii() or normalize("NFC", core).lower().isalpha()):
                others.add(chunk)
                continue
            words.add(core)
            if len(core) < len(chunk):
                marked.append((chunk, core, chunk[len(core) :]))
                others.add(chunk[len(core) :])
        self.learn_words([w for w in words if w not in self])
        self.learn_others([c for c in others if c not in self])
        self.update((chunk, self[core] + self[tail]) for chunk, core, tail in marked)

    def learn_words(self, words: list[str]) -> None:
        """A word ends in the one token that closes it, so many words are encoded as one
        text and told apart again; should they not come out one by one, singly."""
        for at in range(0, len(words), 2_000):
            part = words[at : at + 2_000]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(part):
                data, ends = ids.tobytes(), (4 * ends).tolist()
                self.update(zip(part, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=False))
            else:
                self.learn_others(part)

    def learn_others(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 10_000):
            part = chunks[at : at + 10_000]
            found = self.library.encode_batch_fast(part, add_special_tokens=False)
            self.update(zip(part, (np.array(e.ids, "<u4").tobytes() for e in found), strict=True))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        for at, to in slices(texts, SLICE):
            cut = [None if _ODD.search(t) else t.split() for t in texts[at:to]]
            distinct = set().union(*filter(None, cut))
            lacking = [c for c in distinct if c not in self]
            if len(self) + len(lacking) > REMEMBERED:
                self.clear()
                lacking = list(distinct)
            self.learn(lacking)
            for text, chunks in zip(texts[at:to], cut, strict=True):
                if chunks is None:
                    found = self.library.encode(text, add_special_tokens=False).ids
                    yield np.array(found, "<u4").tobytes()
                else:
                    yield b"".join(map(self.__getitem__, chunks))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: ``doc_id, piece, start, length,
    ids_crc32`` and, if asked for, ``ids``.

    A document is its text's ids by the tokenizers library and END; only a longer one is
    cut, and only its last piece may be shorter. A null or empty text is one piece of
    END alone. Whole texts are encoded; rows stay in their partition.
    """
    end = np.array([END], "<u4").tobytes()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words.here(path)
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch["doc_id"], words.ids(batch["text"].tolist()), strict=True):
                data += end
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype(np.int32),) if with_ids else ()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            made = pd.DataFrame(rows, columns=names)
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(encode, PIECE + ", ids array<int>" * with_ids)


# --- the sweep over classes -----------------------------------------------------


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit placement of ``counts[length]`` pieces, longest first.

    Sequences with equal gaps are kept as runs of consecutive numbers. For each length,
    gaps are swept upwards from their successor, the smallest that holds it; pieces go by
    rank into the sequences of a run, as many as fit into each, which is what best fit
    does piece by piece, as the sequence just used is then the fullest. What finds no
    gap opens a run of new sequences. Returns
    ``(length, first rank, first sequence, pieces per sequence, offset)``. Work and
    result depend on the number of lengths, not of pieces.
    """
    gaps: list[int] = []  # sorted
    runs: dict[int, list[tuple[int, int]]] = {}
    placed, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap]
                    gaps.pop(at)
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            taken = min(left, each * n)
            placed.append((length, rank, first, each, capacity - gap))
            full, rest = divmod(taken, each)
            put(gap - each * length, first, full)
            put(gap - rest * length, first + full, 1 if rest else 0)
            used = full + (1 if rest else 0)
            put(gap, first + used, n - used)
            rank, left = rank + taken, left - taken
    return placed


def _ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rank of each piece among those of its length in this sorted partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        length = batch["length"].to_numpy()
        if not len(length):
            continue
        starts = np.flatnonzero(np.r_[True, length[1:] != length[:-1]])
        rank = np.arange(len(length)) - np.repeat(starts, np.diff(np.r_[starts, len(length)]))
        if length[0] == last:
            rank[: starts[1] if len(starts) > 1 else None] += seen
        last, seen = length[-1], int(rank[-1]) + 1
        yield batch.assign(part=part, rank=rank)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give pieces a place: all columns of ``found`` and ``sequence_id, offset``.

    Takes a ``length`` of 1 to ``capacity`` and an ``item`` that tells rows apart.
    Equal lengths are split over partitions by ``item``, so a length that a third of all
    pieces have is no hot key; the driver gets a count per length and partition. Reruns
    give the same places. An empty table gives an empty one.
    """
    ranked = stored(
        found.repartitionByRange("length", "item").sortWithinPartitions("length", "item")
        .mapInPandas(_ranked, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", part int, rank long")
    )
    counts = ranked.groupBy("length", "part").agg(F.count("*").alias("n")).orderBy("length", "part").collect()
    totals: dict[int, int] = {}
    ahead: dict[tuple[int, int], int] = {}
    for row in counts:
        ahead[row.length, row.part] = totals.get(row.length, 0)
        totals[row.length] = totals.get(row.length, 0) + row.n
    places = np.array(sorted(sweep(totals, capacity)), np.int64).reshape(-1, 5)
    shared = ranked.sparkSession.sparkContext.broadcast((ahead, places))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, part: pd.Series, rank: pd.Series) -> pd.DataFrame:
        ahead, places = shared.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64).copy()
        rank += np.array([ahead[k] for k in zip(length.tolist(), part.tolist(), strict=True)], np.int64)
        key = places[:, 0] << 44 | places[:, 1]
        at = places[np.searchsorted(key, length << 44 | rank, side="right") - 1]
        nth = rank - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 2] + nth // at[:, 3], "offset": at[:, 4] + nth % at[:, 3] * length})

    return ranked.withColumn("place", place("length", "part", "rank")).select(*found.columns, "place.*")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents to packed pieces: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``. Repeated rows are packed one by one."""
    found = pieces(docs, path, capacity).withColumn("item", F.monotonically_increasing_id())
    return pack(stored(found), capacity).drop("item")
