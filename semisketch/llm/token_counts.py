"""Token counts with a two-tier lookup on the map side.

A text is cut into pre-tokens; the tokens of a text are the sum of those of its
pre-tokens. Lengths of frequent pre-tokens come from one compact hash table that every
task gets; the rest is encoded once per worker and remembered there. Pre-tokens are
never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Frequent pieces in the shared table, and what each task reports of its rows.
FREQUENT = 32_768
PER_TASK = 2_048
#: Distinct pieces a task counts before it keeps only the most frequent ones.
COUNTED = 200_000
#: Pieces a worker remembers before it starts afresh.
REMEMBERED = 500_000
#: Characters that are cut and looked up at a time.
SLICE = 250_000
LIMIT = 512
#: Texts whose code points all lie below this are cut here; the library and the pattern
#: agree on them. Others, and those that hold a special string, go to the library whole.
PLAIN = "ɐ"
#: Marks that are one pre-token after letters; no apostrophe, which can open another.
MARKS = '!"#$%&()*+,-./:;<=?@[]^_`{|}~'
#: White space that makes pre-tokens of its own: then the whole pattern is applied.
_ODD = regex.compile(r"[\t\r\v\f\x1c-\x1f\x85\xa0]|\s\s|^\s|\s$")
_cut = regex.compile(PATTERN).findall


class Lengths:
    """The compact table: open addressing over 64-bit hashes, one byte a length."""

    def __init__(self, lengths: dict[str, int]):
        size = 1 << max(4, (2 * len(lengths)).bit_length())
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        for text, n in lengths.items():
            if n < 256:
                h = xxhash.xxh3_64_intdigest(text)
                at = h & (size - 1)
                while self.keys[at] and int(self.keys[at]) != h:
                    at = (at + 1) & (size - 1)
                self.keys[at], self.values[at] = h, n
        self.last = size - 1

    def __getstate__(self):
        return self.keys, self.values, self.last

    def __setstate__(self, state):
        self.keys, self.values, self.last = state

    def opened(self) -> dict[int, int]:
        at = np.flatnonzero(self.values)
        return dict(zip(self.keys[at].tolist(), self.values[at].tolist(), strict=True))


class Counting:
    """A worker's tokenizer, its shared table and its memory of misses.

    Between words that one blank parts, the blank opens a pre-token. So a text whose white
    space is single blanks and line ends is cut at blanks, and a piece stands for one or
    few pre-tokens: its own with the blank before it or, after a line end, for the line
    end and what follows. Other texts are cut by the pattern.
    """

    _of: dict[str, Counting] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.opening = np.zeros(self.library.get_vocab_size(), bool)
        self.opening[[i for t, i in self.library.get_vocab().items() if t.startswith("Ġ")]] = True
        self.memory: dict[str, int] = {}
        self.table: dict[int, int] = {}

    @classmethod
    def here(cls, path: str) -> Counting:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def plain(self, text: str) -> bool:
        return (text.isascii() or max(text) < PLAIN) and not any(s in text for s in self.special)

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Pieces of a plain text; the first stands for itself without a blank."""
        if _ODD.search(text):
            return []
        return text.replace("\n", " \n").split(" ")

    def learn(self, pieces: list[str]) -> None:
        """Lengths of pieces: of letters many at a time, of letters and the marks after
        them as the sum, of others one by one."""
        words, marked, others = set(), [], []
        for piece in pieces:
            n = self.table.get(xxhash.xxh3_64_intdigest(piece))
            if n is not None:
                self.memory[piece] = n
                continue
            core = piece if piece.isalpha() else piece.rstrip(MARKS)
            if not core.isalpha():
                others.append(piece)
            elif core == piece:
                words.add(piece)
            else:
                words.add(core)
                marked.append((piece, core, piece[len(core) :]))
        self.learn_words([w for w in words if w not in self.memory])
        self.memory.update(zip(others, self.whole([p if p[:1] == "\n" else " " + p for p in others]), strict=True))
        tails = list({tail for _, _, tail in marked})
        lengths = dict(zip(tails, self.whole(tails), strict=True))
        self.memory.update((piece, self.memory[core] + lengths[tail]) for piece, core, tail in marked)

    def learn_words(self, words: list[str]) -> None:
        for at in range(0, len(words), 2_000):
            part = words[at : at + 2_000]
            ids = np.array(self.library.encode(" " + " ".join(part), add_special_tokens=False).ids, np.int64)
            starts = np.flatnonzero(self.opening[ids])
            if len(starts) == len(part):
                lengths = np.diff(np.r_[starts, len(ids)]).tolist()
            else:
                lengths = self.whole([" " + w for w in part])
            self.memory.update(zip(part, lengths, strict=True))

    def counts(self, texts: list[str]) -> Iterator[int]:
        """Tokens of each text."""
        for at, to in slices(texts, SLICE):
            some = texts[at:to]
            cut = [self.pieces(t) if self.plain(t or " ") else None for t in some]
            distinct = set().union(*(c[1:] for c in cut if c))
            lacking = [p for p in distinct if p not in self.memory]
            if len(self.memory) + len(lacking) > REMEMBERED:
                self.memory.clear()
                lacking = list(distinct)
            self.learn(lacking)
            look = self.memory.__getitem__
            for text, pieces in zip(some, cut, strict=True):
                if not text:
                    yield 0
                elif pieces:
                    yield sum(map(look, pieces[1:])) + (self.whole(pieces[:1])[0] if pieces[0] else 0)
                elif pieces is None:
                    yield self.whole([text])[0]
                else:
                    seen = Counter(_cut(text))
                    yield sum(n * k for n, k in zip(seen.values(), self.whole(list(seen)), strict=True))


def _frequent(path: str):
    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's most frequent pieces; rare ones are dropped on the way."""
        worker, seen = Counting.here(path), Counter()
        for batch in batches:
            for text in batch["text"]:
                if text and worker.plain(text):
                    seen.update(worker.pieces(text)[1:])
                    if len(seen) > COUNTED:
                        seen = Counter(dict(seen.most_common(COUNTED // 4)))
        top = seen.most_common(PER_TASK)
        if top:
            yield pd.DataFrame(top, columns=["piece", "n"])

    return report


def frequent_lengths(docs: DataFrame, path: str) -> Lengths:
    """Table of the most frequent pieces of all texts.

    Every task reports at most PER_TASK of them with their counts, the sums' largest
    FREQUENT come to the driver. What the table lacks costs time, never a count.
    """
    spark = docs.sparkSession
    found = docs.select("text").mapInPandas(_frequent(path), "piece string, n long")
    top = found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(FREQUENT)
    worker = Counting.here(path)
    pieces = [r.piece for r in top.select("piece").collect()]
    return Lengths(dict(zip(pieces, worker.whole([p if p[:1] == "\n" else " " + p for p in pieces]), strict=True)))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``.

    ``path`` names a tokenizer file of the tokenizers library with byte-level
    pre-tokens, there on every machine. Null and empty texts have 0 bytes and tokens.
    Special strings inside texts count as the library's default has them. Rows stay
    where they are: repeated rows, one huge text or an empty table need nothing else.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker = Counting.here(path)
        worker.table = table.value.opened()
        for texts in batches:
            yield pd.Series(list(worker.counts(texts.tolist())), dtype="int64")

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
