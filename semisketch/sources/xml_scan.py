"""Records of XML files of any size, read by many tasks.

The text reader cuts a file after every ``>``.  What a piece means depends on where it
begins: in text, a comment, a literal section, an instruction, a declaration, or within
a quoted attribute.  A block of a file is read once for all these beginnings side by
side, which gives a small table: how the block ends, and how deep in records, for each
way it may begin.  Such tables can be put together in any grouping, so the few rows that
sum up a file's blocks tell how each block really begins.  Then the blocks are read once
more: records that lie within one come out at once, and only what reaches over a border
is put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# Ways a piece may begin; the last four are within quotes, of a tag that opens a record
# element or of another one.
TEXT, COMMENT, LITERAL, INSTRUCTION, DECLARATION, DOUBLE, SINGLE, OWN_DOUBLE, OWN_SINGLE = range(9)
BEGINNINGS = 9
_OPENERS = (("<!--", COMMENT, "--"), ("<![CDATA[", LITERAL, "]]"), ("<?", INSTRUCTION, "?"), ("<!", DECLARATION, ""))
_CLOSERS = {kind: end for _, kind, end in _OPENERS}
_QUOTE = re.compile("[\"']")
_QUOTED = {DOUBLE: (False, '"'), SINGLE: (False, "'"), OWN_DOUBLE: (True, '"'), OWN_SINGLE: (True, "'")}
#: Blocks up to which the table of their beginnings is sent to every task.
FEW_BLOCKS = 100_000


class Reader:
    """Reads pieces, each without the ``>`` behind it."""

    def __init__(self, row_tag: str):
        name = re.escape(row_tag)
        self.opening = re.compile(rf"<{name}(?:[\s/]|$)")
        self.closing = re.compile(rf"</{name}\s*$")

    def read(self, state: int, piece: str) -> tuple[int, int | None, bool]:
        """How the next piece begins, where an element of the record's name opens, if
        one does, and whether one closes, by a tag of its own or at once."""
        at = 0
        if state == TEXT:
            at = piece.find("<")
            if at < 0:
                return TEXT, None, False
            if piece.startswith(("<!", "<?"), at):
                return self._special(piece, at), None, False
            if self.closing.match(piece, at):
                return TEXT, None, True
            own, quote = bool(self.opening.match(piece, at)), None
        elif state in _CLOSERS:
            # a declaration that goes on over a > has a list in brackets
            end = "]" if state == DECLARATION else _CLOSERS[state]
            return TEXT if piece.rstrip().endswith(end) else state, None, False
        else:
            own, quote = _QUOTED[state]
        opened = at if own and state == TEXT else None
        rest = at
        while True:
            if quote is None:
                found = _QUOTE.search(piece, rest)
                if not found:
                    return TEXT, opened, own and piece.endswith("/")
                quote, rest = found.group(), found.end()
            end = piece.find(quote, rest)
            if end < 0:
                return (DOUBLE if quote == '"' else SINGLE) + 2 * own, opened, False
            quote, rest = None, end + 1

    def _special(self, piece: str, at: int) -> int:
        sign, kind, end = next(x for x in _OPENERS if piece.startswith(x[0], at))
        if kind == DECLARATION:
            listed = "[" in piece[at:] and not piece.rstrip().endswith("]")
            return DECLARATION if listed else TEXT
        return TEXT if piece.endswith(end) and len(piece) - at >= len(sign) + len(end) else kind


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows in order, each with a mark if it is the first of its block."""
    last = None
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            row = dict(zip(names, values, strict=True))
            key = row["file"], row["block"]
            yield key != last, row
            last = key


# --- how blocks begin -------------------------------------------------------------


def _summaries(row_tag: str):
    """``file, block, ends, change, least``: per beginning how the block ends, by how
    much the depth in records changes and the least depth on the way."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, key = Reader(row_tag), None
        ways: dict[int, list[list[int]]] = {}

        def told() -> pa.RecordBatch:
            by_start = sorted((start, state, change, least) for state, held in ways.items() for start, change, least in held)
            columns = [[row[i] for row in by_start] for i in (1, 2, 3)]
            kinds = [pa.string(), pa.int64()] + [pa.list_(pa.int32())] * 3
            values = [[key[0]], [key[1]], *([c] for c in columns)]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["file", "block", "ends", "change", "least"])

        for first, row in _by_block(batches):
            if first:
                if key:
                    yield told()
                key = row["file"], row["block"]
                ways = {b: [[b, 0, 0]] for b in range(BEGINNINGS)}
            after: dict[int, list[list[int]]] = {}
            for state, held in ways.items():
                to, opened, closed = reader.read(state, row["value"])
                if opened is not None or closed:
                    for way in held:
                        way[1] += (opened is not None) - closed
                        way[2] = min(way[2], way[1])
                # beginnings that have met go on as one
                after.setdefault(to, []).extend(held)
            ways = after
        if key:
            yield told()

    return scan


def _begin(blocks: pd.DataFrame) -> pd.DataFrame:
    """``file, block, state, depth, origin, broken`` of one file's blocks: how each
    begins, and in which block the record began that it begins in."""
    state, depth, origin, rows = TEXT, 0, -1, []
    for block in blocks.sort_values("block").itertuples():
        rows.append([block.file, block.block, state, depth, origin, False])
        least, change = block.least[state], block.change[state]
        # closing tags without an opening one do not count
        after = depth + change - min(0, depth + least)
        if depth + least <= 0:
            origin = block.block
        state, depth = int(block.ends[state]), int(after)
    rows[-1][-1] = state != TEXT or depth > 0
    return pd.DataFrame(rows, columns=["file", "block", "state", "depth", "origin", "broken"])


# --- records ----------------------------------------------------------------------


def _fragments(row_tag: str):
    """``file, origin, block, ended, text``: whole records, with a null ``origin``, and
    the parts of those that reach over the border of a block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, key, out, size = Reader(row_tag), None, [], 0
        state = depth = 0
        origin, parts = None, []
        names = ["file", "origin", "block", "ended", "text"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def unfinished() -> None:
            if key and depth > 0 and parts:
                out.append((key[0], key[1] if origin is None else origin, key[1], False, "".join(parts)))

        for first, row in _by_block(batches):
            if first:
                unfinished()
                key = row["file"], row["block"]
                state, depth = row["state"], row["depth"]
                # a record that began in an earlier block
                origin, parts = row["origin"] if depth else None, []
            piece = row["value"]
            state, opened, closed = reader.read(state, piece)
            if opened is not None:
                if depth == 0:
                    origin, parts = None, []
                    piece = piece[opened:]
                depth += 1
            if depth > 0:
                parts.append(f"{piece}>")
                size += len(piece)
            if closed and depth > 0:
                depth -= 1
                if depth == 0:
                    out.append((key[0], origin, key[1], True, "".join(parts)))
                    origin, parts = None, []
            if len(out) >= 10_000 or out and size > 1 << 24:
                yield told()
                out, size = [], 0
        unfinished()
        if out:
            yield told()

    return scan


def record_texts(spark: SparkSession, path, row_tag: str) -> DataFrame:
    """``(file, text)``: the outermost elements named ``row_tag`` of XML files.

    A null text stands for a file that ends inside a record, a comment or the like;
    its whole records come out all the same.  Tags in comments, literal sections and
    attributes do not count, nor do closing tags without an opening one.
    """
    text = spark.read.option("lineSep", ">").text(path)
    pieces = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    summed = pieces.mapInArrow(_summaries(row_tag), "file string, block long, ends array<int>, change array<int>, least array<int>")
    # a row per block, and the blocks of a file in one place
    begins = materialize(summed.groupBy("file").applyInPandas(_begin, "file string, block long, state int, depth int, origin long, broken boolean"))
    starts = begins.drop("broken")
    if begins.count() <= FEW_BLOCKS:
        rows = pieces.join(F.broadcast(starts), ["file", "block"])
    else:
        rows = pieces.withColumn("at", F.monotonically_increasing_id()).join(starts, ["file", "block"])
        rows = rows.repartition("file", "block").sortWithinPartitions("file", "block", "at").drop("at")
    found = materialize(rows.mapInArrow(_fragments(row_tag), "file string, origin long, block long, ended boolean, text string"))
    whole = found.where("origin is null").select("file", "text")
    parts = F.array_sort(F.collect_list(F.struct("block", "ended", "text")))
    joined = found.where("origin is not null").groupBy("file", "origin").agg(parts.alias("parts"))
    joined = joined.where(F.exists("parts", lambda p: p["ended"])).select(
        "file", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")
    )
    broken = begins.where("broken").select("file", F.lit(None).cast("string").alias("text"))
    return whole.unionByName(joined).unionByName(broken)
