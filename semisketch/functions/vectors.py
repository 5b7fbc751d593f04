"""Token vectors and their combination: the numeric kernel of the engine.

A token is a string whose first character is a type letter (see ``tokens.py``).
Everything here works on whole Arrow batches: the distinct tokens of a batch are
encoded once into a (tokens x L) matrix, statements pick rows of it, and the rows
of one document are summed.  The functions are called through Arrow UDFs, so each
batch is a slice of a Spark partition and no state survives between batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number when it arrives as text.
V1_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
V2_NUMBER = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

# Characters encoded per numpy call, and vector cells combined per numpy call.
# Both only bound memory: long texts are carried over from window to window.
WINDOW_CHARS = 1 << 20
WINDOW_CELLS = 1 << 22


@dataclass(frozen=True)
class Encoding:
    """How tokens become vectors and how three vectors become one."""

    dialect: str = "v2"  # v1 | v2
    numeric: str = "ME"  # ME | ML | smooth | simple
    string: str = "decay"  # decay | pair_sum
    decay: float = 0.1
    exponent_weight: float = 0.5
    combine: str = "product"  # product | average
    text_numbers: bool = True  # is numeric-looking text a number?

    def __post_init__(self):
        if self.dialect not in ("v1", "v2"):
            raise ValueError(f"unknown dialect {self.dialect!r}")
        if self.combine not in ("product", "average"):
            raise ValueError(f"unknown combination {self.combine!r}")

    @property
    def number_pattern(self) -> str:
        return V1_NUMBER if self.dialect == "v1" else V2_NUMBER


def stretch(m: np.ndarray, dialect: str) -> np.ndarray:
    """Shift each row so that its minimum is 0, then scale it to a sum of 1."""
    if not len(m):
        return m
    low = m.min(axis=1)
    if dialect == "v2":
        # v2 looks for the minimum only until it meets a cell that is exactly 0
        first = np.argmax(m <= 0, axis=1)
        low = np.where(m[np.arange(len(m)), first] == 0, 0.0, low)
    m = m - low[:, None]
    total = m.sum(axis=1)
    return m / np.where(total == 0, 1.0, total)[:, None]


def _cell(x: np.ndarray, length: int, dialect: str) -> np.ndarray:
    """Cell of a real position: v1 wraps, then truncates; v2 truncates, then wraps."""
    x = np.mod(x, length) if dialect == "v1" else np.mod(np.trunc(x), length)
    return x.astype(np.int64) % length


def _spread(m, x, weight, dialect):
    """Add ``weight`` at position x, shared with the next cell away from zero."""
    rows, length = np.arange(len(x)), m.shape[1]
    part = np.abs(x - np.trunc(x))
    np.add.at(m, (rows, _cell(x, length, dialect)), weight * (1 - part))
    np.add.at(m, (rows, _cell(np.where(x > 0, x + 1, x - 1), length, dialect)), weight * part)


def _decimal_parts(n: np.ndarray, dialect: str) -> tuple[np.ndarray, np.ndarray]:
    """Mantissa and base-10 exponent."""
    if dialect == "v1":
        exponent = np.trunc(np.log10(np.abs(n)))
        return n / np.power(10.0, exponent), exponent
    parts = [f"{v:e}".split("e") for v in n.tolist()]
    return (
        np.array([float(p[0]) for p in parts]),
        np.array([float(p[1]) for p in parts]),
    )


def number_matrix(n: np.ndarray, length: int, enc: Encoding) -> np.ndarray:
    """Vectors (before stretching) of finite non-zero numbers."""
    m = np.zeros((len(n), length))
    if not len(n):
        return m
    rows = np.arange(len(n))
    if enc.numeric in ("ME", "ML"):
        mantissa, exponent = _decimal_parts(n, enc.dialect)
        position = mantissa / 10.0 * length
        if enc.numeric == "ML":
            _spread(m, position, 1.0, enc.dialect)
            logged = n > 0 if enc.dialect == "v1" else n != 0
            part = m[logged]
            _spread(part, np.log(np.abs(n[logged])), 1.0, enc.dialect)
            m[logged] = part
        else:
            w = 0.5 if enc.dialect == "v1" else enc.exponent_weight
            _spread(m, position, 1 - w, enc.dialect)
            np.add.at(m, (rows, _cell(exponent, length, enc.dialect)), w)
    elif enc.numeric == "smooth":
        part = n - np.trunc(n)
        np.add.at(m, (rows, _cell(n, length, enc.dialect)), 1 - part)
        np.add.at(m, (rows, _cell(n + 1, length, enc.dialect)), part)
    else:
        m[rows, _cell(n, length, enc.dialect)] += 1
    return m


def _windows(texts: list[str]):
    """Runs of text slices of at most WINDOW_CHARS characters in total.

    Yields (first text number, slices, whether the first slice goes on from the
    run before).
    """
    run, size, first, goes_on = [], 0, 0, False
    for t, text in enumerate(texts):
        start = 0
        while True:
            piece = text[start : start + WINDOW_CHARS - size]
            run.append(piece)
            size += len(piece)
            start += len(piece)
            if size == WINDOW_CHARS:
                yield first, run, goes_on
                goes_on = start < len(text)
                run, size, first = [], 0, t if goes_on else t + 1
            if start == len(text):
                break
    if run:
        yield first, run, goes_on


def string_matrices(texts: list[str], lengths, enc: Encoding) -> list[np.ndarray]:
    """Vectors (before stretching) of non-empty strings, one matrix per length."""
    out = [np.zeros((len(texts), length)) for length in lengths]
    decay = enc.decay or 0.1
    keep, carry = 1 - decay, 0.0
    for first, run, goes_on in _windows(texts):
        sizes = np.array([len(p) for p in run])
        code = np.frombuffer("".join(run).encode("utf-32-le"), np.uint32).astype(np.float64)
        token = np.repeat(np.arange(len(run)), sizes)
        pos = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        opening = pos == 0
        if goes_on:
            opening[0] = False
        if enc.string == "decay":
            # running mean v = v*keep + code*decay, restarted at each text: a scan
            # by doubling, finished once older characters weigh nothing
            value = np.where(opening, code, decay * code)
            if goes_on:
                value[0] += keep * carry
            step = 1
            while step <= pos.max(initial=0) and keep**step > 1e-20:
                value[step:] += np.where(pos[step:] >= step, keep**step * value[:-step], 0.0)
                step *= 2
            carry = value[-1]
        else:
            value = code.copy()
            value[1:] += np.where(pos[1:] > 0, code[:-1], 0.0)
            if goes_on:
                value[0] += carry
            carry = code[-1]
        for m, length in zip(out, lengths):
            at = np.where(opening, code, value * length / 10.0 if enc.string == "decay" else value)
            low = np.floor(at)
            part = at - low
            flat = token * length
            cells = np.bincount(flat + (low % length).astype(np.int64), 1 - part, len(run) * length)
            cells += np.bincount(
                flat + ((low + 1) % length).astype(np.int64), part, len(run) * length
            )
            m[first : first + len(run)] += cells.reshape(len(run), length)
    return out


def token_matrices(tokens: pa.Array, lengths, enc: Encoding) -> list[np.ndarray]:
    """Unit vectors of distinct tokens, one (tokens x L) matrix per length."""
    kind = pc.utf8_slice_codeunits(tokens, 0, 1).to_numpy(zero_copy_only=False)
    text = pc.utf8_slice_codeunits(tokens, 1)
    is_string = kind == "s"
    is_number = np.isin(kind, ["i", "f"])
    if enc.text_numbers:
        looks = pc.match_substring_regex(text, enc.number_pattern)
        is_number = is_number | (is_string & looks.to_numpy(zero_copy_only=False))
    values = text.to_numpy(zero_copy_only=False)
    number = np.zeros(len(tokens))
    number[is_number] = [float(t) for t in values[is_number]]
    number[kind == "b"] = (values[kind == "b"] == "true").astype(float)
    is_number = is_number | (kind == "b")
    finite = is_number & np.isfinite(number) & (number != 0)
    letters = is_string & ~is_number & (values != "")
    # tokens without content of their own fall on cell 0
    first_cell = is_number & ~np.isfinite(number)
    if enc.dialect == "v2":
        first_cell |= (kind == "u") | (is_string & (values == ""))
        first_cell |= is_string & is_number & (number == 0) & (values != "0")
    strings = string_matrices(values[letters].tolist(), lengths, enc)
    out = []
    for length, m_text in zip(lengths, strings):
        m = np.zeros((len(tokens), length))
        m[finite] = number_matrix(number[finite], length, enc)
        m[letters] = m_text
        m[first_cell, 0] = 1.0
        out.append(stretch(m, enc.dialect))
    return out


def combine_rows(a, b, c, enc: Encoding) -> np.ndarray:
    """One vector per statement out of its base, key and value vectors."""
    if enc.combine == "average":
        return (a + np.roll(b, -1, axis=1) + np.roll(c, -2, axis=1)) / 3
    return stretch(np.cbrt(_wave(a, 1) * _wave(b, 2) * _wave(c, 3)) - 1, "v1")


def _wave(m, k):
    return 1 + np.abs(m * np.cos(k * m))


def sum_statements(statements: pa.ListArray, lengths, enc: Encoding) -> list[np.ndarray]:
    """Per document the sum of its statement vectors: (documents x L) per length.

    ``statements`` holds a list of (base, key, cargo) token structs per document.
    """
    docs = len(statements)
    counts = pc.fill_null(pc.list_value_length(statements), 0).to_numpy(zero_copy_only=False)
    flat = statements.flatten()
    parts = [flat.field(i) for i in range(3)]
    coded = pa.concat_arrays(parts).dictionary_encode()
    picks = coded.indices.to_numpy(zero_copy_only=False).reshape(3, -1)
    doc = np.repeat(np.arange(docs), counts)
    out = []
    for m, length in zip(token_matrices(coded.dictionary, lengths, enc), lengths):
        if enc.combine == "product":
            waves = [_wave(m, k) for k in (1, 2, 3)]
        total = np.zeros((docs, length))
        block = max(1, WINDOW_CELLS // length)
        for lo in range(0, len(doc), block):
            a, b, c = picks[:, lo : lo + block]
            if enc.combine == "product":
                rows = np.cbrt(waves[0][a] * waves[1][b] * waves[2][c]) - 1
                rows = stretch(rows, "v1")
            else:
                rows = combine_rows(m[a], m[b], m[c], enc)
            here = doc[lo : lo + block]
            starts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            total[here[starts]] += np.add.reduceat(rows, starts, axis=0)
        out.append(total)
    return out


def _rows_to_arrow(m: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(m.reshape(-1)))


def token_vector(token: Column, length: int, enc: Encoding) -> Column:
    """ARRAY<DOUBLE> of one token; repeats within a batch are computed once."""

    @F.arrow_udf("array<double>")
    def vector(t: pa.Array) -> pa.Array:
        coded = t.dictionary_encode()
        (m,) = token_matrices(coded.dictionary, [length], enc)
        return _rows_to_arrow(m[coded.indices.to_numpy(zero_copy_only=False)])

    return vector(token)


def combined(a: Column, b: Column, c: Column, enc: Encoding) -> Column:
    """ARRAY<DOUBLE> of one statement, of its base, key and value vectors."""

    @F.arrow_udf("array<double>")
    def combine(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        shape = (len(x), -1)
        m = [v.flatten().to_numpy(zero_copy_only=False).reshape(shape) for v in (x, y, z)]
        return _rows_to_arrow(combine_rows(*m, enc))

    return combine(a, b, c)


def statement_sum(statements: Column, lengths, enc: Encoding) -> Column:
    """ARRAY<ARRAY<DOUBLE>>: for each length the summed vector of one document."""
    lengths = [int(n) for n in lengths]

    @F.arrow_udf("array<array<double>>")
    def total(s: pa.Array) -> pa.Array:
        sums = sum_statements(s, lengths, enc)
        joined = _rows_to_arrow(np.concatenate(sums, axis=1)).flatten()
        ends = np.cumsum([0] + lengths * len(s)).astype(np.int32)
        inner = pa.ListArray.from_arrays(pa.array(ends), joined)
        outer = np.arange(len(s) + 1, dtype=np.int32) * len(lengths)
        return pa.ListArray.from_arrays(pa.array(outer), inner)

    return total(statements)
