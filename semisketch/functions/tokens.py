"""Tokens and ids as column expressions.

A token carries the JSON type it had, as a letter before its text:

====== =====================================
letter meaning
====== =====================================
``s``  string
``i``  whole number (also counts and indexes)
``f``  number with a fraction or exponent
``b``  true / false
``u``  null or undefined
``l``  opaque list (row mode only)
====== =====================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Encoding

ZERO = "i0"
UNDEFINED = "u"

# A length no text exceeds.
_REST = (1 << 31) - 1


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once and not copied."""
    nothing = F.array().cast("array<int>")
    return F.aggregate(nothing, value, lambda held, _: held, body)


def pick(condition: Column, yes: Column, no: Column) -> Column:
    """``when`` with one condition, as the plain ``if`` that costs less where it is interpreted."""
    return F.call_function("if", condition, yes, no)


def computed_once(rows: DataFrame, kept: list[str], struct: Column) -> DataFrame:
    """``rows`` with the fields of a costly struct expression as columns.

    The struct goes through a generator of one row, so a later filter on one of its
    fields is not pushed below it, which would compute it a second time.
    """
    return rows.select(*kept, F.inline(F.array(struct)))


def joined(first: Column, second: Column) -> Column:
    """Two arrays as one; see ``lettered`` for why not ``concat``."""
    return F.flatten(F.array(first, second))


def lettered(letter: Column, text: Column) -> Column:
    """Text behind a type letter, padded to one character more: ``concat`` makes a lazy
    list for each call where it is interpreted."""
    return F.lpad(text, F.length(text) + 1, letter)


def string_token(text: Column) -> Column:
    return lettered(F.lit("s"), text)


def count_token(n: Column) -> Column:
    return lettered(F.lit("i"), n.cast("string"))


def token_type(token: Column) -> Column:
    return F.substring(token, 1, 1)


def token_text(token: Column) -> Column:
    """Text of a token; NULL for null and undefined."""
    return F.when(~token.startswith(UNDEFINED), F.substring(token, 2, _REST))


# Characters of quoted text that are escaped, and their escapes.
_ESCAPES = (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def escaped(text: Column) -> Column:
    """Text without quotes, tabs or line ends of its own."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, escape in _ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(escape))
    return out


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given."""

    def plain(part):
        for char, escape in _ESCAPES:
            part = F.replace(part, F.lit(escape), F.lit(char))
        return part

    # between two escaped backslashes no backslash stands for itself
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def quoted(token: Column, lossless: bool = False) -> Column:
    """Triple-file form: whole numbers and booleans bare, all else in quotes."""
    kind, text = token_type(token), token.substr(F.lit(2), F.length(token))
    text = escaped(text) if lossless else text
    return (
        F.when(kind == "i", text)
        .when(kind == "b", F.initcap(text))
        .when(kind == "u", F.lit('"None"'))
        .otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    )


def is_number(token: Column, enc: Encoding) -> Column:
    """Does the token count as a number?"""
    kind = token_type(token)
    looks = token.substr(F.lit(2), F.length(token)).rlike(enc.number_pattern)
    as_text = (kind == "s") & looks if enc.text_numbers else F.lit(False)
    return kind.isin("i", "f", "b") | as_text


def number_value(token: Column, enc: Encoding) -> Column:
    """DOUBLE value of a numeric token, NULL otherwise; booleans are 1 and 0."""
    text = token.substr(F.lit(2), F.length(token))
    value = F.when(token_type(token) == "b", (text == "true").cast("double")).otherwise(
        F.trim(text).try_cast("double")
    )
    return F.when(is_number(token, enc), value)


# Fixed value: characters an id may keep.
_ID_CHARS = r"[^A-Za-z0-9_.\-=,+*:;@^`|~]+"


def sanitize_id(text: Column) -> Column:
    return F.regexp_replace(text, _ID_CHARS, "")


def file_stem(name: Column, extension: str) -> Column:
    """File name without compression suffix and without ``extension``."""
    plain = F.regexp_replace(name, r"\.(gz|bz2)$", "")
    return F.regexp_replace(plain, rf"\.{extension}$", "")
