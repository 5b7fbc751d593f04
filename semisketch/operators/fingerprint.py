"""Documents to fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.tokens import ZERO, computed_once
from ..functions.vectors import Encoding, combined, statement_sum, token_vector
from .structure import Shape, statements, vector_parts


def parse_lengths(lengths) -> list[int]:
    """Distinct lengths above 1, ascending, of a number, a list or '11, 13'."""
    if isinstance(lengths, int):
        lengths = [lengths]
    elif isinstance(lengths, str):
        lengths = re.split(r"[,\s]+", lengths)
    found = {int(x) for x in lengths if re.fullmatch(r"[0-9]+", str(x)) and int(x) > 1}
    if not found:
        raise ValueError(f"not a list of whole numbers above zero: {lengths!r}")
    return sorted(found)


def fingerprint(
    docs: DataFrame,
    lengths=(50,),
    dialect: str = "v2",
    numeric: str = "ME",
    string: str = "decay",
    decay: float = 0.1,
    exponent_weight: float = 0.5,
    combine: str | None = None,
    skip_nulls: bool = True,
    arrays_are_sets: bool = False,
    exclude_keys=(),
    normalize: bool = False,
    decimals: int | None = 3,
    side_by_side: bool = False,
) -> DataFrame:
    """``docs(doc_id, body)`` to ``(doc_id, L, statements, fp)``.

    One output row per input row and length; rows are independent of each other,
    so repeated ids stay apart and no data moves between partitions.  Under v2,
    documents without statements are left out.  With ``side_by_side``, one output row
    per input row, ``(doc_id, statements, fp)`` with the vectors of all lengths behind
    each other, ascending.
    """
    shape = Shape(
        dialect=dialect,
        skip_nulls=skip_nulls,
        arrays_are_sets=arrays_are_sets,
        exclude_keys=tuple(exclude_keys),
    )
    encoding = Encoding(
        dialect=dialect,
        numeric=numeric,
        string=string,
        decay=decay,
        exponent_weight=exponent_weight,
        combine=combine or ("average" if dialect == "v1" else "product"),
    )
    lengths = parse_lengths(lengths)
    sums = _sums(docs, lengths, shape, encoding)
    if dialect == "v2":
        sums = nonempty_fp(sums)
    if side_by_side:
        vectors = F.transform("sums", lambda v: arrays.zscore(v, dialect)) if normalize else F.col("sums")
        return finish(sums.select("doc_id", "statements", F.flatten(vectors).alias("fp")), dialect, False, decimals)
    return finish(_by_length(sums, lengths), dialect, normalize, decimals)


def fingerprint_parts(
    parts: DataFrame, lengths=(50,), normalize: bool = False, decimals: int | None = 3, **settings
) -> DataFrame:
    """``(doc_id, L, statements, fp)`` of documents that come in parts, rows of one id.

    Parts are vectorised where they lie and summed in partial aggregates; the other
    settings are those of ``fingerprint``.
    """
    lengths = parse_lengths(lengths)
    fps = fingerprint(parts, lengths, decimals=None, **settings)
    cells = F.array(*[F.sum(F.get("fp", F.lit(i))) for i in range(lengths[-1])])
    sums = fps.groupBy("doc_id", "L").agg(F.sum("statements").alias("statements"), cells.alias("fp"))
    sums = sums.withColumn("fp", F.slice("fp", F.lit(1), F.col("L")))
    return finish(sums, settings.get("dialect", "v2"), normalize, decimals)


def fingerprint_rows(docs: DataFrame, length: int = 50, decimals: int | None = 3) -> DataFrame:
    """Row mode: every top-level entry is an entity, strings are never numbers,
    arrays carry no content, vectors are always z-scored and zero ones left out."""
    shape = Shape(dialect="v1", flatten_singletons=False, open_arrays=False)
    encoding = Encoding(dialect="v1", combine="product", text_numbers=False)
    objects = docs.where(F.col("body").try_cast("map<string,variant>").isNotNull())
    out = nonzero_fp(_summed(objects, parse_lengths(length), shape, encoding))
    return finish(out, "v1", True, decimals)


def _summed(docs: DataFrame, lengths: list[int], shape: Shape, encoding: Encoding) -> DataFrame:
    return _by_length(_sums(docs, lengths, shape, encoding), lengths)


def _sums(docs: DataFrame, lengths: list[int], shape: Shape, encoding: Encoding) -> DataFrame:
    rows = computed_once(docs, ["doc_id"], F.struct(vector_parts(statements(shape)).alias("parts")))
    return rows.select(
        "doc_id",
        F.size("parts").cast("long").alias("statements"),
        statement_sum(F.col("parts"), lengths, encoding).alias("sums"),
    )


def _by_length(sums: DataFrame, lengths: list[int]) -> DataFrame:
    pairs = F.arrays_zip(F.array(*map(F.lit, lengths)).alias("L"), F.col("sums").alias("fp"))
    sums = sums.select("doc_id", "statements", F.inline(pairs).alias("L", "fp"))
    return sums.select("doc_id", "L", "statements", "fp")


def tokens_of(rows: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``(token)``: the distinct tokens of documents, or of a triple table.

    Distinct in partial aggregates, so a token in every row is no burden; of documents
    a token leaves its row once, however many statements have it.
    """
    if "body" in rows.columns:
        parts = vector_parts(statements(shape))
        every = F.flatten(F.transform(parts, lambda p: F.array(p["base"], p["key"], p["cargo"])))
        # once, as filters on what is exploded would walk again
        found = computed_once(rows, [], F.struct(F.array_distinct(every).alias("found")))
        return found.select(F.explode("found").alias("token")).distinct()
    return rows.select(F.explode(F.array("base", _key_token(), "cargo")).alias("token")).distinct()


def token_dim(
    rows: DataFrame, length: int, encoding: Encoding = Encoding(), shape: Shape = Shape()
) -> DataFrame:
    """``(token, vec)``: the distinct tokens of documents or triples with their vectors."""
    tokens = tokens_of(rows, shape)
    return tokens.select("token", token_vector(F.col("token"), length, encoding).alias("vec"))


def triple_vectors(triples: DataFrame, length: int, encoding: Encoding = Encoding()) -> DataFrame:
    """Triples with the vectors of their base, key and cargo.

    Vectors are computed next to the rows, a distinct token once per batch, rather
    than joined: a join on tokens would move every row three times and pile up on
    the common ones.
    """
    vector = {
        name: token_vector(token, length, encoding)
        for name, token in (
            ("base_vec", F.col("base")), ("key_vec", _key_token()), ("cargo_vec", F.col("cargo"))
        )
    }
    return triples.withColumns(vector)


def combine(rows: DataFrame, encoding: Encoding = Encoding()) -> DataFrame:
    """``vec`` of each statement out of ``base_vec``, ``key_vec`` and ``cargo_vec``."""
    parts = [F.col(c) for c in ("base_vec", "key_vec", "cargo_vec")]
    return rows.withColumn("vec", combined(*parts, encoding))


def _key_token():
    return F.when(F.col("kind") == "set", F.lit(ZERO)).otherwise(F.col("key"))


def finish(fps: DataFrame, dialect: str, normalize: bool, decimals: int | None) -> DataFrame:
    """Optional z-score, then rounding."""
    if normalize:
        fps = normalize_fp(fps, dialect)
    return fps if decimals is None else round_fp(fps, decimals)


def normalize_fp(fps: DataFrame, dialect: str = "v2") -> DataFrame:
    return fps.withColumn("fp", arrays.zscore(F.col("fp"), dialect))


def round_fp(fps: DataFrame, decimals: int = 3) -> DataFrame:
    return fps.withColumn("fp", arrays.round_cells(F.col("fp"), decimals))


def nonempty_fp(fps: DataFrame) -> DataFrame:
    return fps.where(F.col("statements") > 0)


def nonzero_fp(fps: DataFrame) -> DataFrame:
    return fps.where(F.exists("fp", lambda x: x != 0))


def joined_lengths(fps: DataFrame) -> DataFrame:
    """All lengths of one entity side by side, ascending, as in a text collection.

    Groups by id, so it needs unique ids; the lengths of an id are few.
    """
    parts = F.array_sort(F.collect_list(F.struct("L", "fp")))
    grouped = fps.groupBy("doc_id", "statements").agg(parts.alias("parts"))
    return grouped.select(
        "doc_id", "statements", F.flatten(F.transform("parts", lambda p: p["fp"])).alias("fp")
    )
