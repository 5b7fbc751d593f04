"""JSON sources.  Every source ends in ``(doc_id STRING, body VARIANT)``."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import computed_once, file_stem, let, sanitize_id

# A private-use character that closes the wrapped text in ``strict_json``.
_END = ""


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else NULL.

    ``try_parse_json`` ignores whatever follows the first value, so the text is
    parsed as the first of two array items and the second must turn up in place.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    keyed = F.try_parse_json(F.concat(F.lit('{"d":'), text, F.lit("}"))).isNotNull()
    genuine = ~F.contains(text, F.lit(_END)) | keyed

    def first(items):
        closed = (F.size(items) == 2) & (F.get(items, F.lit(1)).try_cast("string") == _END)
        return F.when(closed & genuine, F.get(items, F.lit(0)))

    return let(pair.try_cast("array<variant>"), first)


# Fixed value: JSON texts that count as empty documents.
_BLANK = r'^\s*(?:\{\s*\}|\[\s*\]|""|false|null|-?0(?:\.0*)?(?:[eE][+-]?\d+)?)?\s*$'


def is_blank(text: Column) -> Column:
    """Is the document nothing at all: no text, {}, [], "", 0, false or null?"""
    return F.coalesce(text.rlike(_BLANK), F.lit(True))


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Let the last of several equal keys win instead of rejecting the document."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


#: Bytes up to which any JSON text fits a variant (128 MiB), however short its values.
SURE_BYTES = 40 << 20


def parse_documents(rows: DataFrame, text: str = "text", sure_bytes: int = SURE_BYTES) -> DataFrame:
    """Adds ``body`` and ``reason`` in place of ``text``.

    The reason is NULL, 'empty', 'invalid', or 'too large': no variant came out of a
    text of more than ``sure_bytes``, which may be valid all the same.
    """
    allow_duplicate_keys(rows.sparkSession)
    kept = [c for c in rows.columns if c != text]

    def judged(body):
        large = F.octet_length(text) > sure_bytes
        reason = (
            F.when(is_blank(F.col(text)), "empty")
            .when(body.isNull() & large, "too large")
            .when(body.isNull(), "invalid")
        )
        return F.struct(body.alias("body"), reason.alias("reason"))

    return computed_once(rows, kept, let(strict_json(F.col(text)), judged))


def valid_docs(parsed: DataFrame) -> DataFrame:
    """The documents without a reason against them; one that is too large ends the job."""
    message = F.lit("a JSON text is too large for one variant: split it, or use one object a line")
    kept = F.when(F.col("reason") == "too large", F.raise_error(message).cast("boolean")).otherwise(
        F.col("reason").isNull()
    )
    return parsed.where(kept).drop("reason")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).drop("body")


#: Reasons against a document.
REASONS = ("empty", "invalid", "too large", "no id")


class Checked(NamedTuple):
    """What a source holds: its documents, its rejects with a reason each, and how many
    of both there are.

    ``counts.get`` has ``documents`` and a number for each reason as soon as an action
    on ``docs`` has run; they are counted on the way, in the same pass.
    """

    docs: DataFrame
    rejects: DataFrame
    counts: Observation


def checked(parsed: DataFrame) -> Checked:
    """Parsed documents told apart; one that is too large is a reject here."""
    counts, reason = Observation(), F.col("reason")
    found = parsed.observe(
        counts, F.count_if(reason.isNull()).alias("documents"),
        *[F.count_if(reason == r).alias(r) for r in REASONS],
    )
    docs = found.where(reason.isNull()).select("doc_id", "body")
    return Checked(docs, rejects(parsed), counts)


def check_json_dir(spark: SparkSession, path, recursive: bool = False, only_json: bool = False) -> Checked:
    """``read_json_dir`` or ``read_json_tree`` with its rejects."""
    pattern = "*.json" if only_json else None
    return checked(parse_documents(whole_files(spark, path, "json", recursive, pattern)))


def documents_from(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Documents out of any table with an id and a JSON text column."""
    rows = rows.select(
        F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).alias("text")
    )
    return valid_docs(parse_documents(rows))


def field(body: Column, name: str) -> Column:
    """Text of a top-level field, NULL if absent."""
    return F.try_element_at(body.try_cast("map<string,variant>"), F.lit(name)).try_cast("string")


def drop_id_field(body: Column, name: str) -> Column:
    """Object without one top-level field; other values are passed on."""
    kept = F.map_filter(body.try_cast("map<string,variant>"), lambda k, _: k != name)
    return F.coalesce(F.to_variant_object(kept), body)


def require_id(docs: DataFrame, on_missing: str = "skip") -> DataFrame:
    """Entities without an id are skipped, or end the job under ``fail``."""
    if on_missing == "skip":
        return docs.where(F.col("doc_id").isNotNull())
    checked = F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("entity without id")))
    return docs.withColumn("doc_id", F.coalesce(F.col("doc_id"), checked.cast("string")))


def entities(bodies: DataFrame, id_field: str, on_missing: str = "skip") -> DataFrame:
    """Entities whose id is one of their own fields."""
    split = F.struct(
        field(F.col("body"), id_field).alias("doc_id"),
        drop_id_field(F.col("body"), id_field).alias("body"),
    )
    docs = require_id(computed_once(bodies, [], split), on_missing)
    return docs.withColumn("doc_id", sanitize_id(F.col("doc_id")))


# --- files --------------------------------------------------------------------


def _plain_path(file_path: Column) -> Column:
    return F.url_decode(F.regexp_replace(file_path, r"\+", "%2B"))


def whole_files(
    spark: SparkSession, path, extension: str, recursive: bool = False, pattern: str | None = None
) -> DataFrame:
    """``(doc_id, text)``, a row per file; gz and bz2 files are unpacked.

    The id is the file name, or with ``recursive`` the path below ``path``, without
    its extension.
    """
    found = spark.read.text(
        path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=pattern
    )
    files = found.select("_metadata.file_path", F.col("value").alias("text"))
    name = _plain_path(F.col("file_path"))
    if recursive:
        below = str(path).rstrip("/").removeprefix("file:") + "/"
        name = F.substring_index(name, below, -1)
    else:
        name = F.substring_index(name, "/", -1)
    return files.select(file_stem(name, extension).alias("doc_id"), "text")


def read_json_dir(spark: SparkSession, path, only_json: bool = False) -> DataFrame:
    """One document per file.  ``only_json`` restricts to ``*.json`` (v1)."""
    files = whole_files(spark, path, "json", pattern="*.json" if only_json else None)
    return valid_docs(parse_documents(files))


def read_json_tree(spark: SparkSession, path) -> DataFrame:
    """One document per file, sub-directories included."""
    return valid_docs(parse_documents(whole_files(spark, path, "json", recursive=True)))


def read_json_parts(spark: SparkSession, path) -> DataFrame:
    """Documents of files that each hold one JSON object, however large, in parts.

    A part has some of the top-level entries, each of which has to fit a variant, and the
    id of its file.  The statements of a document are those of its parts, and its
    fingerprint is their sum (``fingerprint_parts``), as nothing in a fingerprint refers
    to the document as a whole.  A key should occur once: equal keys in different parts
    all count.
    """
    from .entity_files import parsed_entities

    values = valid_docs(parsed_entities(spark, path, "{"))
    name = file_stem(F.substring_index(_plain_path(F.col("file")), "/", -1), "json")
    # without the filler that stands before the entries of a part
    return values.select(name.alias("doc_id"), drop_id_field(F.col("body"), "").alias("body"))


def read_json_array(spark: SparkSession, path, id_field: str) -> DataFrame:
    """Entities of files that each hold one array of objects, however large."""
    from .entity_files import parsed_entities

    values = valid_docs(parsed_entities(spark, path, "["))
    items = F.expr("slice(try_cast(body as array<variant>), 2, size(try_cast(body as array<variant>)))")
    return entities(values.select(F.explode(items).alias("body")), id_field)


def read_json_map(spark: SparkSession, path) -> DataFrame:
    """Entities of files that each hold one object, however large; its keys are the
    ids, and of equal keys in a file the last one counts."""
    from .entity_files import parsed_entities

    values = valid_docs(parsed_entities(spark, path, "{"))
    pairs = values.select(
        "file", "no", F.explode(F.col("body").try_cast("map<string,variant>")).alias("doc_id", "body")
    )
    pairs = pairs.where(F.col("doc_id") != "")
    last = pairs.groupBy("file", "doc_id").agg(F.max_by("body", "no").alias("body"))
    last = last.where(~F.is_variant_null("body"))
    return last.select(sanitize_id(F.col("doc_id")).alias("doc_id"), "body")


def json_lines(lines: DataFrame, id_field: str) -> DataFrame:
    """Entities of text lines (column ``value``), batch or stream."""
    allow_duplicate_keys(lines.sparkSession)
    objects = lines.where(F.col("value").rlike(r"^\s*\{"))
    text = F.regexp_replace("value", ",$", "")
    parsed = computed_once(objects, [], F.struct(strict_json(text).alias("body")))
    return entities(parsed.where(F.col("body").isNotNull()), id_field)


# Fixed value: lines of an array wrapped around the objects, which hold no entity.
_WRAPPING = r"^[\s\[\],]*$"


def parsed_entity(rows: DataFrame, body: Column, id_field: str, text: str, sure_bytes: int = SURE_BYTES) -> DataFrame:
    """``doc_id, body, reason`` and the ``text`` of each reject, in place of ``text``."""
    kept = [c for c in rows.columns if c != text]
    found = computed_once(rows, [*kept, text], F.struct(body.alias("_body")))
    key, large = field(F.col("_body"), id_field), F.octet_length(text) > sure_bytes
    reason = (
        F.when(F.col("_body").isNull() & large, "too large")
        .when(F.col("_body").isNull(), "invalid").when(key.isNull(), "no id")
    )
    parts = F.struct(
        sanitize_id(key).alias("doc_id"), drop_id_field(F.col("_body"), id_field).alias("body"),
        reason.alias("reason"), F.when(reason.isNotNull(), F.col(text)).alias("text"),
    )
    return computed_once(found, kept, parts)


def parsed_lines(lines: DataFrame, id_field: str) -> DataFrame:
    """``doc_id, body, reason, text`` of text lines (column ``value``): the text is kept
    of a line that is no JSON object, or one without an id.  Blank lines, and brackets
    and commas on lines of their own, are no entities."""
    allow_duplicate_keys(lines.sparkSession)
    rows = lines.where(~F.col("value").rlike(_WRAPPING))
    body = F.when(F.col("value").rlike(r"^\s*\{"), strict_json(F.regexp_replace("value", ",$", "")))
    return parsed_entity(rows, body, id_field, "value")


def check_json_lines(spark: SparkSession, path, id_field: str) -> Checked:
    """``read_json_lines`` with its rejects, which come with their ``file``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return checked(parsed_lines(lines, id_field))


def read_json_lines(spark: SparkSession, path, id_field: str) -> DataFrame:
    """Entities of files with one object per line, also if wrapped as an array."""
    return json_lines(spark.read.text(path), id_field)


def sorted_ids(docs: DataFrame) -> DataFrame:
    return docs.orderBy("doc_id")
