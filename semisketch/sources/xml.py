"""XML sources.  Documents come out in the same form as JSON ones.

Attributes and child elements become fields, repeated elements arrays, the root
element's name is dropped, text beside attributes is the field ``content`` and an
element without anything in it is an empty object.  All values are strings, as XML
has no other type.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import computed_once, let
from ..session import materialize
from .documents import Checked, checked, entities, parsed_entity, whole_files
from .xml_scan import record_texts

# A private-use character put before every text, so that the parser takes none of
# them for a number, a boolean or a null; it is taken out again afterwards.
_MARK = "\ue000"
# Where the mark occurs in the data it is written as two characters, as is this one.
_ESCAPE = "\ue001"

_BROKEN = "_broken"
_GUARD = {"columnNameOfCorruptRecord": _BROKEN, "mode": "PERMISSIVE"}
_OPTIONS = {"attributePrefix": "", "valueTag": "content", "ignoreSurroundingSpaces": "false"}


# Comments, instructions, literal sections, tags and the text between them.
_LEXEMES = (
    r"(?s)<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>"
    r"|<[^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*>|[^<]+|<"
)
_UNUSUAL = r"""<[!?]|=\s*(?:"[^"<]*>|'[^'<]*>)"""


def _plain(text: Column) -> Column:
    """The same element without comments and instructions, with literal sections as
    escaped text and no ``>`` inside attributes."""

    def rewritten(part):
        literal = F.substring(part, 10, F.length(part) - 12)
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            literal = F.replace(literal, F.lit(char), F.lit(name))
        return (
            F.when(part.startswith("<!--") | part.startswith("<?"), "")
            .when(part.startswith("<![CDATA[") & part.endswith("]]>"), literal)
            .when(part.startswith("<"), F.regexp_replace(part, r">(?=[\s\S])", "&gt;"))
            .otherwise(part)
        )

    parts = F.regexp_extract_all(text, F.lit(_LEXEMES), F.lit(0))
    lexed = F.array_join(F.transform(parts, rewritten), "")
    return F.when(text.rlike(_UNUSUAL), lexed).otherwise(text)


def _escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit(_ESCAPE), F.lit(f"{_ESCAPE}b"))
    doubled = F.regexp_replace(doubled, "(?i)&#(?:x0*e001|0*57345);", f"{_ESCAPE}b")
    return F.regexp_replace(doubled, f"(?i){_MARK}|&#(?:x0*e000|0*57344);", f"{_ESCAPE}a")


def _unescaped(text: Column) -> Column:
    single = F.replace(text, F.lit(f"{_ESCAPE}a"), F.lit(_MARK))
    return F.replace(single, F.lit(f"{_ESCAPE}b"), F.lit(_ESCAPE))


def xml_body(text: Column) -> Column:
    """VARIANT of one XML element, NULL if it cannot be parsed."""
    marked = F.regexp_replace(_escaped(_plain(text)), r"<([\w:.\-]+)((?:\s[^<>]*)?)/>", "<$1$2></$1>")
    marked = F.regexp_replace(marked, r"(<[\w:.\-]+(?:\s[^<>]*)?>)(</)", f"$1{_MARK}$2")
    marked = F.regexp_replace(marked, r">([^<]*[^<\s][^<]*)(?=<)", f">{_MARK}$1")
    marked = F.regexp_replace(marked, r"(\s[\w:.\-]+\s*=\s*[\"'])", f"$1{_MARK}")
    # inside a lambda the parser runs interpreted; its generated code does not compile
    parsed = let(
        marked,
        lambda t: F.when(
            F.from_xml(t, F.lit(f"struct<{_BROKEN}:string>"), _GUARD)[_BROKEN].isNull(),
            F.from_xml(t, F.lit("variant"), _OPTIONS),
        ),
    )
    json = F.to_json(parsed)
    json = F.regexp_replace(json, rf'"content":"{_MARK}{_MARK}?"', f'"{_MARK}":0')
    json = F.regexp_replace(json, rf'"{_MARK}{_MARK}?"(?!:)', "{}")
    json = F.regexp_replace(json, rf'"{_MARK}":0,|,?"{_MARK}":0', "")
    return F.try_parse_json(_unescaped(F.translate(json, _MARK, "")))


def parsed_xml(files: DataFrame) -> DataFrame:
    """``doc_id, body, reason`` of ``doc_id, text``."""
    docs = computed_once(files, ["doc_id"], F.struct(xml_body(F.col("text")).alias("body")))
    return docs.withColumn("reason", F.when(F.col("body").isNull(), "invalid"))


def read_xml_dir(spark: SparkSession, path, recursive: bool = False) -> DataFrame:
    """One document per file; files that cannot be parsed are left out."""
    parsed = parsed_xml(whole_files(spark, path, "xml", recursive=recursive))
    return parsed.where(F.col("reason").isNull()).drop("reason")


def check_xml_dir(spark: SparkSession, path, recursive: bool = False) -> Checked:
    """``read_xml_dir`` with its rejects."""
    return checked(parsed_xml(whole_files(spark, path, "xml", recursive=recursive)))


def read_xml_tree(spark: SparkSession, path) -> DataFrame:
    return read_xml_dir(spark, path, recursive=True)


def read_xml_records(
    spark: SparkSession, path, row_tag: str, id_field: str, on_missing: str = "fail"
) -> DataFrame:
    """Entities of files with repeated ``row_tag`` elements, however large the files.

    Records are the outermost elements of that name.  Files are read by many tasks
    (``xml_scan``); records that cannot be parsed are left out.
    """
    rows = record_texts(spark, path, row_tag).where("text is not null").select("text")
    bodies = computed_once(rows, [], F.struct(xml_body(F.col("text")).alias("body")))
    return entities(bodies.where(F.col("body").isNotNull()), id_field, on_missing)


def check_xml_records(spark: SparkSession, path, row_tag: str, id_field: str) -> Checked:
    """``read_xml_records`` with its rejects, which come with their ``file``; a file that
    ends inside a record has one without a text.  Records are parsed once for both."""
    rows = record_texts(spark, path, row_tag)
    return checked(materialize(parsed_entity(rows, xml_body(F.col("text")), id_field, "text")))
