"""What several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder, scratch_folder

#: The white space of the contracts and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A text's UTF-8 bytes with A-Z lower-cased, and the same with every other ASCII sign
#: that is no letter or digit as a blank; ``bytes.split`` then cuts at ASCII blanks alone.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALPHANUMERIC = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWERED)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def slices(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters; a longer text is a run of its own."""
    at = now = 0
    for n, text in enumerate(texts):
        if now and now + len(text) > size:
            yield at, n
            at, now = n, 0
        now += len(text)
    if at < len(texts):
        yield at, len(texts)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    if checkpoint_folder(df.sparkSession) is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return df.checkpoint()


def text_bytes(text: Column) -> Column:
    """A text as UTF-8 bytes, none for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def stored(df: DataFrame) -> DataFrame:
    """Write rows as Parquet to the shared folder and read them back.

    For wide intermediate tables that are read more than once: compressed, read by
    column, and there after any executor is lost.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id is not in the column ``doc_id`` of ``gone``, with all their
    columns, whatever their names."""
    kept = docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def sampled(rows: DataFrame, key: str, most: int, texts: DataFrame, chars: int) -> DataFrame:
    """``(doc_id, key, text)`` of at most ``most`` rows of each value of ``key``, by order
    of a hash of the id, with at most ``chars`` characters of text.

    ``rows`` has ``doc_id`` and the key, ``texts`` ``doc_id`` and ``text``. However often
    an id repeats, no more rows come out; a value that most rows have is cut down in
    parts first.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = lambda found, *by: found.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("turn") <= most).drop("turn")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    chosen = first(first(rows.select("doc_id", key).distinct().withColumn("part", part), key, "part"), key).drop("part")
    # at most so many rows a value, where those are few
    held = texts.select("doc_id", F.substring("text", 1, chars).alias("text")).join(F.broadcast(chosen), "doc_id")
    order.append(F.xxhash64("text"))
    return first(first(held.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(64))), key, "part"), key).select("doc_id", key, "text")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links ``(a, b)``: ``(id, component_id)``.

    ``component_id`` is the smallest id of the component. Ids without a link to
    another id have no row; links with a null end are left out; an empty table gives
    an empty one. Alternating star contraction: every round links a node's larger
    neighbours, then its smaller ones, to the smallest neighbour, until only stars are
    left. Rounds grow with the logarithm of a component's diameter. Rows stay links;
    no neighbourhood is gathered, and a hub is a skewed join key that adaptive
    execution splits.
    """
    now = cut(
        edges.filter("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    state = _links_state(now)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi").select(F.explode(F.array(
                F.struct(F.col("hi"), F.col("m").alias("lo")),
                F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
            )).alias("e")).select("e.*").filter("hi != lo").distinct()
        )
        now = cut(small)
        before, state = state, _links_state(now)
        if state == before:
            break
    roots = now.select(F.col("lo").alias("id"), F.col("lo").alias("component_id")).distinct()
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component_id")).union(roots)


def _links_state(links: DataFrame):
    """Number of links and an order-free hash sum: equal only if nothing changed."""
    return links.agg(
        F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))
    ).first()
