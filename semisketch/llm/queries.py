"""The registered queries of this folder: each applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from . import ann, embedding_dedup, jaccard_join, language_id, lexical_search, license_scan, line_dedup, minhash, mixing, packing, resampling, sql, token_counts, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register(sql.LINE_DEDUP)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    index = line_dedup.LineIndex(scratch_folder(spark)).insert(docs)
    return index.cleaned(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@register(sql.license_scan())
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"), license_scan.known_licenses(spark))


@register(sql.planted_licenses())
def license_scan_planted(spark: SparkSession, folder: str) -> DataFrame:
    """The same operator where every tenth document is a licence in another spelling."""
    docs = table(spark, folder, "documents")
    texts = F.array(*[F.lit(t) for _, t in license_scan.KNOWN])
    text = F.get(texts, (F.floor(F.col("doc_id") / 10) % len(license_scan.KNOWN)).cast("int"))
    spelt = F.concat(F.lit("Copyright (c) 2020 Someone\n"), F.replace(F.upper(text), F.lit(", "), F.lit(" ; ")))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, spelt).otherwise(F.col("text")))
    return license_scan.scan(docs, license_scan.known_licenses(spark))


@register()
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, folder, "documents"), path)


@register(sql.MIXING)
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.schedule(table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@register()
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(table(spark, folder, "documents"), path)


@register(sql.JACCARD)
def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, folder, "documents"))


@register(sql.NEAREST)
def op4_ann(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return ann.search(rows, rows.filter(F.col("vec_id") % 20 == 0))


@register(sql.NEAR_VECTORS)
def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


@register()
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@register()
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.train(docs.filter(~toxicity.held_out()))
    found = language_id.identify(language_id.evidence_of_documents(docs), model)
    return found.withColumn("held_out", toxicity.held_out())


@register()
def language_id_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same operator over web pages, with all its kinds of evidence."""
    model = language_id.train(table(spark, folder, "documents"))
    pages = language_id.evidence_of_pages(table(spark, folder, "pages"))
    return language_id.identify(pages, model).withColumnRenamed("doc_id", "page_id")


@register(sql.RANKED_SEARCH)
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register(sql.RESAMPLING)
def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register()
def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.edit_comparison(table(spark, folder, "documents"))
