"""Language identification by Bayesian fusion of evidence.

The posterior of a language is the product of the text's likelihood, that of the
language its markup declares, and a prior of its host. Host priors come from counts of
what the texts alone say, by grouped aggregation, and are smoothed towards the address
suffix, which is smoothed towards all documents. A uniform model stands for text in no
known language; what it explains best is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled, stored, without_ids

#: Documents of each language, by order of a hash, that training reads at most.
TRAIN = 500
#: Characters that it reads of one document at most.
TRAIN_CHARS = 100_000
#: Hashed byte trigrams.
GRAMS = 1 << 16
#: Trigrams overlap and repeat: n of them weigh as much as n / (1 + n / WEIGHT).
WEIGHT = 100.0
#: Chance that markup declares the true language, pseudo-counts of the next wider
#: prior, and prior and least posterior of a language known.
DECLARED, PSEUDO, UNKNOWN, SURE = 0.9, 20.0, 1e-3, 0.5
SLICE = 1_000_000


def grams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text with blanks and digits as one mark."""
    return np.concatenate(list(gram_slices(text)))


def gram_slices(text: str) -> Iterator[np.ndarray]:
    """The trigrams of a text of any length, in runs of about SLICE of them; the last two
    bytes of a run begin the next."""
    text, last = f" {text.lower()} ", np.zeros(0, np.uint8)
    for at in range(0, len(text), SLICE):
        data = _FOLD[np.frombuffer(text[at : at + SLICE].encode("utf-8", "surrogatepass"), np.uint8)]
        data = np.concatenate([last, data])
        data = data[np.r_[True, (data[1:] != 32) | (data[:-1] != 32)]]
        last = data[-2:]
        wide = data.astype(np.uint32)
        code = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
        yield ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [b if 97 <= b <= 122 else 32 for b in range(128)]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of trigrams, a uniform row for none last.

    ``docs`` has ``doc_id, text, lang``; rows without a language take no part.
    """
    rows = docs.filter("lang is not null and doc_id is not null")
    sample = sampled(rows, "lang", TRAIN, rows, TRAIN_CHARS).toPandas()
    langs = sorted(set(sample["lang"]))
    counts = np.full((len(langs) + 1, GRAMS), 0.0)
    for lang, text in zip(sample["lang"], sample["text"], strict=True):
        counts[langs.index(lang)] += np.bincount(grams(text or ""), minlength=GRAMS)
    counts[-1] = 0.0
    smooth = counts + 0.1
    return langs, np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)


def evidence_of_documents(docs: DataFrame) -> DataFrame:
    """Plain documents: the source is the host, nothing is declared."""
    return docs.select("doc_id", "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("declared"))


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """Web pages ``(page_id, url, html)``: host and suffix of the address, the declared
    language of the markup, and the text between the tags."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    some = lambda c: F.when(c != "", c)
    return pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), some(host).alias("host"), some(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"), some(declared).alias("declared"))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``(doc_id, lang, confidence, kept)`` of every row.

    ``rows`` has ``doc_id, text, host, suffix, declared``. ``lang`` is the language with
    the largest posterior (ties: first by name) and ``confidence`` that posterior;
    where no language reaches SURE or the uniform model explains a text best, ``kept``
    is false and ``lang`` is ``und``. A null or empty text, or one without letters, is
    judged by what else is known and kept unless nothing is: with no text, no declared
    language and no host it is rejected. A declared language that is not known, a null
    host or suffix are no evidence. A host's counts leave out the row they are used for.
    Hosts are counted by partial aggregation and come back by a join that adaptive
    execution splits, so one host may have most rows. An empty table gives an empty one.
    """
    langs, table = model
    if not langs:
        return rows.select("doc_id", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<double>")
    def likelihoods(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by_gram = np.ascontiguousarray(shared.value.T).astype(np.float64)
        for texts in batches:
            out = []
            for text in texts:
                total, n = np.zeros(by_gram.shape[1]), 0
                for found in gram_slices(text):
                    total += by_gram[found].sum(0)
                    n += len(found)
                out.append(total / n * (n / (1 + n / WEIGHT)) if n else total)
            yield pd.Series(out)

    told = rows.select("doc_id", "host", "suffix", "declared", likelihoods(F.coalesce("text", F.lit(""))).alias("ll"))
    known = F.slice("ll", 1, len(langs))
    best = F.when(F.array_max("ll") > F.element_at("ll", -1), F.array_position(known, F.array_max(known)).cast("int"))
    told = stored(told.withColumn("best", best))
    # counts of a level, and the prior smoothed by the next wider one
    cols = [f"c{i}" for i in range(len(langs))]
    per_host = told.groupBy("host", "suffix").agg(*[F.sum((F.col("best") == i + 1).cast("long")).alias(c) for i, c in enumerate(cols)]).na.fill(0)
    sums = lambda df, *key: df.groupBy(*key).agg(*[F.sum(c).alias(c) for c in cols])
    whole = sums(per_host).select(*[F.coalesce(c, F.lit(0)).alias(f"g{i}") for i, c in enumerate(cols)])
    per_suffix = sums(per_host, "suffix").select("suffix", *[F.col(c).alias(f"s{i}") for i, c in enumerate(cols)])
    overall = whole.first()
    hosts = per_host.alias("h").join(per_suffix.alias("s"), F.expr("h.suffix <=> s.suffix")).select("h.*", *[f"s.s{i}" for i in range(len(langs))])
    rows = told.alias("t").join(hosts.alias("h"), F.expr("t.host <=> h.host and t.suffix <=> h.suffix"), "left").select("t.*", *[f"h.{c}" for c in cols], *[f"h.s{i}" for i in range(len(langs))])
    total = sum(overall)
    world = [(overall[i] + 1) / (total + len(langs)) for i in range(len(langs))]
    own = [F.when(F.col("best") == i + 1, 1).otherwise(0) for i in range(len(langs))]
    level = lambda name, known: [F.when(known, F.greatest(F.col(f"{name}{i}") - own[i], F.lit(0))).otherwise(0) for i in range(len(langs))]
    narrowed = lambda counts, wider: [(c + PSEUDO * w) / (_sum(counts) + PSEUDO) for c, w in zip(counts, wider, strict=True)]
    prior = narrowed(level("s", F.col("suffix").isNotNull()), [F.lit(w) for w in world])
    prior = narrowed(level("c", F.col("host").isNotNull()), prior)
    rows = rows.withColumn("prior", F.array(*prior))
    said = [
        F.when(F.col("declared").isin(langs), F.when(F.col("declared") == lang, DECLARED).otherwise((1 - DECLARED) / max(len(langs) - 1, 1))).otherwise(1.0)
        for lang in langs
    ]
    logs = [F.col("ll")[i] + F.log(F.col("prior")[i] * (1 - UNKNOWN)) + F.log(said[i]) for i in range(len(langs))]
    logs.append(F.col("ll")[len(langs)] + F.lit(float(np.log(UNKNOWN))))
    rows = rows.withColumn("logs", F.array(*logs)).withColumn("top", F.array_max("logs"))
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    first = F.array_position("logs", F.col("top")).cast("int")
    nothing = (F.array_max("ll") == 0) & F.col("host").isNull() & ~F.coalesce(F.col("declared").isin(langs), F.lit(False))
    kept = (1 / mass >= SURE) & (first <= len(langs)) | (F.array_max("ll") == 0)
    kept = F.coalesce(kept & ~nothing, F.lit(False))
    names = F.array(*[F.lit(x) for x in [*langs, "und"]])
    return rows.withColumn("kept", kept).select(
        "doc_id", F.when(F.col("kept"), F.element_at(names, first)).otherwise("und").alias("lang"), (1 / mass).alias("confidence"), "kept",
    )


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def in_known_language(docs: DataFrame) -> DataFrame:
    """Documents whose language is known, all columns as they were. Rows without an id
    stay; rows of one id go if one of them is rejected."""
    found = identify(evidence_of_documents(docs), train(docs))
    return without_ids(docs, found.filter("not kept and doc_id is not null"))
