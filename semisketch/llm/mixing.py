"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled within their source by a digest of the id and pass in rounds. A
copy's virtual finish time is the number of words its source has sent up to its end over
the source's target, so at any time all sources stand at the same share of their targets.
All copies are sorted by that time in ranges over the cluster, and the mix ends where
their words reach the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import cut, n_words, stored

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: Documents that share one running sum; a source of any size is dealt over many.
BUCKET_ROWS = 4096


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: int = MOST
) -> DataFrame:
    """Words to take from each source: ``(source, source_size)`` gets ``target``.

    Sources in code point order, null last, take the weights in turn and share
    ``budget`` times all words. No target exceeds ``most`` times its source's words;
    what is above goes to the others by weight, until none is above. Each round of that
    is one aggregate over the sources, which are numbered by ranges, so there may be any
    number of them. One row per source; no source, no row.
    """
    order = [F.col("source").asc_nulls_last()]
    rows = numbered(sizes, order, "turn")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights)).cast("int") + 1)
    rows = cut(rows.withColumn("weight", weight).withColumn("full", most * F.col("source_size")).drop("turn"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, filled = 0.0, -1
    while True:
        full = F.col("full") <= F.col("weight") * level
        held = rows.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("full"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if held[0] == filled or held[2] is None:
            break
        filled, level = held[0], (budget * total - held[1]) / held[2]
    goal = F.least(F.col("weight") * level, F.col("full").cast("double"))
    if held[2] is None:
        goal = F.col("full").cast("double")
    return rows.select("source", "source_size", goal.alias("target"))


def _copy_key(turn: Column | int) -> Column:
    """The place of a copy in the queue: its finish time, then what tells copies apart."""
    sent = turn * F.col("source_size") + F.col("before") + F.col("size")
    finish = sent / F.nullif(F.col("target"), F.lit(0.0))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return F.struct(finish.alias("finish"), "ticket", number.alias("number"), "size", "key", F.lit(turn).cast("int").alias("turn") if isinstance(turn, int) else turn.alias("turn"))


def schedule(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: int = MOST,
    seed: str = "",
) -> DataFrame:
    """Give every document its place in the mix.

    Takes ``(doc_id, source, text)`` and other columns, which stay in the struct
    ``row``; returns ``row, doc_id, size, source_size, target, before, taken, finish``.
    Within a source, documents are shuffled by the MD5 of ``seed`` and id (ties: by id,
    null first, then size), and pass in rounds: a document's r-th copy has the virtual
    finish time ``(r * source_size + before + size) / target`` where ``before`` counts
    the words ahead of it in its source, and r is below ``most``. In the order of finish
    times (ties: by MD5, id, size, source) copies are taken as long as their words do
    not exceed ``budget`` times all words, so whole documents are taken. ``taken`` counts
    words, repeats included, ``finish`` is the first copy's time (null if the target is
    0). ``before`` is a sum over hash ranges of a source and one within the range, so a
    source with a third of all rows is many groups; one copy's place in the queue, the
    last one taken, reaches the driver. Null texts and empty ones have size 0 and are
    taken 0 words. Repeated rows are documents of their own. An empty table gives an
    empty one.
    """
    ticket = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # a key that is never null, so that sums within it and the join need one partitioning
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = docs.select(
        "doc_id", key.alias("key"), n_words(F.col("text")).alias("size"), ticket.alias("ticket"),
        F.struct(*docs.columns).alias("row"),
    )
    slim = stored(rows.drop("row"))
    per_source = slim.groupBy("key").agg(F.sum("size").alias("source_size"))
    name = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30))
    goals = targets(per_source.select(name.alias("source"), "source_size"), weights, budget, most)
    goals = goals.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    count, words = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(16, -(-count // BUCKET_ROWS))
    place = F.conv(F.substring("ticket", 1, 8), 16, 10).cast("long")
    bucket = F.floor(place * buckets / 2**32).cast("long")
    sums = slim.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("ahead", F.sum("words").over(ahead) - F.col("words"))
    sums = cut(sums.join(goals, "key").select("key", "bucket", "ahead", "source_size", "target"))

    def placed(found: DataFrame) -> DataFrame:
        inside = Window.partitionBy("key", "bucket").orderBy("ticket", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("bucket", bucket).withColumn("within", F.sum("size").over(inside) - F.col("size"))
        found = found.join(sums, ["key", "bucket"])
        return found.withColumn("before", F.col("ahead") + F.col("within"))

    turns = F.explode(F.array(*[F.lit(r) for r in range(most)])).alias("turn")
    copies = placed(slim).filter("size > 0 and target > 0").select("*", turns)
    copies = copies.select(_copy_key(F.col("turn")).alias("place"), "size")
    queue = numbered(copies, ["place"], "ahead", "size")
    limit = min(budget, most) * words
    last = queue.filter(F.col("ahead") + F.col("size") <= limit).agg(F.max("place").alias("last"))
    end = last.first()["last"]
    taken = F.lit(0)
    if end is not None:
        kinds = ("double", "string", "long", "long", "string", "int")
        end = F.struct(*[F.lit(v).cast(k).alias(c) for (c, v), k in zip(end.asDict().items(), kinds, strict=True)])
        taken = sum(F.when(_copy_key(r) <= end, 1).otherwise(0) for r in range(most))
    finish = (F.col("before") + F.col("size")) / F.nullif(F.col("target"), F.lit(0.0))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("size") * taken).otherwise(0).cast("long")
    return placed(rows).select("row", "doc_id", "size", "source_size", "target", "before", taken.alias("taken"), finish.alias("finish"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for every copy taken, in order of virtual finish time.

    The columns are those of ``docs``. Empty documents, which take no words, go.
    """
    rows = schedule(docs, **options).filter("taken > 0")
    turns = F.explode(F.sequence(F.lit(0), (F.col("taken") / F.col("size") - 1).cast("int"))).alias("turn")
    copies = rows.select("row", (F.col("source_size") / F.col("target")).alias("lap"), "finish", turns)
    time = F.col("finish") + F.col("turn") * F.col("lap")
    copies = copies.select("row", time.alias("time"), F.col("row.doc_id").alias("doc_id"))
    return copies.repartitionByRange("time", "doc_id").sortWithinPartitions("time", "doc_id").select("row.*")
