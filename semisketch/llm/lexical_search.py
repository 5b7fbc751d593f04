"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are cut into terms once; what is kept of each is its length and the counts of
the terms that any query has. Every task deals its documents to shards of a bounded
number of postings. A shard has one impact list for each query term, highest impact
first, with direct access from a document to its place in any list. A query reads its
lists side by side from the top, completes every document met by direct access and marks
the places so seen in all lists. The *best position* of a list is the last one up to
which every place is seen, which may lie far beyond the last one read; the impacts there
bound the score of every document not seen. Reading ends when that bound is strictly
below the k-th best score found, so equal scores are all seen. The k best of a task go
on from shard to shard, and the later shards start from their k-th score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ALPHANUMERIC, stored, text_bytes

TOP = 10
#: Texts of queries that are searched at a time; more of them are searched in blocks.
QUERY_BYTES = 16 << 20
#: Postings of a shard.
SHARD_POSTINGS = 1_000_000
#: Places read of each list in the first round; every round reads twice as many.
DEPTH = 16
#: Parts in which the results of a query are cut down before they meet.
SALTS = 64
POSTINGS = "doc_id long, n long, terms array<int>, tfs array<long>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(ALPHANUMERIC).split()


# --- documents to postings --------------------------------------------------------


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of the documents that have any term: their number of
    terms, and the counts of those in the vocabulary by ascending number. Whole texts
    are cut; rows stay in their partition."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}.get
        for batch in batches:
            ids, n, terms, tfs, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms_of(text.as_py())
                if not words:
                    continue
                held = Counter(map(number, words))
                held.pop(None, None)
                ids.append(doc_id)
                n.append(len(words))
                terms.extend(sorted(held))
                tfs.extend(held[t] for t in terms[ends[-1] :])
                ends.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind)) for v, kind in ((terms, pa.int32()), (tfs, pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text"))
    return rows.mapInArrow(count, POSTINGS)


def weights(found: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms and the weight of each of ``size`` terms: one row of sums
    and at most a row per query term reach the driver."""
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    for row in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[row.t] = row.df
    return n_docs, n_terms, np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


# --- one shard --------------------------------------------------------------------


class Shard:
    """Impact lists of some documents.

    ``n`` holds the lengths of the documents, ``ends`` where the postings of each end,
    ``terms`` and ``tfs`` the postings by document and term.
    """

    def __init__(self, n, ends, terms, tfs, n_docs: int, n_terms: int, weight: np.ndarray):
        doc = np.repeat(np.arange(len(n)), np.diff(np.r_[0, ends]))
        m = 100 - 75 + (75 * n * n_docs) // n_terms
        impact = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
        order = np.lexsort((doc, -impact, terms))
        self.size, self.width = len(n), len(weight)
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(self.width + 1))
        # direct access: places in the lists by (document, term)
        self.key = doc * self.width + terms
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores that hold the k best of those above 0 that reach
        ``floor``, ties included, and the number of documents seen."""
        begin, stop = self.starts[terms], self.starts[terms + 1]
        live = stop > begin
        terms, times, begin, stop = terms[live], times[live], begin[live], stop[live]
        seen = np.zeros(self.size, bool)
        marked = [np.zeros(n, bool) for n in stop - begin]
        reached = np.zeros(len(terms), np.int64)
        docs, scores, kth = [], [], max(floor, 1)
        read, depth = 0, DEPTH
        while len(terms):
            met = np.concatenate([self.doc[b + read : min(e, b + read + depth)] for b, e in zip(begin, stop, strict=True)])
            met = np.unique(met[~seen[met]])
            seen[met] = True
            if len(met):
                wanted = met[:, None] * self.width + terms
                at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
                place, held = self.place[at], self.key[at] == wanted
                docs.append(met)
                scores.append((np.where(held, self.impact[place], 0) * times).sum(1))
                for i, b in enumerate(begin):
                    marked[i][place[held[:, i], i] - b] = True
                best = np.concatenate(scores)
                if len(best) >= k:
                    kth = max(kth, int(np.partition(best, len(best) - k)[len(best) - k]))
            bound = 0
            for i, (b, mark) in enumerate(zip(begin, marked, strict=True)):
                rest = mark[reached[i] :]
                reached[i] += len(rest) if rest.all() else int(rest.argmin())
                if reached[i] < len(mark):
                    bound += int(times[i]) * int(self.impact[b + reached[i] - 1])
            read, depth = read + depth, 2 * depth
            if bound < kth:
                break
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        keep = scores >= kth
        return docs[keep], scores[keep], len(docs)


class Leaders:
    """The k best documents of one query so far: score, id and whether that is null."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((0, 3), np.int64)

    @property
    def floor(self) -> int:
        return int(self.rows[-1, 0]) if len(self.rows) == self.k else 0

    def add(self, scores, ids, null) -> None:
        rows = np.concatenate([self.rows, np.column_stack([scores, ids, null]).astype(np.int64)])
        self.rows = rows[np.lexsort((rows[:, 1], rows[:, 2], -rows[:, 0]))[: self.k]]


# --- the search -------------------------------------------------------------------


def _leaders(found: DataFrame, queries: list, facts: tuple, k: int) -> DataFrame:
    """The k best documents of every query in each task: ``query, item_id, doc_id, score``."""
    shared = found.sparkSession.sparkContext.broadcast((queries, *facts))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n_docs, n_terms, weight = shared.value
        leaders = [Leaders(k) for _ in queries]
        for rows in _shards(batches):
            ids = rows.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            lists = rows.column("terms"), rows.column("tfs")
            terms, tfs = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            ends = np.cumsum(lists[0].value_lengths().to_numpy())
            shard = Shard(rows.column("n").to_numpy(), ends, terms, tfs, n_docs, n_terms, weight)
            for (_, wanted, times), best in zip(queries, leaders, strict=True):
                docs, scores, _ = shard.best(wanted, times, k, best.floor)
                best.add(scores, ids[docs], null[docs])
        for at, ((item, _, _), best) in enumerate(zip(queries, leaders, strict=True)):
            if len(best.rows):
                score, doc, null = best.rows.T
                n = len(score)
                columns = [pa.array([at] * n, pa.int32()), pa.array([item] * n, pa.int64()), pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["query", "item_id", "doc_id", "score"])

    return found.mapInArrow(search, "query int, item_id long, doc_id long, score long")


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with any query term, in batches of about SHARD_POSTINGS postings."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy())
        at = 0
        while at < len(ends):
            # rows until the shard is full, at least one
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SHARD_POSTINGS - size, "right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - (ends[at - 1] if at else 0))
            at = to
            if size >= SHARD_POSTINGS or at < len(ends):
                yield _joined(held)
                held, size = [], 0
    if size:
        yield _joined(held)


def _best_first(*key: str | Column) -> Column:
    by = Window.partitionBy(*key).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return F.row_number().over(by)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k documents of highest score above 0.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other
    columns are passed over. Exact: equal scores go by ascending id, null ids last.
    Every row is a document or an item of its own, so repeated documents are ranked side
    by side and repeated items are answered each. Null and empty texts, and texts
    without a term, are no documents to count and items without a row. Empty tables give
    an empty one. Items go to the tasks in blocks of about QUERY_BYTES of text, each of
    which reads all documents; one item has to fit a task.
    """
    spark = docs.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes(F.col("text")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // QUERY_BYTES))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        counts = [(r.item_id, Counter(terms_of(bytes(r.text)))) for r in part]
        vocabulary = sorted(set().union(*(c for _, c in counts)))
        if not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary)}
        queries = [(i, np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for i, c in counts if c]
        found = stored(postings(docs, vocabulary))
        facts = weights(found, len(vocabulary))
        best = _leaders(found.filter(F.size("terms") > 0), queries, facts, k)
        best = best.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        best = best.withColumn("rank", _best_first("query", "salt")).filter(F.col("rank") <= k)
        best = best.withColumn("rank", _best_first("query")).filter(F.col("rank") <= k)
        out = out.unionByName(best.select("item_id", "rank", "doc_id", "score"))
    return out
