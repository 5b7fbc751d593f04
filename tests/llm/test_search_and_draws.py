import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from semisketch.llm import lexical_search as ls
from semisketch.llm import minhash as mh
from semisketch.llm import queries
from semisketch.llm import resampling as rs

KIND = "doc_id long, text string, rank string, score string, n long, item string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def corpus(n=150, seed=0):
    rng = random.Random(seed)
    words = [f"w{int(i ** 1.5)}" for i in range(60)] + ["Éa", "ÀB", "x1", "naïve y", "日本"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) + rng.choice(["", ".", "\n-"]) for _ in range(n)]
    rows = list(enumerate(texts))
    rows += [(n + i, texts[3]) for i in range(15)] + [(7, texts[7])] * 2 + [(n + 20, "W0 " * 5_000), (n + 21, None), (n + 22, ""), (n + 23, "?! ...")]
    return rows + [(None, texts[5]), (None, texts[5] + " w0")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "r", "s", 1, "i") for i, t in rows], KIND)


# --- lexical search ---------------------------------------------------------------


def brute_search(rows, items, k=10):
    docs = [(i, terms(t)) for i, t in rows if terms(t)]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    df = Counter(t for _, ts in docs for t in set(ts))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, ts in docs:
            tf, m = Counter(ts), 100 - 75 + (75 * len(ts) * n_docs) // n_terms
            score = sum(weight[t] * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "w0 W1 w2 w2"), (2, "éa Éa x1"), (3, None), (4, ""), (5, "unheard of"), (6, "w0"), (7, " ".join(f"w{i}" for i in range(400))), (7, "日本"), (None, "w1 w5")]


@pytest.mark.parametrize("postings, depth, block", [(1_000_000, 16, 16 << 20), (60, 1, 40)])
def test_search_equals_brute_force(spark, monkeypatch, postings, depth, block):
    monkeypatch.setattr(ls, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(ls, "DEPTH", depth)
    monkeypatch.setattr(ls, "QUERY_BYTES", block)
    rows = corpus()
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, n int")
    found = ls.search(table(spark, rows).repartition(3), items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_search(rows, ITEMS)


def test_search_of_empty_tables(spark):
    rows = table(spark, corpus(10))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ls.search(rows.limit(0), items).collect() == []
    assert ls.search(rows, items.limit(0)).collect() == []


def test_best_positions_stop_before_the_ends_of_lists():
    """Two lists whose best documents are the same: few documents are seen, and reading
    ends below the k-th score, not at it."""
    size = 5_000
    tfs = np.repeat(np.arange(size, 0, -1), 2)
    lists = np.tile([0, 1], size)
    shard = ls.Shard(np.full(size, 6_000), np.arange(2, 2 * size + 1, 2), lists, tfs, size, 6_000 * size, np.array([3, 5]))
    docs, scores, seen = shard.best(np.array([0, 1]), np.array([1, 2]), 10, 0)
    assert seen < 100 and set(range(10)) <= set(docs.tolist())
    level = ls.Shard(np.full(100, 8), np.arange(1, 101), np.zeros(100, int), np.ones(100, int), 100, 800, np.array([3]))
    docs, scores, seen = level.best(np.array([0]), np.array([1]), 10, 0)
    assert seen == 100 and len(docs) == 100 and len(set(scores.tolist())) == 1


# --- resampling -------------------------------------------------------------------


def features(text):
    words = terms(text)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute_resample(rows, target, percent=25, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([x for _, x in rows], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-x[4], x[0] is None, x[0] or 0) for x in out if x[1] >= least)
    drawn = able[: percent * len(able) // 100]
    return out, drawn


@pytest.mark.parametrize("percent", [25, 100, 1, 0])
def test_resample_equals_brute_force(spark, percent):
    rows = corpus(seed=4)
    target = ["w0 w1 w2 " * 20, "Éa naïve", None, ""]
    found = rs.resample(table(spark, rows).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent).collect()
    plain, drawn = brute_resample(rows, target, percent)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in found), key=repr) == sorted(((i, f, w, s) for i, _, f, w, s in plain), key=repr)
    ranked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked] == drawn


def test_resample_ties_and_empty_tables(spark):
    """Rows of one id and score: as many are drawn as asked for."""
    rows = [(5, "a b " * 20)] * 40 + [(4, None), (3, "short")]
    docs = table(spark, rows)
    target = spark.createDataFrame([("a b",)], "text string")
    found = rs.resample(docs, target).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 11)) and len(found) == 42
    assert rs.resample(docs.limit(0), target).collect() == []
    assert len(rs.resample(docs, target.limit(0)).collect()) == 42


def test_pair_checksums_equal_those_of_the_pairs():
    words = [b"a", b"of", b"\xc3\xa9t\xc3\xa9", b"x" * 63, b"y" * 64, b"z" * 5_000, b"w" * 191]
    memory = rs.Words()
    n = memory.numbers(words)
    first, second = (x.ravel() for x in np.meshgrid(n, n))
    want = [zlib.crc32(words[i] + b" " + words[j]) for i, j in zip(first, second, strict=True)]
    assert memory.pairs(first, second).tolist() == want


@pytest.mark.parametrize("values", [[3], [3, 3, 3], [-5, 10**18, -(10**18), 7, 7], list(range(-2_000, 2_000, 3))])
def test_nth_largest(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values, reverse=True)
    for n in {1, 2, len(values) // 2, len(values)} & set(range(1, len(values) + 1)):
        found = rs.nth_largest(rows, "v", n)
        assert found == (ordered[n - 1], sum(v > ordered[n - 1] for v in values))


# --- fingerprints -----------------------------------------------------------------


def shingles(text, words=5):
    cut = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(cut[i : i + words]) for i in range(max(1, len(cut) - words + 1))} if cut else set()


def test_fingerprints_against_plain_bins():
    """The same bins by sets and loops, densified bin by bin."""
    texts = ["one two three four five six", "One", "a b c d e f g h " * 90, "É é " * 30, "one two\tthree four five six"]
    for text, sign in zip(texts, mh.signatures(texts), strict=True):
        hashes = {int(h) for h in mh.shingle_hashes([text])[0]}
        assert len(hashes) == len(shingles(text))
        bins = [min((h for h in hashes if h >> 56 == b), default=None) for b in range(256)]
        low = []
        for b in range(256):
            turn, at = 0, b
            while bins[at] is None:
                at, turn = int(mh._drawn(256, turn)[b]), turn + 1
            low.append(bins[at] & 15)
        assert sign == bytes(low[i] | low[i + 1] << 4 for i in range(0, 256, 2))
    assert mh.signatures(["", "  \n", " "])[:2] == [b"", b""] and mh.signatures(texts)[0] == mh.signatures(texts)[4]


def test_likeness_is_close_to_the_jaccard_similarity():
    rng = random.Random(1)
    words = [f"v{i}" for i in range(3_000)]
    gaps = []
    for n in (30, 100, 400, 2_000):
        for share in (0.0, 0.1, 0.3, 0.5, 0.8, 1.0):
            left = rng.choices(words, k=n)
            right = left[: int(n * share)] + rng.choices(words, k=n - int(n * share))
            pair = " ".join(left), " ".join(right)
            x, y = map(shingles, pair)
            got = mh.likeness(*([s] for s in mh.signatures(list(pair))))[0]
            gaps.append(got - len(x & y) / len(x | y))
    assert max(map(abs, gaps)) < 0.15 and abs(sum(gaps) / len(gaps)) < 0.02
    assert mh.likeness([b"", b"", mh.signatures(["a"])[0]], [b"", mh.signatures(["a"])[0], b""]).tolist() == [1, 0, 0]


def brute_edits(rows):
    """Ids are distinct here."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    for at, (i, text) in enumerate(rows):
        new = mh.edited(text, rows[(at + 1) % len(rows)][1])
        third = len(text) // 3
        assert len(new) <= len(text) and new.startswith(text[: len(text) - third])
        signs = mh.signatures([text, new, rows[(at + 1) % len(rows)][1]])
        near = [float(mh.likeness(signs[:1], [s])[0]) for s in signs[1:]]
        yield i, len(text), hashlib.sha256(new.encode()).hexdigest(), signs[0].hex(), signs[1].hex(), *near


@pytest.mark.parametrize("parts", [1, 5])
def test_edit_comparison_equals_brute_force(spark, parts):
    rows = [r for r in dict(corpus(40, seed=3)).items()]
    found = mh.edit_comparison(table(spark, rows).repartition(parts)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_edits(rows), key=repr)


def test_edit_comparison_of_few_and_repeated_rows(spark):
    one = mh.edit_comparison(table(spark, [(3, "a b c d e f")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(3, 1.0)]
    rows = table(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (2, "x")])
    assert len(mh.edit_comparison(rows).collect()) == 3
    assert mh.edit_comparison(rows.limit(0)).collect() == []
    signed = mh.fingerprints(rows.withColumnRenamed("item", "fingerprint"))
    assert signed.columns == ["doc_id", "text", "rank", "score", "n", "fingerprint"]
    assert len({r.fingerprint for r in signed.collect()}) == 2


# --- the registered query ---------------------------------------------------------


@needs_data
def test_fingerprint_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op13_minhash"](spark, FOLDER).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_edits(rows), key=repr)
