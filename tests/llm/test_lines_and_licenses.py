import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from semisketch.llm import license_scan as ls
from semisketch.llm import line_dedup as ld
from semisketch.session import scratch_folder

KIND = "doc_id long, text string, key string, n_lines int, n_chars long"
BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key_of(line)) >= 20:
                holders[key_of(line)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or gone.get(key_of(x), i) <= i]
        yield i, len(lines), len(lines) - len(kept), "\n".join(kept)


def corpus(n=60, seed=0):
    rng = random.Random(seed)
    shared = [f"This line number {i} is shared by some texts" for i in range(12)] + ["short one", "É shared line with accents, twenty"]
    rows = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.6 else f"own line {i} {rng.random()} with enough characters" for _ in range(rng.randrange(1, 8))]
        lines = [rng.choice(["", "  ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", " \r"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    long = "\n".join(shared * 2_000)
    return rows + [(n, long), (n + 1, None), (n + 2, ""), (None, shared[0]), (3, rows[3][1])]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 0) for i, t in rows], KIND)


def cleaned(index, docs):
    found = index.cleaned(docs).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    return sorted(map(tuple, found), key=repr)


def index(spark):
    return ld.LineIndex(scratch_folder(spark))


def test_equals_brute_force(spark):
    rows = corpus()
    docs = table(spark, rows)
    assert cleaned(index(spark).insert(docs), docs) == sorted(brute(rows), key=repr)


def test_insertions_and_deletions_are_reversible(spark):
    rows = [r for r in corpus(seed=1) if r[0] is not None]
    first, second = table(spark, rows[:40]), table(spark, rows[40:])
    before = index(spark).insert(first)
    both = before.insert(second).insert(second)
    assert cleaned(both, table(spark, rows)) == sorted(brute(rows), key=repr)
    back = both.delete(second.filter("doc_id is not null").select("doc_id").join(first.select("doc_id"), "doc_id", "left_anti"))
    assert cleaned(back, first) == cleaned(before, first) == sorted(brute(rows[:40]), key=repr)


def test_small_shards_and_hot_keys_change_nothing(spark, monkeypatch):
    """Shards of few keys that are dealt anew as the index grows, and every key hot."""
    rows = [r for r in corpus(n=200, seed=2) if r[0] is not None]
    monkeypatch.setattr(ld, "SHARD_KEYS", 1)
    monkeypatch.setattr(ld, "SHARD_POSTINGS", 10)
    monkeypatch.setattr(ld, "HOT_SHARE", 1)
    docs = table(spark, rows)
    before = index(spark).insert(table(spark, rows[:20]))
    after = before.insert(docs)
    assert after.shards > 2 * before.shards
    assert cleaned(after, docs) == sorted(brute(rows), key=repr)
    monkeypatch.setattr(ld, "HOT_SHARE", 10**12)
    assert cleaned(after, docs) == sorted(brute(rows), key=repr)


def test_documents_keep_their_columns(spark):
    docs = table(spark, corpus())
    found = ld.with_kept_lines(index(spark).insert(docs), docs)
    assert found.columns == docs.columns
    assert found.filter("text is null").count() == 1
    assert found.filter(F.col("text").isNotNull() & (F.length("text") != F.col("n_chars"))).count() == 0


def test_empty(spark):
    docs = table(spark, [])
    assert index(spark).insert(docs).cleaned(docs).collect() == []


def test_cuckoo_filter():
    keys = ld.words_of([hashlib.md5(str(i).encode()).digest() for i in range(3000)])
    table = ld.CuckooFilter.sized(2000)
    assert table.add(keys[:2000])
    assert table.has(keys[:2000]).all() and table.has(keys[2000:]).mean() < 0.01
    table.remove(keys[:1000])
    assert table.has(keys[1000:2000]).all() and table.has(keys[:1000]).mean() < 0.01
    assert ld.CuckooFilter.of_bytes(table.to_bytes()).has(keys[1000:2000]).all()
    small = ld.CuckooFilter(np.zeros((16, 4), np.uint16))
    assert not small.add(keys[:200])


def test_license_scan(spark):
    mit = dict(ls.KNOWN[:1])["MIT"]
    rows = [
        (1, "MIT License".join(["", ""]) or mit), (2, mit.upper().replace(",", " ;\n")), (3, "Copyright (c) 2020 Some One\n\n" + mit),
        (4, mit + " More."), (5, None), (6, ""), (7, "..."), (8, "licensed under the apache licence version 2.0"), (9, "plain text " * 20_000),
        (2, "Licensed under CC BY-NC 4.0"), (10, "Copyright 1999 Nobody"),
    ]
    rows[0] = (1, mit)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    found = sorted((tuple(r) for r in ls.scan(docs, ls.known_licenses(spark)).select("doc_id", "license_id").collect()), key=repr)
    want = [(1, "MIT"), (2, "MIT"), (2, "CC-BY-NC-4.0"), (3, "MIT"), (4, None), (5, None), (6, None), (7, None), (8, "Apache-2.0"), (9, None), (10, None)]
    assert found == sorted(want, key=repr)
    assert ls.scan(docs.limit(0), ls.known_licenses(spark)).collect() == []


def test_every_known_text_is_found_in_another_spelling(spark):
    texts = [(i, "(c) 2019 X\n" + t.upper().replace(", ", " ;  ").replace("LICENSE", "LICENCE") + "\n") for i, (_, t) in enumerate(ls.KNOWN)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r.license_id for r in ls.scan(docs, ls.known_licenses(spark)).collect()}
    assert found == {i: name for i, (name, _) in enumerate(ls.KNOWN)}
    own = spark.createDataFrame([("OWN-1", "Do as you like, Version 2.0")], "license_id string, text string")
    rows = spark.createDataFrame([(1, "do as you like v2")], "doc_id long, text string")
    assert ls.scan(rows, ls.known_licenses(spark, own)).first().license_id == "OWN-1"
