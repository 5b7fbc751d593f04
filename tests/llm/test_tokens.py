import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from semisketch.llm import packing as pk
from semisketch.llm import token_counts as tc

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
MARKS = list("abcXYZ ÀéİßΣς\t\n\r\u0085 　\x1c'.,!$-0129٣漢क़ª😀́‍") + ["'s", "  ", " the", "<|endoftext|>", "\n\n", "hello", " world."]
KIND = "doc_id long, text string, length string, piece string, n_tokens int"


def texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choices(MARKS, k=rng.randrange(40))) for _ in range(n)] + [None, "", " ", "word " * 30_000]


def table(spark, found):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(found)] + [(None, "a b", "x", "y", 1), (0, "a b", "x", "y", 1)], KIND)


def test_counts_equal_the_library(spark):
    library, found = Tokenizer.from_file(BYTES), texts(3_000)
    docs = table(spark, found)
    rows = tc.token_counts(docs, BYTES).collect()
    want = [(i, t) for i, t in enumerate(found)] + [(None, "a b"), (0, "a b")]
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in want), key=repr)
    assert sorted(map(tuple, rows), key=repr) == want
    assert tc.token_counts(docs.limit(0), BYTES).collect() == []


def test_compact_table_is_only_a_shortcut(monkeypatch):
    worker, library = tc.Counting(BYTES), Tokenizer.from_file(BYTES)
    found = [t for t in texts(500, 1) if t]
    worker.table = tc.Lengths({"hello": 1, "world.": 2, "the": 1}).opened()
    monkeypatch.setattr(tc, "REMEMBERED", 50)
    monkeypatch.setattr(tc, "SLICE", 100)
    assert list(worker.counts(found)) == [len(library.encode(t, add_special_tokens=False).ids) for t in found]


def test_sweep_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 64, 4096])
        lengths = [rng.choice([1, capacity, capacity // 3 + 1, rng.randint(1, capacity)]) for _ in range(rng.randint(1, 300))]
        counts = {n: lengths.count(n) for n in lengths}
        places, filled = sorted(pk.sweep(counts, capacity)), {}
        for n, total in counts.items():
            runs = [p for p in places if p[0] == n]
            for rank in range(total):
                run = [p for p in runs if p[1] <= rank][-1]
                k = rank - run[1]
                filled.setdefault(run[2] + k // run[3], []).append((run[4] + k % run[3] * n, n))
        for pieces in filled.values():
            end = 0
            for offset, n in sorted(pieces):
                assert offset == end
                end += n
            assert end <= capacity
        gaps, opened = [], 0
        for n in sorted(lengths, reverse=True):
            at = bisect_left(gaps, n)
            gap = gaps.pop(at) if at < len(gaps) else capacity
            opened += gap == capacity
            if gap > n:
                insort(gaps, gap - n)
        assert len(filled) == opened


@pytest.mark.parametrize("capacity", [4096, 16])
def test_packing_round_trip(spark, capacity):
    """Pieces hold the library's ids, sequences are gapless and few."""
    library, found = Tokenizer.from_file(WORDS), texts(1_000, 2)
    docs = table(spark, found)
    rows = pk.packed(docs, WORDS, capacity).collect()
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [1]
    want = []
    for i, t in [*enumerate(found), (None, "a b"), (0, "a b")]:
        data = np.array(ids(t), "<u4")
        want += [(i, n, at, len(p := data[at:at + capacity]), zlib.crc32(p.tobytes())) for n, at in enumerate(range(0, len(data), capacity))]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(w[3] for w in want)
    assert len(sequences) <= -(-total // capacity) * 1.1 + 1
    assert sorted(map(tuple, pk.packed(docs, WORDS, capacity).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_pieces_with_ids_and_empty(spark):
    docs = table(spark, ["hello world", None])
    library = Tokenizer.from_file(WORDS)
    found = {r.doc_id: list(r.ids) for r in pk.pieces(docs.filter("doc_id = 1 or text = 'hello world'"), WORDS, with_ids=True).collect()}
    assert found == {0: library.encode("hello world", add_special_tokens=False).ids + [1], 1: [1]}
    assert pk.packed(docs.limit(0), WORDS).collect() == []
