import itertools
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest

from semisketch.operators import commits, search
from semisketch.operators import index as idx
from semisketch.operators.analysis import pca_fp
from semisketch.operators.index import append_index, index_entries, read_index, stored_index
from semisketch.operators.order import numbered
from semisketch.operators.search import class_pairs, corr_histogram, pairs, query_raw, topk_pairs
from semisketch.streaming import jobs


def made(n=160, length=13, seed=1):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(12)]
    rows = []
    for i in range(n):
        # one source holds a third of all rows, and a third of the rows are copies
        centre = base[0] if i % 3 == 0 else base[rng.randrange(12)]
        noise = 0.0 if rng.random() < 0.4 else 0.2
        rows.append((f"e{i:03d}", [x + rng.gauss(0, 1) * noise for x in centre]))
    return rows


ROWS = made()
IDS = [r[0] for r in ROWS]
RANKS = np.array([np.argsort(np.argsort(r[1], kind="stable"), kind="stable") for r in ROWS])
L = RANKS.shape[1]
GAPS = ((RANKS[:, None] - RANKS[None]) ** 2).sum(-1)
CORR = 1 - 6 * GAPS / (L * (L * L - 1))


@pytest.fixture(scope="module")
def fps(spark):
    return spark.createDataFrame(ROWS, "doc_id string, fp array<double>")


def rounded(df):
    return sorted((r.q, r.t, round(r["corr"], 9)) for r in df.collect())


def brute(cutoff, rows=None, one_set=True):
    rows = range(len(IDS)) if rows is None else rows
    return sorted(
        (IDS[i], IDS[j], round(float(CORR[i, j]), 9))
        for i in rows
        for j in range(i + 1 if one_set else 0, len(IDS))
        if CORR[i, j] >= cutoff
    )


def test_ranks(fps):
    found = {r.id: r.ranks for r in index_entries(fps).collect()}
    assert [found[i] for i in IDS] == RANKS.tolist()


def test_ties_rank_by_position(spark):
    rows = spark.createDataFrame([("a", [2.0, 1.0, 2.0, 1.0])], "doc_id string, fp array<double>")
    assert index_entries(rows).first().ranks == [2, 0, 3, 1]


@pytest.mark.parametrize("cutoff, tile_rows", [(0.9, 2048), (0.2, 24)])
def test_self_pairs(fps, cutoff, tile_rows):
    entries = index_entries(fps)
    assert rounded(pairs(entries, cutoff=cutoff, tile_rows=tile_rows)) == brute(cutoff)
    counted = class_pairs(entries, cutoff=cutoff, tile_rows=tile_rows)
    assert counted.agg({"pairs": "sum"}).first()[0] == len(brute(cutoff))


def test_cross_pairs(fps):
    target = index_entries(fps)
    query = target.where("id < 'e040'")
    assert rounded(pairs(query, target, 0.7, 24)) == brute(0.7, range(40), False)
    raw = query_raw(fps.where("doc_id < 'e040'"), target, 0.7)
    assert raw.agg({"pairs": "sum"}).first()[0] == len(brute(0.7, range(40), False))


def test_pairs_at_the_cutoff_and_entities_without_a_vector(spark):
    n = 64
    there = np.random.default_rng(5).permuted(np.tile(np.arange(n), (400_000, 1)), axis=1)
    gaps = ((there - np.arange(n)) ** 2).sum(1)
    exact, below = there[gaps == 39312][0], there[gaps == 39314][0]
    rows = [("e0", None), ("e1", list(range(n))), ("e2", exact.tolist()), ("e3", None), ("e4", below.tolist())]
    entries = spark.createDataFrame([(i, r, n) for i, r in rows], "id string, ranks array<int>, L int")
    for tile_rows in (2048, 1):
        found = class_pairs(entries, cutoff=0.1, tile_rows=tile_rows).where("q <> t")
        met = {(r.q, r.t): round(r["corr"], 9) for r in found.collect()}
        assert met.pop(("e1", "e2")) == 0.1 and ("e1", "e4") not in met
        gap = ((exact - below) ** 2).sum()
        assert met == ({("e2", "e4"): round(1 - 6 * gap / (n * (n * n - 1)), 9)} if gap <= 39312 else {})


@pytest.mark.parametrize("width", [2, 13, 64, 256, 257])
def test_least_product_and_short_products_in_single_precision(width):
    """The least product that meets a cutoff, for all decimals; products are exact."""
    whole, squares = width * (width * width - 1), sum(i * i for i in range(width))
    for hundredths in range(-100, 101):
        least = search._least(hundredths / 100, width)
        assert 100 * (whole - 12 * (squares - least)) >= hundredths * whole
        assert 100 * (whole - 12 * (squares - least + 1)) < hundredths * whole
    ranks = np.array([np.arange(width), np.arange(width)[::-1]], np.int32)
    block = pa.table({
        "side": [0, 0, 2], "tile": pa.array([0, 0, 0], pa.int64()), "other": pa.array([None, None, 0], pa.int64()),
        "ranks": pa.array([*ranks.tolist(), None], pa.list_(pa.int32())), "rep": ["a", "b", None],
        "members": pa.array([1, 1, None], pa.int64()), "no": pa.array([0, 1, None], pa.int64()),
    })
    ((products, same, *_),) = search._tile_products(iter(block.to_batches()), width)
    assert same and products.dtype == (np.float32 if width <= 256 else np.float64)
    assert products.tolist() == (ranks.astype(np.int64) @ ranks.T.astype(np.int64)).tolist()


def test_histogram(fps):
    found = {round(r["corr"], 2): r.pairs for r in corr_histogram(index_entries(fps), tile_rows=24).collect()}
    bins = Counter(
        round((int(CORR[i, j] * 100 + 100) - 100) / 100, 2)
        for i, j in itertools.combinations(range(len(IDS)), 2)
    )
    assert found == dict(bins)


@pytest.mark.parametrize("k", [1, 5000, 10**6])
def test_top_pairs(fps, k):
    found = rounded(topk_pairs(index_entries(fps), k, tile_rows=40))
    everything = brute(-1.0)
    assert len(set(found)) == len(found) == min(k, len(everything))
    assert set(found) <= set(everything)
    best = sorted((c for _, _, c in everything), reverse=True)[:k]
    assert sorted((c for _, _, c in found), reverse=True) == best


def test_top_pairs_of_two_sets(fps):
    target = index_entries(fps)
    found = rounded(topk_pairs(target.where("id < 'e020'"), 700, target, tile_rows=16))
    everything = brute(-1.0, range(20), False)
    assert len(set(found)) == 700 and set(found) <= set(everything)
    assert sorted(c for *_, c in found) == sorted(c for *_, c in everything)[-700:]


# --- the pivot tree -----------------------------------------------------------


def shuffled(n, length, base, swaps, rng):
    """Orders near a base: a few neighbours change places."""
    for _ in range(n):
        ranks = list(base)
        for _ in range(rng.randrange(swaps + 1)):
            i = rng.randrange(length - 1)
            ranks[i], ranks[i + 1] = ranks[i + 1], ranks[i]
        yield ranks


def entries_of(spark, ranks):
    rows = [(f"r{i:05d}", [], len(r), r) for i, r in enumerate(ranks)]
    return spark.createDataFrame(rows, "id string, meta array<string>, L int, ranks array<int>")


@pytest.fixture(scope="module")
def clustered(spark):
    """One close group with most of the vectors, and others far and wide."""
    rng = random.Random(5)
    dense = list(shuffled(600, 40, range(40), 3, rng))
    wide = [rng.sample(range(40), 40) for _ in range(70)]
    return entries_of(spark, dense + wide + dense[:50])


@pytest.mark.parametrize("pivots, nodes", [(search.FEW_PIVOTS, search.FEW_NODES), (0, 0)])
def test_deep_trees_change_nothing(spark, fps, monkeypatch, pivots, nodes):
    """Several levels of few pivots, tables sent to every task or joined."""
    monkeypatch.setattr(search, "FEW_PIVOTS", pivots)
    monkeypatch.setattr(search, "FEW_NODES", nodes)
    monkeypatch.setattr(search, "GROUP_ROWS", 20)
    entries = index_entries(fps)
    found = search.Search(entries, None, 16, fan=4)
    assert found.left.depth > 1
    nodes_of = {r.path: r for r in found.left.nodes.collect()}
    assert all(r.radius <= search.FARTHEST and r.leaf == (r.first is not None) for r in nodes_of.values())
    assert sum(r.members for r in nodes_of.values() if r.leaf) == len(IDS)
    hits = found.hits(0.6)
    assert hits.agg({"pairs": "sum"}).first()[0] == len(brute(0.6))
    cross = search.Search(entries.where("id < 'e040'"), entries, 60, fan=3).hits(0.6)
    assert cross.agg({"pairs": "sum"}).first()[0] == len(brute(0.6, range(40), False))


def test_pruned_and_full_counts_agree(clustered):
    found = search.Search(clustered, None, 8, fan=8)
    bins = lambda settle: {r.bin: r.n for r in found.bins(settle=settle).groupBy("bin").agg({"pairs": "sum"}).toDF("bin", "n").collect() if r.n}
    full = bins(False)
    assert bins(True) == full and sum(full.values()) == 720 * 719 // 2
    products, counted = found.tile_pairs(settle=True)
    every = found.left.tiles * (found.left.tiles + 1) // 2
    assert found.tile_pairs()[0].count() == every
    assert products.count() < every / 2 and counted.count() > 0


def test_blocks_are_sent_to_few_strips(spark):
    rng = random.Random(6)
    found = search.Search(entries_of(spark, [rng.sample(range(20), 20) for _ in range(1_500)]), None, 16, fan=16)
    tiles = found.left.tiles
    sent = found.strips(found.tile_pairs()[0]).blocks.count()
    assert tiles > 90 and sent / 1_500 <= np.ceil(np.log2(tiles))
    near = found.strips(found.tile_pairs(0.999)[0]).blocks.count()
    assert near <= sent


def test_numbers_in_order(spark):
    rows = spark.range(500).selectExpr("id % 37 AS k", "id AS v", "id % 3 AS w").repartition(7)
    got = sorted((r.k, r.v, r.w, r.pos) for r in numbered(rows, ["k", "v"], part_rows=60).collect())
    assert [g[3] for g in got] == list(range(500))
    got = sorted((r.k, r.v, r.w, r.pos) for r in numbered(rows, ["k", "v"], weight="w", part_rows=60).collect())
    assert [g[3] for g in got] == [0, *itertools.accumulate(g[2] for g in got)][:-1]
    assert numbered(rows.limit(0), ["k"]).collect() == []


def test_repeated_ids(spark):
    rows = [("a", [1.0, 2.0, 3.0])] * 3 + [("b", [1.0, 2.0, 3.0]), ("a", [3.0, 2.0, 1.0])]
    entries = index_entries(spark.createDataFrame(rows, "doc_id string, fp array<double>"))
    assert Counter(rounded(pairs(entries, cutoff=0.5))) == {("a", "a", 1.0): 3, ("a", "b", 1.0): 3}
    assert len(rounded(topk_pairs(entries, 10))) == 10


def test_lengths_do_not_mix(spark, fps, tmp_path):
    other = spark.createDataFrame([("x", [1.0, 2.0])], "doc_id string, fp array<double>")
    with pytest.raises(ValueError, match="several lengths"):
        pairs(index_entries(fps), index_entries(other), 0.5)
    append_index(fps, str(tmp_path / "i"), 13)
    with pytest.raises(ValueError, match="of length 13"):
        append_index(other, str(tmp_path / "i"), 2)
    with pytest.raises(Exception, match="of length"):
        append_index(other, str(tmp_path / "j"), 13)


def test_index_grows_by_new_ids(spark, fps, tmp_path):
    path = str(tmp_path / "i")
    append_index(fps.where("doc_id < 'e100'"), path, 13)
    before = {r.pos: r.id for r in read_index(spark, path).collect()}
    append_index(fps, path, 13)
    after = {r.pos: r.id for r in read_index(spark, path).collect()}
    assert sorted(after) == list(range(160)) and sorted(after.values()) == IDS
    assert all(after[p] == i for p, i in before.items())


def ids_of(spark, path):
    return sorted(r.id for r in stored_index(spark, path).collect())


def test_two_writers(spark, fps, tmp_path, monkeypatch):
    """A batch that loses the race leaves out what the other one brought."""
    path, put = str(tmp_path / "i"), commits.Commits.put
    append_index(fps.where("doc_id < 'e020'"), path, 13)

    def slow(self, batch, known):
        monkeypatch.setattr(commits.Commits, "put", put)
        append_index(fps.where("doc_id < 'e100'"), path, 13)
        return put(self, batch, known)

    monkeypatch.setattr(commits.Commits, "put", slow)
    append_index(fps.where("doc_id >= 'e050'"), path, 13)
    assert ids_of(spark, path) == IDS
    assert [b["number"] for b in commits.Commits(spark, path).batches()] == [1, 2, 3]
    assert sorted(r.pos for r in read_index(spark, path).collect()) == list(range(160))


def test_threads_that_append(spark, fps, tmp_path):
    path = str(tmp_path / "i")
    parts = [fps.where(f"doc_id between 'e{lo:03d}' and 'e{lo + 79:03d}'") for lo in (0, 40, 80)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda part: append_index(part, path, 13), parts))
    assert ids_of(spark, path) == IDS


def test_failed_append_is_not_seen(spark, fps, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    append_index(fps.where("doc_id < 'e020'"), path, 13)
    with monkeypatch.context() as patch:
        patch.setattr(commits.Commits, "put", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            append_index(fps, path, 13)
    assert ids_of(spark, path) == IDS[:20]
    append_index(fps, path, 13)
    assert ids_of(spark, path) == IDS


def test_history_of_many_batches(spark, fps, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "FULL_EVERY", 3)
    path = str(tmp_path / "i")
    for i in range(0, 50, 10):
        append_index(fps.where(f"doc_id between 'e{i:03d}' and 'e{i + 9:03d}'"), path, 13)
    held = commits.Commits(spark, path)
    assert [(b["number"], b["start"]) for b in held.batches()] == [(i + 1, 10 * i) for i in range(5)]
    asked = []
    monkeypatch.setattr(commits.Commits, "_read", lambda self, n, read=commits.Commits._read: asked.append(n) or read(self, n))
    assert len(held.batches()) == 5 and asked == [[3, 4, 5]]


def test_files_without_hits_are_not_read(spark, fps, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    even = fps.where("cast(substr(doc_id, 2) as int) % 2 = 0")
    append_index(even, path, 13)
    append_index(fps.where("doc_id > 'e080'"), path, 13)
    batches = commits.Commits(spark, path).batches()
    asked = lambda *ids: idx.files_with(spark.createDataFrame([(i,) for i in ids], "id string"), path, batches)
    assert all(batches[1]["folder"] in f for f in asked("e099")) and asked("e099")
    assert all(batches[0]["folder"] in f for f in asked("e004"))
    assert asked("zzz") == [] and asked("a", None) == []
    wrong = [f for i in range(1, 80, 2) for f in asked(f"e{i:03d}")]
    assert len(wrong) <= 4
    # entries that no file can hold are added without reading one
    monkeypatch.setattr(idx, "new_only", lambda entries, index, plain=idx.new_only: plain(entries, index) if not index.inputFiles() else 1 / 0)
    append_index(spark.createDataFrame([("zzz", [float(i) for i in range(13)])], "doc_id string, fp array<double>"), path, 13)
    assert "zzz" in ids_of(spark, path)
    monkeypatch.setattr(idx, "FEW_IDS", 1)
    assert asked("e004", "e005") is None


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for part in range(2):
        lines = [f'{{"id":"{part}-{i}","x":[{i},"t{i}"]}}' for i in range(5)]
        (source / f"{part}.json").write_text("\n".join(lines + ["not json", '{"x":1}']))
    stream = jobs.stream_json_lines(spark, str(source), "id", lengths=5)
    jobs.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    from semisketch.operators.fingerprint import fingerprint
    from semisketch.sources.documents import read_json_lines

    batch = fingerprint(read_json_lines(spark, str(source), "id"), 5)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())


def test_index_stream(spark, tmp_path):
    source, index, log = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "log")
    source.mkdir()
    (source / "a.tsv").write_text("# head\na\t3\t1.0\t2.0\nb\t4\t2.0\t1.0\n")
    jobs.stream_index(spark, str(source), index, 2, log).awaitTermination()
    (source / "b.tsv").write_text("b\t4\t2.0\t1.0\nc\t4\t2.0\t1.0\n")
    jobs.stream_index(spark, str(source), index, 2, log).awaitTermination()
    found = sorted((r.id, r.meta, r.ranks) for r in stored_index(spark, index).collect())
    assert found == [("a", ["3"], [0, 1]), ("b", ["4"], [1, 0]), ("c", ["4"], [1, 0])]
    # another writer's ids, a repeated file and ids seen long ago
    append_index(spark.createDataFrame([("d", [5.0, 1.0])], "doc_id string, fp array<double>"), index, 2)
    (source / "c.tsv").write_text("# head\na\t3\t1.0\t2.0\nb\t4\t2.0\t1.0\n")
    (source / "d.tsv").write_text("d\t1\t1.0\t2.0\ne\t1\t1.0\t2.0\ne\t1\t1.0\t2.0\n")
    jobs.stream_index(spark, str(source), index, 2, log).awaitTermination()
    assert ids_of(spark, index) == ["a", "b", "c", "d", "e"]
    batches = commits.Commits(spark, index).batches()
    assert [b["writer"] for b in batches] == [log, log, None, log]
    # a micro-batch that comes again under its number adds nothing
    again = spark.createDataFrame([("x", [5.0, 1.0])], "doc_id string, fp array<double>")
    append_index(again, index, 2, writer=log, turn=batches[-1]["turn"])
    assert len(commits.Commits(spark, index).batches()) == len(batches)


def test_principal_components(spark, fps):
    x = np.array([r[1] for r in ROWS])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    found = {r.doc_id: r.pc for r in pca_fp(fps).collect()}
    np.testing.assert_allclose([found[i] for i in IDS], z @ v[:2].T, atol=1e-6)


def test_many_copies(spark):
    same = spark.range(50_000).selectExpr(
        "format_string('e%06d', id) AS doc_id", "array(1D, 3D, 2D, 4D) AS fp"
    )
    best = topk_pairs(index_entries(same), 50_000).collect()
    assert len(best) == 50_000 and {r["corr"] for r in best} == {1.0}
    twice = same.limit(600).selectExpr("'x' AS doc_id", "fp")
    assert pairs(index_entries(twice), cutoff=0.9).count() == 600 * 599 // 2


def test_pairs_are_listed_without_rank_vectors(fps):
    """What comes back from the tile pairs names classes by their least id or a number."""
    entries = index_entries(fps)
    for found in (pairs(entries, cutoff=0.3, tile_rows=60), class_pairs(entries, cutoff=0.3, tile_rows=60)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "q_ranks" not in plan and "t_ranks" not in plan


def test_pairs_of_copies_that_are_too_many_to_send(spark, fps, monkeypatch):
    monkeypatch.setattr(search, "FEW_NODES", 0)
    entries = index_entries(fps)
    assert rounded(pairs(entries, cutoff=0.6, tile_rows=60)) == brute(0.6)
    some = entries.where("id < 'e040'")
    listed = rounded(pairs(some, entries, cutoff=0.6, tile_rows=60))
    assert listed == brute(0.6, range(40), False)


def test_entities_without_a_vector_are_in_no_pair(spark):
    entries = spark.createDataFrame(
        [("a", [0, 1, 2]), ("b", [0, 1, 2]), ("c", [0, 2, 1]), ("x", None), ("y", None)], "id string, ranks array<int>"
    )
    assert not {"x", "y"} & {i for r in pairs(entries, cutoff=-1.0).collect() for i in (r.q, r.t)}
