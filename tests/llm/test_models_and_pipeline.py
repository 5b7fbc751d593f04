import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from semisketch.llm import jaccard_join as jj
from semisketch.llm import language_id as li
from semisketch.llm import mixing as mx
from semisketch.llm import queries
from semisketch.llm import toxicity as tx
from semisketch.llm.common import sampled

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, size int, target string, score string"
SPEECH = {
    "en": "the of and to in that was with for not from this they have which were been their".split(),
    "fr": "les des une dans pour que qui sur avec pas plus sont cette mais être étaient leur nous".split(),
    "de": "der die und das nicht mit sich auf für ist eine auch werden nach über durch wurde noch".split(),
}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 7, "x", "y") for i, t, lang, s in rows], DOCS)


def speech(n=150, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(SPEECH[lang], k=rng.randrange(8, 60))), lang, rng.choice("ab")) for i in range(n) for lang in [rng.choice(list(SPEECH))]]


# --- language ID ------------------------------------------------------------------


def test_languages_and_rejects(spark):
    rows = speech()
    odd = [(900, None, None, "a"), (901, "", None, None), (902, "qqzx xkcd wvvk zzqj " * 40, None, "a"), (903, "12345 --- ", "en", "a"), (None, rows[0][1], None, None), (0, *rows[0][1:]), (904, "the of and to in " * 20_000, None, "b")]
    docs = docs_of(spark, rows + odd)
    model = li.train(docs_of(spark, speech(seed=1)))
    found = li.identify(li.evidence_of_documents(docs), model).collect()
    assert len(found) == len(rows) + len(odd)
    said = {r.doc_id: r for r in found}
    assert all(said[i].lang == lang and said[i].kept for i, _, lang, _ in rows)
    assert said[904].lang == "en" and not said[902].kept and said[902].lang == "und" and said[900].kept and not said[901].kept
    assert li.identify(li.evidence_of_documents(docs.limit(0)), model).collect() == []
    assert li.in_known_language(docs).columns == docs.columns
    assert not any(r.kept for r in li.identify(li.evidence_of_documents(docs), li.train(docs.limit(0))).collect())


def test_evidence_is_fused_as_by_hand(spark):
    """A text that could be either follows its markup, host and suffix."""
    model = li.train(docs_of(spark, speech(seed=1)))
    host = [(i, f"http://x.fr/{i}", "<html><p>" + " ".join(SPEECH["fr"])) for i in range(20)]
    pages = [(100, "http://x.fr/a", "<p>9"), (101, "http://y.fr/a", "<p>9"), (102, "http://z.com", '<html lang="de-AT"><script>les des</script>9'), (103, None, None), (104, "http://x.fr", '<html lang="xx">9')]
    rows = spark.createDataFrame(host + pages, "page_id long, url string, html string")
    said = {r.doc_id: r for r in li.identify(li.evidence_of_pages(rows), model).collect()}
    assert [said[i].lang for i in (100, 101, 102, 104)] == ["fr"] * 4
    assert not said[103].kept
    world = (20 + 1) / (20 + 3)
    other = (1 - world) / 2
    assert said[102].confidence == pytest.approx(world * 0.05 / (world * 0.05 + other * 0.9 + other * 0.05), abs=2e-2)
    suffix = (20 + 20 * world) / 40
    assert said[100].confidence == pytest.approx((20 + 20 * suffix) / 40, abs=2e-3)
    assert said[101].confidence == pytest.approx(suffix, abs=2e-3)


# --- toxicity ---------------------------------------------------------------------


def insults(n=240, seed=0):
    rng = random.Random(seed)
    plain, bad = [w for ws in SPEECH.values() for w in ws], ["blockhead", "dimwitted", "rotbrain"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(plain, k=40), int(i % 4 == 0)
        words += rng.choices(bad, k=3) if toxic else []
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_spellings(spark):
    rows, labels = insults()
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.train(docs, marks.filter(~tx.held_out()))
    more = docs_of(spark, [(900, None, None, None), (901, "", None, None), (None, rows[0][1], None, None), (0, *rows[0][1:]), (902, "the of and " * 20_000, None, None)] + [
        (i, "the of and to " + w, None, None) for i, w in enumerate(["blockheads blockkhead", "b l o c k h e a d rotbrain", "bl.ock.head dimmwitted"], 910)])
    found = {r.doc_id: r for r in tx.score(docs.union(more), model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].predicted == dict(labels)[i] for i in held) and len(held) > 20
    assert all(found[i].predicted == 1 for i in (910, 911, 912))
    assert all(found[i].predicted == 0 for i in (900, 901, 902)) and found[900].score == found[901].score
    assert all(0 <= r.score <= 1 for r in found.values())
    assert tx.score(docs.limit(0), model).collect() == []


def test_without_labels(spark):
    docs = docs_of(spark, insults(8)[0])
    model = tx.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in tx.score(docs, model).collect()} == {0}


def test_kernel_bound_and_value():
    """The value is a plain sum over shared subsequences, the bound never below it."""
    def plain(word):
        c, found = f"^{word}$", Counter()
        for i in range(len(c)):
            for a, b in tx.GAPS:
                if i + a + b < len(c):
                    found[c[i] + c[i + a] + c[i + a + b]] += tx.DECAY ** (a + b + 1)
        return found

    marks = tx.Landmarks(["blockhead", "dimwit"])
    for word in ("blockhead", "blokhead", "bxlockhead", "dimwits", "unlike", "aaaa", "é"):
        own = plain(word)
        for n, other in enumerate(map(plain, marks.words)):
            value = sum(own[k] * other[k] for k in own) / np.sqrt(sum(v * v for v in own.values()) * sum(v * v for v in other.values()))
            assert marks.kernel(word)[n] == pytest.approx(value, abs=0.02)
        assert (word in marks.close([word])) == (marks.kernel(word).max() >= tx.LEAST)


@needs_data
def test_languages_of_held_out_documents(spark):
    """The declared languages of rows that training did not read."""
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.QUERIES["op7_language_id"](spark, FOLDER).collect() if r.held_out]
    assert len(rows) > 20 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.lang == lang[r.doc_id] for r in rows if r.kept) >= 0.95 * sum(r.kept for r in rows)
    assert sum(r.kept for r in rows) >= 0.9 * len(rows)


def test_trigrams_do_not_hang_on_slices(monkeypatch):
    text = "Ein  Satz, 12 Wörter; und  noch einer. " * 40
    whole = li.grams(text)
    monkeypatch.setattr(li, "SLICE", 7)
    assert (li.grams(text) == whole).all() and len(li.grams("")) == 0


def test_samples_stay_bounded(spark):
    """One id many times over, and columns of whatever name."""
    docs = spark.createDataFrame([(7, f"text {i} " * 50, "de", "x", 1, "s") for i in range(60)], "doc_id long, text string, lang string, _gone string, _copy int, source string")
    found = sampled(docs, "lang", 20, docs, 30).collect()
    assert len(found) == 20 and all(len(r.text) == 30 for r in found)
    assert li.in_known_language(docs).columns == jj.one_of_each(docs).columns == docs.columns
    odd = docs.withColumnRenamed("_gone", "a.b")
    assert jj.one_of_each(odd.select("lang", "`a.b`", "doc_id", "text")).columns == ["lang", "a.b", "doc_id", "text"]


# --- mixing -----------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % 3] for n, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing_meets_targets(spark):
    rng = random.Random(5)
    sources = ["é", "z", "a", None, "b", "a", "a", "a"]
    rows = [(i, "w " * rng.choice([1, 5, 40, 200]), "en", rng.choice(sources)) for i in range(600)] + [(600, None, None, "a"), (601, "", None, "only empty"), (None, "x y", None, "a"), (5, "repeat of five", None, "a")]
    docs = docs_of(spark, rows)
    found = mx.schedule(docs).collect()
    assert len(found) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    want, taken = brute_targets(sizes), Counter()
    for r in found:
        source = r.row.source
        assert (r.size, r.source_size) == (size(r.row.text), sizes[source])
        assert r.target == pytest.approx(want[source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
    # one document from the target of each source and from the budget
    assert all(abs(taken[s] - want[s]) <= 200 for s in sizes)
    assert 0 <= 1.5 * sum(sizes.values()) - sum(taken.values()) <= 200
    # what is taken is what finishes first
    last = max((r.finish + (r.taken // r.size - 1) * r.source_size / r.target) for r in found if r.taken)
    assert all(r.taken == 2 * r.size or r.finish + (r.taken // r.size) * r.source_size / r.target >= last for r in found if r.size and r.target)
    again = {(r.doc_id, r.size): r.taken for r in mx.schedule(docs).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in found}
    mix = mx.mixed(docs)
    assert mix.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in mix.collect()) == Counter({(r.doc_id, r.row.text): r.taken // r.size for r in found if r.taken})
    assert mx.mixed(docs.limit(0)).collect() == mx.schedule(docs.limit(0)).collect() == []


# --- queries and pipeline -----------------------------------------------------------


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    found, want = queries.QUERIES[name](spark, FOLDER), con.sql(queries.ORACLES[name])
    order = lambda columns, rows: sorted(tuple(repr(r[columns.index(c)]) for c in sorted(columns)) for r in rows)
    assert sorted(found.columns) == sorted(want.columns)
    assert order(found.columns, found.collect()) == order(want.columns, want.fetchall())


@needs_data
def test_pipeline_stages_against_brute_force(spark, tmp_path):
    from test_jaccard_join import brute as near
    from test_lines_and_licenses import brute as lines

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    results = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        results.append(docs)
    first = [(r.doc_id, r.text) for r in results[0].collect()]
    cleaned = {i: kept for i, _, _, kept in lines(first)}
    assert {r.doc_id: r.text for r in results[1].collect()} == cleaned
    assert {r.doc_id for r in results[2].collect()} == {c for _, _, c in near(list(cleaned.items()))}
    copies = {r.doc_id for r in results[3].collect()}
    assert copies <= {r.doc_id for r in results[2].collect()}
    assert all(x.columns == results[0].columns for x in results[:4])
    mixed, used = Counter(r.doc_id for r in results[3].collect()), defaultdict(int)
    packed = results[4].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == mixed
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) * 1.1 + 1
