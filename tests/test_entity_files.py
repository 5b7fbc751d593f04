"""Large arrays and maps: every entity comes out, wherever the blocks are cut."""

import json

import pytest

from semisketch.operators.fingerprint import fingerprint, fingerprint_parts
from semisketch.operators.structure import Shape, triples
from semisketch.sources import documents as dox
from semisketch.sources.entity_files import parsed_entities

ITEMS = [
    {"id": "a", "x": 'br{ack]et "quoted" \\'},
    {"id": "b", "x": {"y": [{"z": {}}, "}", "{\"id\":\"no\"}"]}},
    {"id": "c", "x": "ü" * 70},
    {"id": "d"},
    {"id": "e", "x": [[], [[{}]], {"k": "\\\\\""}]},
]


@pytest.fixture(params=[64, 1 << 20])
def blocks(spark, request):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for key in keys:
        spark.conf.set(key, str(request.param))
    yield request.param
    for key, value in before.items():
        spark.conf.set(key, value)


def found(docs):
    return {r.doc_id: json.loads(r.j) for r in docs.selectExpr("doc_id", "to_json(body) j").collect()}


def test_array(spark, tmp_path, blocks):
    items = [1, "}", *ITEMS, None, [2]]
    (tmp_path / "a.json").write_text(json.dumps(items, indent=2, ensure_ascii=False) + "\n")
    want = {i["id"]: {k: v for k, v in i.items() if k != "id"} for i in ITEMS}
    assert found(dox.read_json_array(spark, str(tmp_path), "id")) == want


@pytest.mark.parametrize("end", ["", " \n"])
def test_map(spark, tmp_path, blocks, end):
    whole = {i["id"]: i for i in ITEMS} | {"n": 5, "o": None, "": 7, "p": "}", "q": [{"r": {}}]}
    (tmp_path / "m.json").write_text(json.dumps(whole) + end)
    want = {k: v for k, v in whole.items() if k and v is not None}
    assert found(dox.read_json_map(spark, str(tmp_path))) == want


def test_last_of_equal_keys(spark, tmp_path, blocks):
    (tmp_path / "m.json").write_text('{"a": {"x": 1}, "b": {"x": 2}, "a": {"x": 3}}')
    assert found(dox.read_json_map(spark, str(tmp_path))) == {"a": {"x": 3}, "b": {"x": 2}}


BAD = [
    '[{"id":"a"},{"id":"b"', '{"id":"a"}', '[{"id":"a"}]]', '[{"id":"a}]', '"x"', '[{"id":"a"},]', '[1,]',
    '[{"id":"a"} {"id":"b"}]',
]


def test_bad_arrays_are_told(spark, tmp_path, blocks):
    for i, text in enumerate(BAD):
        (tmp_path / f"bad{i}.json").write_text(text)
    (tmp_path / "good.json").write_text('[{"id": "g"}]')
    told = dox.rejects(parsed_entities(spark, str(tmp_path), "[")).collect()
    assert {r.reason for r in told} == {"invalid"}
    assert {r.file.rsplit("/", 1)[1] for r in told} == {f"bad{i}.json" for i in range(len(BAD))}
    assert "g" in found(dox.read_json_array(spark, str(tmp_path), "id"))


def test_empty(spark, tmp_path, blocks):
    for name, text in {"a": "[]", "b": " [ ] ", "c": "[1]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert found(dox.read_json_array(spark, str(tmp_path), "id")) == {}
    assert dox.rejects(parsed_entities(spark, str(tmp_path), "[")).count() == 0


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    with open(tmp_path / "a.json", "w") as out:
        out.write(json.dumps([{"id": str(i), "x": "y" * 500} for i in range(20_000)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        docs = dox.read_json_array(spark, str(tmp_path), "id")
        assert docs.select("doc_id").distinct().count() == 20_000 == docs.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_documents_in_parts_are_the_whole_documents(spark, tmp_path, size):
    """Statements and vectors of objects read as one value or cut at their entries."""
    def made(n):
        return {f"k {n} {i}": v for i in range(25) for v in [[{"a": i, "b": [1, {"c": "}{"}]}, "x"] if i % 3 else {"d": {"e": i, "f": None}, "t": 'q"\\'}]} | {"zero": 0, "last": "word"}

    for n in range(3):
        (tmp_path / f"d{n}.json").write_text(json.dumps(made(n), indent=n or None))
    whole = dox.read_json_dir(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        parts = dox.read_json_parts(spark, str(tmp_path))
        assert parts.count() > 3
        for shape in (Shape(), Shape(dialect="v1"), Shape(skip_nulls=False)):
            assert sorted(map(repr, triples(parts, shape).collect())) == sorted(map(repr, triples(whole, shape).collect()))
        found = {(r.doc_id, r.L): (r.statements, r.fp) for r in fingerprint_parts(parts, "5 9").collect()}
        want = {(r.doc_id, r.L): (r.statements, r.fp) for r in fingerprint(whole, "5 9").collect()}
        assert set(found) == set(want)
        for k, (n, fp) in want.items():
            assert found[k][0] == n and found[k][1] == pytest.approx(fp, abs=2e-3)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
