import json
import random

import pytest
from pyspark.sql import functions as F

from semisketch.operators.fingerprint import tokens_of
from semisketch.operators.structure import (
    Shape,
    child_counts,
    nodes,
    statement_count,
    statements,
    triple_text,
    triples,
    triples_preorder,
)
from semisketch.plans import catalog, inputs


def found(df):
    return sorted((r.name, r.key, r.cargo) for r in df.collect())


def token(x):
    if x is None:
        return "u"
    if isinstance(x, bool):
        return "b" + str(x).lower()
    if isinstance(x, int):
        return f"i{x}"
    return f"f{x}" if isinstance(x, float) else f"s{x}"


def walk(x, shape, name="sroot", out=None):
    """Plain model of the statements of a value; returns (cargo token, statements)."""
    out = [] if out is None else out
    while isinstance(x, list) and len(x) == 1:
        x = x[0]
    v1 = shape.dialect == "v1"

    def kept(v):
        if not shape.skip_nulls:
            return True
        if isinstance(v, (dict, list)):
            return bool(v) or not v1
        if isinstance(v, bool):
            return True
        if v1:
            return isinstance(v, int) or bool(v)
        return v not in (None, "", "0", 0)

    if isinstance(x, dict):
        used = 0
        for k, v in x.items():
            if k in shape.exclude_keys or not kept(v):
                continue
            out.append((name, f"s{k}", walk(v, shape, f"s{k}", out)[0]))
            used += 1
        return (f"i{used}" if used or v1 else "u"), out
    if isinstance(x, list):
        if not x:
            return ("i0" if v1 and shape.arrays_are_sets else "u"), out
        if shape.arrays_are_sets:
            used = 0
            for i, v in enumerate(x):
                if kept(v):
                    out.append((name, f"i{i}", walk(v, shape, f"i{i}", out)[0]))
                    used += 1
            return (f"i{used}" if used or v1 else "u"), out
        cargo = [walk(v, shape, f"i{i}", out)[0] for i, v in enumerate(x)]
        for before, after in zip(["i0"] + cargo, cargo + [f"i{len(x)}"]):
            out.append((name, before, after))
        return f"i{len(x)}", out
    return token(x), out


def invented(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {rng.choice("abcdef"): invented(rng, depth - 1) for _ in range(rng.randrange(4))}
    if depth and kind < 0.7:
        return [invented(rng, depth - 1) for _ in range(rng.choice([0, 1, 1, 2, 3]))]
    return rng.choice([None, "", "0", "0.0", 0, 7, -3, 1.5, True, False, "text", "é"])


@pytest.mark.parametrize(
    "shape",
    [
        Shape(),
        Shape(dialect="v1"),
        Shape(skip_nulls=False),
        Shape(arrays_are_sets=True),
        Shape(dialect="v1", arrays_are_sets=True),
        Shape(exclude_keys=("a", "b")),
    ],
)
def test_against_plain_model(spark, docs, shape):
    rng = random.Random(5)
    values = [{"k": invented(rng, 5), "l": invented(rng, 4)} for _ in range(60)]
    got = {}
    for r in triples(docs({str(i): json.dumps(v) for i, v in enumerate(values)}), shape).collect():
        got.setdefault(int(r.doc_id), []).append((r.name, r.key, r.cargo))
    for i, value in enumerate(values):
        assert sorted(got.get(i, [])) == sorted(walk(value, shape)[1]), json.dumps(value)


def test_deeper_than_one_round(docs):
    value = {"end": "x"}
    for _ in range(40):
        value = {"a": [[value]], "b": 1}
    assert statement_count(docs({"d": json.dumps(value)})).first().statements == 81


def test_base_is_the_key_above(docs):
    rows = triples(docs({"d": '{"a":[[{"x":1}],{"y":2}]}'})).where("kind = 'object'").collect()
    assert {(r.key, r.base) for r in rows} == {("sa", "i0"), ("sx", "i0"), ("sy", "i1")}


def test_repeated_keys_and_big_numbers(docs):
    rows = triples(docs({"d": '{"a":1,"a":2,"big":12345678901234567890,"f":1e3}'}))
    assert found(rows) == [
        ("sroot", "sa", "i2"),
        ("sroot", "sbig", "i12345678901234567890"),
        ("sroot", "sf", "f1000.0"),
    ]


def test_paths_keep_odd_keys(docs):
    rows = nodes(docs({"d": '{"a.b/c":{"[0]":1}}'})).collect()
    assert [r.path for r in rows] == [["a.b/c"], ["a.b/c", "[0]"]]


def test_preorder(docs):
    text = '{"a":{"x":1,"y":0},"b":["q"],"c":[{"k":1,"m":2}],"d":["u",["v"],{"w":3}],"e":null}'
    assert found(triples_preorder(docs({"d": text}))) == sorted(
        [
            ("sroot", "sa", "i1"), ("sa", "sx", "i1"), ("sroot", "sb", "sq"),
            ("sroot", "sc", "i2"), ("sc", "sk", "i1"), ("sc", "sm", "i2"), ("sroot", "sd", "i3"),
            ("sd", "i0", "su"), ("sd", "su", "i1"), ("sd", "i1", "i1"), ("sd", "i1", "i3"),
            ("sd", "sw", "i3"),
        ]
    )


def filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Filter " in line]


def test_documents_are_walked_once(docs):
    """No filter on a list that is exploded walks the documents again."""
    found = docs({"a": '{"x":[1,{"y":2}],"z":"w"}'})
    tables = [triples(found), triples(found, kind="array"), triples_preorder(found), nodes(found), child_counts(found), tokens_of(found)]
    assert [line for t in tables for line in filters(t) if "aggregate(" in line] == []


@pytest.mark.parametrize("shape", [Shape(), Shape(dialect="v1"), Shape(arrays_are_sets=True)])
def test_a_walk_has_no_costly_expressions(docs, shape):
    """What looks branches up in a list or makes a lazy list of its inputs is slow where
    it is interpreted, once for each node of each document."""
    plan = triples(docs({"a": '{"x":[1,{"y":2}],"z":"w"}'}), shape)._jdf.queryExecution().optimizedPlan().toString()
    (line,) = [s for s in plan.splitlines() if "struct(statements" in s and "aggregate(" in s]
    assert "CASE WHEN" not in line and "concat(" not in line


def test_documents_of_any_depth(docs):
    """Documents that end inside a round, at its end and far below it."""
    for depth in range(1, 9):
        value = {"end": "x"}
        for _ in range(depth):
            value = {"a": {"c": value}, "b": [1, {"d": 2}]}
        got = found(triples(docs({"d": json.dumps(value)})))
        assert got == sorted(walk(value, Shape())[1])


def test_rows_are_spread_over_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(inputs, "TASK_ROWS", 10)
    rows = inputs.spread(spark.range(0, 205, 1, 4))
    assert rows.rdd.getNumPartitions() == 21 and rows.count() == 205


def test_single_files_are_written_by_many_tasks(spark, tmp_path):
    texts = spark.range(0, 40, 1, 1).selectExpr("cast(id as string) as text")
    catalog._single_files(texts, str(tmp_path / "files"))
    names = [f.name for f in (tmp_path / "files").glob("part-*")]
    assert len(names) == 40 and len({n[:10] for n in names}) > 1


ODD = [None, "", "0", "0.0", "{}", "[]", "-", "-0", "true", "é", 0, -3, 0.5, 10**20, False, {}, [], [0], [None], [""], [{}], [[[]]]]


@pytest.mark.parametrize("shape", [Shape(), Shape(dialect="v1"), Shape(arrays_are_sets=True), Shape(skip_nulls=False)])
def test_members_are_counted_by_their_texts(docs, shape):
    """A count describes only those members whose text may be that of nothing."""
    values = [{"k": {"x": v, "y": [v, v], "z": 1}} for v in ODD] + [{"k": dict(enumerate(ODD)), "l": ODD}]
    rows = triples(docs({str(i): json.dumps(v) for i, v in enumerate(values)}), shape)
    got = {}
    for r in rows.collect():
        got.setdefault(int(r.doc_id), []).append((r.name, r.key, r.cargo))
    for i, value in enumerate(json.loads(json.dumps(values))):
        assert sorted(got[i]) == sorted(walk(value, shape)[1]), json.dumps(value)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert (" >= 1)" in plan) == shape.skip_nulls


def test_texts_of_tokens_are_cut_once(docs):
    rows = triple_text(triples(docs({"a": '{"x":1}'})))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert plan.startswith("Project") and "length(" not in plan


def test_one_kind_is_made_alone(docs):
    """The walk makes statements of the wanted kind only, and those are the same."""
    texts = [
        '{"a":{"b":[1,[2,{"g":"x","h":[3]}]]},"c":[[]],"d":[{}],"e":null,"f":0,"g":"","h":"0"}',
        '[1,null,0,"",{"a":0},{"a":null},[0,0],[[1]],{}]',
        '{"x":[{"y":[1,2,{"z":[{"q":[5,6,[7,8,[9,10,{"w":{"v":"1"}}]]]}]}]},true]}',
        '{"MedicationOrder":{}}',
    ]
    table = docs({str(i): t for i, t in enumerate(texts)})
    for shape in (Shape(), Shape(dialect="v1", arrays_are_sets=True)):
        every = triples(table, shape).collect()
        for kind in ("object", "array", "set"):
            made = table.select(F.explode(statements(shape, kind)).alias("s")).select("s.kind").distinct().collect()
            assert {r.kind for r in made} <= {kind}
            assert triples(table, shape, kind).collect() == [r for r in every if r.kind == kind]
