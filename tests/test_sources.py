import bz2
import gzip
import json

import pytest
from pyspark.sql import functions as F

from semisketch.operators.fingerprint import fingerprint, joined_lengths
from semisketch.operators.naming import simplify_names
from semisketch.operators.structure import Shape, triples
from semisketch.sources import documents as dox
from semisketch.sources import sinks, tables, xml


def bodies(df):
    return {r.doc_id: json.loads(r.j) for r in df.select("doc_id", F.to_json("body").alias("j")).collect()}


@pytest.mark.parametrize(
    "text, reason",
    [
        ('{"a":1},{"b":2}', "invalid"), ('{"a":1}]', "invalid"), ('1,"e":2', "invalid"),
        ('1},{"d":2', "invalid"), ("[1", "invalid"), ('{"a":1} x', "invalid"), ("[NaN]", "invalid"),
        ("", "empty"), ("  ", "empty"), (None, "empty"), ("[]", "empty"), ("{ }", "empty"),
        ("0", "empty"), ("0.0", "empty"), ("false", "empty"), ("null", "empty"), ('""', "empty"),
        ('{"a":1}', None), (' {"a":1}\n', None), ('"false"', None), ('{"a":""}', None),
        ('{"a":1,"a":2}', None),
    ],
)
def test_valid_docs(spark, text, reason):
    rows = spark.createDataFrame([("d", text)], "doc_id string, text string")
    parsed = dox.parse_documents(rows)
    assert parsed.select("reason").first().reason == reason
    assert dox.valid_docs(parsed).count() == (reason is None)
    assert dox.rejects(parsed).count() == (reason is not None)


ENTITIES = {
    "a1": {"x": "v", "list": ["1", "2"], "sub": {"y": "2.5"}},
    "b/2 #": {"x": "w", "sub": {"y": "7"}},
    "c": {"x": "w", "list": ["q", "r", "s"]},
}
NAMES = {"a1": "a1", "b/2 #": "b2", "c": "c"}


def as_xml(fields):
    out = []
    for k, v in fields.items():
        for one in v if isinstance(v, list) else [v]:
            out.append(f"<{k}>{as_xml(one) if isinstance(one, dict) else one}</{k}>")
    return "".join(out)


def test_same_entities_from_every_source(spark, tmp_path):
    with_id = [{"id": k, **v} for k, v in ENTITIES.items()]
    (tmp_path / "array.json").write_text(json.dumps(with_id, indent=1))
    (tmp_path / "map.json").write_text(json.dumps({**ENTITIES, "": {"x": "v"}, "n": None}))
    lines = ",\n".join(json.dumps(e) for e in with_id)
    with gzip.open(tmp_path / "lines.json.gz", "wt") as f:
        f.write(f'[\n{lines}\n]\n{{"no":"id"}}\n{{"id":"bad",}}\n')
    (tmp_path / "all.xml").write_text(
        '<?xml version="1.0"?>\n<all>\n'
        + "\n".join(f"<rec id='{k}'>{as_xml(v)}</rec>" for k, v in ENTITIES.items())
        + "\n</all>"
    )
    for kind in ("dir", "xmldir"):
        (tmp_path / kind).mkdir()
    for k, v in ENTITIES.items():
        (tmp_path / "dir" / f"{NAMES[k]}.json").write_text(json.dumps(v, indent=1))
        (tmp_path / "xmldir" / f"{NAMES[k]}.xml").write_text(f"<r>\n {as_xml(v)}\n</r>")
    (tmp_path / "xmldir" / "bad.xml").write_text("<r><a></r>")
    p = str(tmp_path)
    found = {
        "array": dox.read_json_array(spark, f"{p}/array.json", "id"),
        "map": dox.read_json_map(spark, f"{p}/map.json"),
        "lines": dox.read_json_lines(spark, f"{p}/lines.json.gz", "id"),
        "records": xml.read_xml_records(spark, f"{p}/all.xml", "rec", "id"),
        "dir": dox.read_json_dir(spark, f"{p}/dir", only_json=True),
        "xmldir": xml.read_xml_dir(spark, f"{p}/xmldir"),
    }
    expected = {NAMES[k]: v for k, v in ENTITIES.items()}
    assert bodies(found["dir"]) == expected
    first = sorted(fingerprint(found["dir"], 13).collect())
    for name, docs in found.items():
        assert bodies(docs) == expected, name
        assert sorted(fingerprint(docs, 13).collect()) == first, name


def test_file_names_and_trees(spark, tmp_path):
    sub = tmp_path / "one" / "sub dir"
    sub.mkdir(parents=True)
    (tmp_path / "one" / "a+b%20.json").write_text('{"x":1}')
    with gzip.open(tmp_path / "one" / "z.json.gz", "wt") as f:
        f.write('{"x":2}')
    with bz2.open(sub / "b.json.bz2", "wt") as f:
        f.write('{\n"x":3}')
    (tmp_path / "one" / "wrong.json").write_text('{"x":4},{"x":5}')
    flat = bodies(dox.read_json_dir(spark, str(tmp_path / "one")))
    tree = bodies(dox.read_json_tree(spark, str(tmp_path / "one")))
    assert flat == {"a+b%20": {"x": 1}, "z": {"x": 2}}
    assert tree == {**flat, "sub dir/b": {"x": 3}}


@pytest.mark.parametrize(
    "text, body",
    [
        ('<r id="7"><a>1</a><a>2</a><b x="1">t &amp; u</b></r>', {"id": "7", "a": ["1", "2"], "b": {"x": "1", "content": "t & u"}}),
        ("<r><c/><d></d><e y='2'/></r>", {"c": {}, "d": {}, "e": {"y": "2"}}),
        ("<r><n>007</n><t>true</t><z>0.0</z><d>2020-01-01</d></r>", {"n": "007", "t": "true", "z": "0.0", "d": "2020-01-01"}),
        ("<r><!-- <x/> --><p><s/></p><p/></r>", {"p": [{"s": {}}, {}]}),
        ("<r/>", {}), ("<r>just</r>", "just"), ("<r><a>", None),
        ("<r><a><![CDATA[007]]></a><b><![CDATA[true]]></b></r>", {"a": "007", "b": "true"}),
        ("<r><a><![CDATA[x <!-- kept --> & <b>]]></a><!-- <![CDATA[gone]]> --></r>", {"a": "x <!-- kept --> & <b>"}),
        ("<r><a>1<![CDATA[2]]>3</a></r>", {"a": "123"}),
        ("<r x='1>2'><a y=\"3>4\">007</a></r>", {"x": "1>2", "a": {"y": "3>4", "content": "007"}}),
        ("<r><a>u\ue000v\ue001w&#xE000;</a><b>\ue001a</b></r>", {"a": "u\ue000v\ue001w\ue000", "b": "\ue001a"}),
    ],
)
def test_xml_bodies(spark, text, body):
    row = spark.createDataFrame([(text,)], "t string").select(F.to_json(xml.xml_body(F.col("t"))))
    found = row.first()[0]
    assert (found and json.loads(found)) == body


def test_missing_ids(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<all><rec><v>1</v></rec></all>")
    with pytest.raises(Exception, match="entity without id"):
        xml.read_xml_records(spark, str(tmp_path / "r.xml"), "rec", "id").collect()
    skipped = xml.read_xml_records(spark, str(tmp_path / "r.xml"), "rec", "id", "skip")
    assert skipped.count() == 0


def test_fingerprint_text_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    fps = fingerprint(docs({"a": '{"x":1}', "b": '{"y":[1,2]}'}), "5 7")
    sinks.write_fingerprints(joined_lengths(fps), path, compression="gzip")
    lines = [r.value.split("\t") for r in spark.read.text(path).collect()]
    assert sorted((p[0], p[1], len(p)) for p in lines) == [("a", "1", 14), ("b", "4", 14)]
    read = {r.doc_id: r for r in tables.read_fingerprints(spark, path, 7, 6).collect()}
    sevens = {r.doc_id: r.fp for r in fps.where("L = 7").collect()}
    assert {k: r.fp for k, r in read.items()} == sevens
    with pytest.raises(Exception, match="fewer than 20 columns of values"):
        tables.read_fingerprints(spark, path, 20).collect()


def test_shards_and_lists(spark, docs, tmp_path):
    fps = fingerprint(docs({str(i): f'{{"x":{i + 1}}}' for i in range(40)}), 5)
    sinks.write_sharded(fps, str(tmp_path / "s"), 4)
    files = sorted(str(p) for p in (tmp_path / "s").glob("part-*"))
    assert len(files) == 4
    (tmp_path / "list").write_text("\n".join(files + [str(tmp_path / "gone"), ""]))
    kept = tables.read_file_list(spark, str(tmp_path / "list"))
    assert sorted(kept) == files
    assert tables.read_fingerprints(spark, kept, 5).count() == 40


def test_triple_files(spark, docs, tmp_path):
    rows = triples(docs({"d": '{"a":{"x":1.5,"y":"two words","z":false},"b":[3,null]}'}), Shape("v1"))
    sinks.write_triples(rows, str(tmp_path / "t"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "t")).collect()}
    assert '"a"\t"x"\t"1.5"' in lines and '"a"\t"z"\tFalse' in lines
    assert '"b"\t3\t"None"' in lines and '"b"\t"None"\t2' in lines
    read = tables.read_triples(spark, str(tmp_path / "t")).collect()
    assert ("a", "y", "two words") in {tuple(r) for r in read} and len(read) == len(lines)


def test_simplify_names(spark):
    def simple(*names):
        rows = spark.createDataFrame([(n,) for n in names], "name string")
        return {r.name: r.simple for r in simplify_names(rows).collect()}

    assert simple("x/a/1.gz", "x/b/1.gz") == {"x/a/1.gz": "a", "x/b/1.gz": "b"}
    assert simple("x/a.b", "x/c.d") == {"x/a.b": "a.b", "x/c.d": "c.d"}
    assert simple("same/1", "same/1") == {"same/1": None}


def test_a_text_too_large_for_a_variant_ends_the_job(spark):
    rows = spark.createDataFrame([("a", '{"x":1}'), ("b", '{"x":1' + " " * 50), ("c", "{")], "doc_id string, text string")
    parsed = dox.parse_documents(rows, sure_bytes=40)
    assert {r.doc_id: r.reason for r in parsed.collect()} == {"a": None, "b": "too large", "c": "invalid"}
    with pytest.raises(Exception, match="too large for one variant"):
        dox.valid_docs(parsed).collect()
