"""Reject channels, and XML records over the borders of blocks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from semisketch.operators.structure import triples
from semisketch.sources import documents as dox
from semisketch.sources import sinks, tables, xml, xml_scan


def reasons(found):
    return sorted((r.reason, r.text) for r in found.rejects.collect())


def counted(found):
    n = found.docs.count()
    told = found.counts.get
    assert told["documents"] == n
    return {k: v for k, v in told.items() if v}


def test_lines_and_their_rejects(spark, tmp_path):
    lines = ["[", '{"id":"a","x":1},', '{"id":"b","x":}', "no json", "", '{"x":2}', '{"id":"c"} more', "]", " ,", '"text"']
    (tmp_path / "l.json").write_text("\n".join(lines))
    found = dox.check_json_lines(spark, str(tmp_path / "l.json"), "id")
    assert reasons(found) == [("invalid", t) for t in sorted(['{"id":"b","x":}', "no json", '{"id":"c"} more', '"text"'])] + [("no id", '{"x":2}')]
    assert [(r.doc_id, r.body) for r in found.docs.select("doc_id", F.to_json("body").alias("body")).collect()] == [("a", '{"x":1}')]
    assert counted(found) == {"documents": 1, "invalid": 4, "no id": 1}
    assert all(r.file.endswith("l.json") for r in found.rejects.collect())
    assert [r.doc_id for r in dox.read_json_lines(spark, str(tmp_path / "l.json"), "id").collect()] == ["a"]


def test_counts_take_no_second_pass(spark):
    rows = spark.createDataFrame([('{"id":"a"}',), ("{",)], "value string")
    seen = spark.sparkContext.accumulator(0)

    def touched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = dox.checked(dox.parsed_lines(rows.mapInArrow(touched, "value string"), "id"))
    assert counted(found) == {"documents": 1, "invalid": 1} and seen.value == 2


def test_files_and_their_rejects(spark, tmp_path):
    for name, text in {"a.json": '{"x":1}', "b.json": "{", "c.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    found = dox.check_json_dir(spark, str(tmp_path))
    assert sorted((r.doc_id, r.reason) for r in found.rejects.collect()) == [("b", "invalid"), ("c", "empty")]
    assert counted(found) == {"documents": 1, "invalid": 1, "empty": 1}
    sub = tmp_path / "xml"
    sub.mkdir()
    (sub / "a.xml").write_text("<r><x>1</x></r>")
    (sub / "b.xml").write_text("<r><x>1</r>")
    found = xml.check_xml_dir(spark, str(sub))
    assert [(r.doc_id, r.reason) for r in found.rejects.collect()] == [("b", "invalid")]
    assert counted(found) == {"documents": 1, "invalid": 1}


# --- XML records --------------------------------------------------------------

PARTS = [
    "<rec id='{i}'><v>x</v></rec>", "<rec id='{i}' a='>'/>", "<rec\n id=\"{i}\" b='<rec>'><rec>in<rec/></rec></rec>",
    "<rec id='{i}'><![CDATA[</rec> ]]<rec>]]></rec >", "<rec id='{i}'><!-- </rec> -- ' --><a b=\"it's\"/></rec>",
    "<record id='{i}'>other</record>", "<!-- <rec> ' -->", "<?php <rec> ?>", "<recs/>", "words ' \" > here", "<x rec='<rec>'/>",
    "<rec id='{i}'>1 > 0</rec>",
]
HEAD = "<?xml version='1.0'?>\n<!DOCTYPE all [<!ELEMENT all (rec*)> <!ENTITY x '<rec>'>]>\n<all>"


def made_file(n, seed):
    rng = random.Random(seed)
    parts, texts = [HEAD], []
    for i in range(n):
        part = rng.choice(PARTS).format(i=i) + rng.choice(["", "\n"])
        parts.append(part)
        if part.startswith(("<rec ", "<rec\n")):
            texts.append(part.strip())
    return "".join(parts) + "</all>\n", texts


@pytest.mark.parametrize("size", [64, 1_000, 1 << 20])
def test_records_over_blocks(spark, tmp_path, size):
    """Files cut anywhere, in comments, attributes and records within records."""
    wanted = []
    for seed in range(3):
        text, texts = made_file(120, seed)
        (tmp_path / f"{seed}.xml").write_text(text)
        wanted += texts
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        found = xml_scan.record_texts(spark, str(tmp_path), "rec").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.text for r in found) == sorted(wanted)


def test_records_of_many_blocks_join_their_beginnings(spark, tmp_path, monkeypatch):
    text, texts = made_file(200, 9)
    (tmp_path / "a.xml").write_text(text)
    monkeypatch.setattr(xml_scan, "FEW_BLOCKS", 0)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        found = xml_scan.record_texts(spark, str(tmp_path), "rec").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.text for r in found) == sorted(texts)


def test_broken_files_and_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text("</rec><all><rec id='1'><v>1</v></rec></rec><rec id='2'><v></rec><rec><v/></rec><rec id='3'>")
    (tmp_path / "b.xml").write_text("<all><rec id='4'><v>1</v></rec><!-- <rec id='5'/>")
    (tmp_path / "c.xml").write_text("")
    found = xml.check_xml_records(spark, str(tmp_path), "rec", "id")
    assert sorted(r.doc_id for r in found.docs.collect()) == ["1", "4"]
    assert sorted((r.reason, r.text or "", r.file[-5:]) for r in found.rejects.collect()) == [
        ("invalid", "", "a.xml"), ("invalid", "", "b.xml"), ("invalid", "<rec id='2'><v></rec>", "a.xml"), ("no id", "<rec><v/></rec>", "a.xml"),
    ]
    assert counted(found) == {"documents": 2, "invalid": 3, "no id": 1}
    assert sorted(r.doc_id for r in xml.read_xml_records(spark, str(tmp_path), "rec", "id", "skip").collect()) == ["1", "4"]


def test_checked_records_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<all><rec id='1'/><rec/></all>")
    found = xml.check_xml_records(spark, str(tmp_path), "rec", "id")
    for part in (found.docs, found.rejects):
        assert "from_xml" not in part._jdf.queryExecution().optimizedPlan().toString().lower()


def test_nested_records_keep_their_content(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<all><rec id='1'><rec>x</rec><t><![CDATA[</rec>]]></t></rec></all>")
    body = xml.read_xml_records(spark, str(tmp_path), "rec", "id").select(F.to_json("body")).first()[0]
    assert json.loads(body) == {"rec": "x", "t": "</rec>"}


# --- triples ------------------------------------------------------------------

HARD = ['a "b"', "tab\tend", "line\nend\r\n", "back\\slash \\n \\\\", '\\"', "\\", '"', "plain", "ünï 日本"]


def test_lossless_triples(spark, docs, tmp_path):
    rows = triples(docs({str(i): json.dumps({"k": text, "n": 2}) for i, text in enumerate(HARD)}))
    sinks.write_triples(rows, str(tmp_path / "t"), lossless=True)
    read = [tuple(r) for r in tables.read_triples(spark, str(tmp_path / "t"), lossless=True).collect()]
    assert sorted(c for _, k, c in read if k == "k") == sorted(HARD)
    assert [c for _, k, c in read if k == "n"] == ["2"] * len(HARD)
