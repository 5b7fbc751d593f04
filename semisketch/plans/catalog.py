"""The registered queries, one per operator, over the given tables in full.

Source and sink queries first write a table in the form needed to a new folder and
read it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, tokens
from ..functions.arrays import cells
from ..functions.vectors import Encoding, token_vector
from ..operators import analysis, fingerprint as fpr, index as idx, naming, search, structure as st
from ..operators.dictionary import TokenDictionary
from ..session import scratch_folder
from ..sources import documents as dox, sinks, tables as tab, xml
from ..streaming import jobs
from . import inputs as inp
from . import oracles as orc

L = 13
CUTOFF = 0.3
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

V1 = st.Shape(dialect="v1")


def register(sql: str | None = None, name: str | None = None):
    def add(build):
        QUERIES[name or build.__name__] = build
        if sql is not None:
            ORACLES[name or build.__name__] = sql
        return build

    return add


# --- sources ------------------------------------------------------------------


def _triple_rows(docs: DataFrame) -> DataFrame:
    return st.triple_text(st.triples(docs)).select("doc_id", "name", "key", "cargo")


def _by_own_id(docs: DataFrame) -> DataFrame:
    """Documents named by their id field, the file's name put aside."""
    own = dox.entities(docs.select("body"), "id")
    return _triple_rows(own)


def _single_files(texts: DataFrame, path: str, *by: str) -> str:
    """A file for each row, written by all cores: a file takes milliseconds."""
    inp.spread(texts).write.option("maxRecordsPerFile", 1).partitionBy(*by).text(path)
    return path


@register(orc.supplier_sql())
def read_json_dir(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    _single_files(inp.supplier_texts(spark, folder).select("text"), path)
    return _by_own_id(dox.read_json_dir(spark, path))


_FOLDER_SQL = (
    "select 'nation=' || s_nationkey as folder, t.* from supplier "
    f"join ({orc.supplier_sql()}) t on t.doc_id = 's' || s_suppkey"
)


def _folders(docs: DataFrame) -> DataFrame:
    """Statements of documents named by folder and own id."""
    own = tokens.sanitize_id(dox.field(F.col("body"), "id"))
    named = docs.select(
        F.concat_ws("/", F.substring_index("doc_id", "/", 1), own).alias("doc_id"),
        dox.drop_id_field(F.col("body"), "id").alias("body"),
    )
    folder, doc = (F.substring_index("doc_id", "/", i).alias(n) for i, n in ((1, "folder"), (-1, "doc_id")))
    return _triple_rows(named).select(folder, doc, "name", "key", "cargo")


@register(_FOLDER_SQL)
def read_json_tree(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    rows = inp.supplier_records(spark, folder)
    texts = rows.select(
        F.col("nation.key").alias("nation"), F.to_json(F.struct(*rows.columns)).alias("text")
    )
    return _folders(dox.read_json_tree(spark, _single_files(texts, path, "nation")))


def _batched(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier records in batches of up to 100, by the number in their name."""
    rows = inp.supplier_records(spark, folder)
    number = F.element_at("tags", 2).cast("long")
    return rows.withColumn("batch", F.floor(number / 100))


@register(orc.supplier_sql())
def read_json_array(spark: SparkSession, folder: str) -> DataFrame:
    rows = _batched(spark, folder)
    record = F.struct(*[c for c in rows.columns if c != "batch"])
    texts = rows.groupBy("batch").agg(F.to_json(F.collect_list(record)).alias("text"))
    path = _single_files(texts.select("text"), scratch_folder(spark))
    return _triple_rows(dox.read_json_array(spark, path, "id"))


@register(orc.supplier_sql())
def read_json_map(spark: SparkSession, folder: str) -> DataFrame:
    rows = _batched(spark, folder)
    record = F.struct(*[c for c in rows.columns if c not in ("batch", "id")])
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("id"), record)))
    texts = rows.groupBy("batch").agg(F.to_json(pairs).alias("text"))
    path = _single_files(texts.select("text"), scratch_folder(spark))
    return _triple_rows(dox.read_json_map(spark, path))


_PARTS_SQL = f"""with s as ({orc.supplier_sql()})
select case when name = 'root' then 's ' || substr(doc_id, 2) else name end as name, key, cargo from s
union all select 'root', 's ' || substr(doc_id, 2), cast(count(*) as varchar) from s where name = 'root' group by doc_id"""


@register(_PARTS_SQL)
def read_json_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one object each, as documents that come in parts."""
    rows = _batched(spark, folder)
    record = F.struct(*[c for c in rows.columns if c not in ("batch", "id")])
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("id"), record)))
    texts = rows.groupBy("batch").agg(F.to_json(pairs).alias("text"))
    path = _single_files(texts.select("text"), scratch_folder(spark))
    return _triple_rows(dox.read_json_parts(spark, path)).drop("doc_id")


def _write_lines(spark: SparkSession, folder: str, compression: str = "none") -> str:
    path = scratch_folder(spark)
    lines = inp.supplier_texts(spark, folder).select(F.concat("text", F.lit(",")))
    lines.write.option("compression", compression).text(path)
    return path


@register(orc.supplier_sql())
def read_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _triple_rows(dox.read_json_lines(spark, _write_lines(spark, folder), "id"))


@register(f"{orc.supplier_sql()} union all ({orc.supplier_sql()})")
def read_compressed(spark: SparkSession, folder: str) -> DataFrame:
    read = [
        dox.read_json_lines(spark, _write_lines(spark, folder, codec), "id")
        for codec in ("gzip", "bzip2")
    ]
    return _triple_rows(read[0].unionByName(read[1]))


@register(orc.supplier_sql())
def read_xml_records(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    rows = inp.supplier_records(spark, folder)
    rows.write.format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").save(path)
    return _triple_rows(xml.read_xml_records(spark, path, "supplier", "id"))


def _xml_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = inp.supplier_records(spark, folder)
    text = F.to_xml(F.struct(*rows.columns), {"rowTag": "supplier"})
    return rows.select(F.col("nation.key").alias("nation"), text.alias("text"))


@register(orc.supplier_sql())
def read_xml_dir(spark: SparkSession, folder: str) -> DataFrame:
    path = _single_files(_xml_texts(spark, folder).select("text"), scratch_folder(spark))
    return _by_own_id(xml.read_xml_dir(spark, path))


@register(_FOLDER_SQL)
def read_xml_tree(spark: SparkSession, folder: str) -> DataFrame:
    path = _single_files(_xml_texts(spark, folder), scratch_folder(spark), "nation")
    return _folders(xml.read_xml_tree(spark, path))


_CELLS_3 = (
    "select cast(vec_id as varchar) as doc_id, cast(label as varchar) as statements, "
    "cast(unnest(range(len(embedding))) as int) as i, "
    "round(cast(unnest(embedding) as double), 3) + 0.0 as v from embeddings"
)


def _collection(spark: SparkSession, folder: str, **options) -> str:
    path = scratch_folder(spark)
    sinks.write_fingerprints(inp.embedding_fps(spark, folder), path, **options)
    return path


def _collection_cells(fps: DataFrame) -> DataFrame:
    named = fps.withColumn("statements", F.get("meta", F.lit(0)))
    return cells(named, "fp", "doc_id", "statements", decimals=3)


@register(_CELLS_3)
def read_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return _collection_cells(tab.read_fingerprints(spark, _collection(spark, folder), 64))


@register(_CELLS_3)
def read_file_list(spark: SparkSession, folder: str) -> DataFrame:
    path, listing = _collection(spark, folder), scratch_folder(spark)
    files = spark.read.text(path).select(F.col("_metadata.file_path").alias("f")).distinct()
    names = files.select(F.explode(F.array("f", F.concat("f", F.lit(".missing")))))
    names.write.text(listing)
    return _collection_cells(
        tab.read_fingerprints(spark, tab.read_file_list(spark, listing), 64)
    )


_TRIPLE_FILE_SQL = (
    f"select name, key, coalesce(cargo, 'None') as cargo from ({orc.supplier_sql()})"
)


def _supplier_docs(spark: SparkSession, folder: str) -> DataFrame:
    # a file for each of them may follow, so all cores take part
    texts = inp.spread(inp.supplier_texts(spark, folder)).toDF("doc_id", "text")
    return dox.entities(dox.valid_docs(dox.parse_documents(texts)), "id")


@register(_TRIPLE_FILE_SQL)
def read_triples(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    sinks.write_triples(st.triples(_supplier_docs(spark, folder)), path)
    return tab.read_triples(spark, path)


_RANK_SQL = f"with {orc._RANKS} select id, i, cast(r as int) as r from rk"


def _stored_index(spark: SparkSession, folder: str) -> str:
    path = scratch_folder(spark)
    idx.append_index(inp.embedding_fps(spark, folder), path, 64)
    return path


@register(_RANK_SQL)
def read_index(spark: SparkSession, folder: str) -> DataFrame:
    stored = idx.read_index(spark, _stored_index(spark, folder))
    return stored.select("id", F.posexplode("ranks").alias("i", "r"))


# --- sinks --------------------------------------------------------------------

_LINES_SQL = _CELLS_3


def _line_cells(lines: DataFrame, *more: str) -> DataFrame:
    parts = lines.select(*more, F.split("value", "\t").alias("p"))
    rows = parts.select(
        *more,
        F.get("p", F.lit(0)).alias("doc_id"),
        F.get("p", F.lit(1)).alias("statements"),
        F.transform(F.slice("p", 3, 64), lambda x: x.cast("double")).alias("fp"),
    )
    return cells(rows, "fp", *more, "doc_id", "statements", decimals=3)


@register(_LINES_SQL)
def write_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return _line_cells(spark.read.text(_collection(spark, folder, compression="gzip")))


@register(f"select 4 as shards, c.* from ({_LINES_SQL}) c")
def write_sharded(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    sinks.write_sharded(inp.embedding_fps(spark, folder), path, 4)
    lines = spark.read.text(path)
    shards = lines.select("_metadata.file_name").distinct().count()
    return _line_cells(lines.withColumn("shards", F.lit(shards)), "shards")


@register(
    "select doc_id, '\"' || name || '\"' || chr(9) || case when kind = 'array' and key = '0' then '0' "
    "else '\"' || key || '\"' end || chr(9) || case when isint then cargo else '\"' || coalesce(cargo, 'None') || '\"' end as value "
    f"from (with {orc.supplier_statements()} select doc_id, kind, substr(name, 2) as name, "
    "substr(key, 2) as key, case when cargo <> 'u' then substr(cargo, 2) end as cargo, "
    "cargo[1] = 'i' as isint from st)"
)
def write_triples(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    sinks.write_triples(st.triples(_supplier_docs(spark, folder)), path, by_document=True)
    return spark.read.option("inferSchema", False).text(path).select(
        F.col("doc_id").cast("string"), "value"
    )


@register("select 'root' as name, 'text' as key, md5(text) as cargo from documents where text <> '' union all "
          "select 'root', 'doc', md5('d' || doc_id) from documents")
def read_triples_lossless(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes, tabs and line ends, written and read back."""
    rows = inp.table(spark, folder, "documents").where("doc_id is not null")
    body = F.to_json(F.struct(F.concat(F.lit("d"), "doc_id").alias("doc"), F.when(F.col("text") != "", F.col("text")).alias("text")))
    docs = dox.documents_from(rows.select("doc_id", body.alias("text")), "doc_id", "text")
    path = scratch_folder(spark)
    sinks.write_triples(st.triples(docs), path, lossless=True)
    return tab.read_triples(spark, path, lossless=True).withColumn("cargo", F.md5("cargo"))


@register(_RANK_SQL)
def append_index(spark: SparkSession, folder: str) -> DataFrame:
    path, fps = scratch_folder(spark), inp.embedding_fps(spark, folder)
    idx.append_index(fps.where(F.col("statements") == 0), path, 64)
    idx.append_index(fps, path, 64)
    return idx.stored_index(spark, path).select("id", F.posexplode("ranks").alias("i", "r"))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return idx.index_entries(inp.embedding_fps(spark, folder))


@register(f"with {orc._SELF} select q, t, round(corr, 9) as corr from cp where corr >= {CUTOFF} and q <> t")
def write_pairs(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    sinks.write_pairs(search.pairs(_entries(spark, folder), cutoff=CUTOFF), path)
    read = spark.read.csv(path, sep="\t", schema="q string, t string, corr double")
    return read.withColumn("corr", F.round("corr", 9))


_HIST = (
    f"with {orc._SELF} select (cast(trunc(corr * 100 + 100) as int) - 100) / 100.0 as corr, "
    "cast(sum(pairs) as bigint) as pairs from cp group by 1"
)


@register(f"select round(corr, 2) + 0.0 as CORR, pairs as PAIRS from ({_HIST})")
def write_histogram(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    sinks.write_histogram(search.corr_histogram(_entries(spark, folder)), path)
    read = spark.read.csv(path, sep="\t", header=True, schema="CORR double, PAIRS long")
    return read.withColumn("CORR", F.round("CORR", 2) + F.lit(0.0))


# --- projections and filters --------------------------------------------------


@register(orc.triples_sql("not (name = 'sroot' and key = 'sstatus')"))
def drop_id_field(spark: SparkSession, folder: str) -> DataFrame:
    docs = inp.order_docs(spark, folder)
    return st.triple_text(
        st.triples(docs.withColumn("body", dox.drop_id_field(F.col("body"), "status")))
    )


@register("select c_custkey, regexp_replace(c_name || ' (' || c_mktsegment || ')', "
          "'[^A-Za-z0-9_.\\-=,+*:;@^`|~]+', '', 'g') as id from customer")
def sanitize_id(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))
    return inp.table(spark, folder, "customer").select(
        "c_custkey", tokens.sanitize_id(name).alias("id")
    )


@register("select c_custkey, case when c_custkey % 5 = 3 then c_name || '.txt' "
          "when c_custkey % 5 = 4 then c_name || '.gz' else c_name end as id from customer")
def file_stem_id(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.array(*map(F.lit, [".json", ".json.gz", ".json.bz2", ".txt", ".gz.json"]))
    name = F.concat("c_name", F.get(kinds, (F.col("c_custkey") % 5).cast("int")))
    return inp.table(spark, folder, "customer").select(
        "c_custkey", tokens.file_stem(name, "json").alias("id")
    )


@register("select c_custkey, c_mktsegment || '.' || c_name as simple from customer")
def simplify_names(spark: SparkSession, folder: str) -> DataFrame:
    customers = inp.table(spark, folder, "customer")
    path = F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/"), "c_name", F.lit(".json.gz"))
    named = customers.select("c_custkey", path.alias("name"))
    return naming.simplify_names(named).select("c_custkey", "simple")


@register("select l_orderkey || '-' || l_linenumber as doc_id, l_returnflag as flag, cast(i as int) as i, "
          "round(v, 6) + 0.0 as v from (select *, unnest(range(4)) as i, "
          "unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as v from lineitem)")
def slice_columns(spark: SparkSession, folder: str) -> DataFrame:
    lines = inp.table(spark, folder, "lineitem")
    columns = ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    key = F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"))
    parts = lines.select(F.array(key, *[F.col(c).cast("string") for c in columns]).alias("parts"))
    fps = tab.slice_columns(parts, 4, 2)
    return cells(fps.withColumn("flag", F.get("meta", F.lit(0))), "fp", "doc_id", "flag")


@register("select cast(vec_id as varchar) as doc_id, cast(unnest(range(len(embedding))) as int) as i, "
          "round(cast(unnest(embedding) as double), 3) + 0.0 as v from embeddings")
def round_fp(spark: SparkSession, folder: str) -> DataFrame:
    return cells(fpr.round_fp(inp.embedding_fps(spark, folder), 3), "fp", "doc_id")


@register("select cast(o_orderkey as varchar) as doc_id, case o_orderkey % 5 when 0 then 'invalid' "
          "when 1 then 'empty' when 2 then 'invalid' when 3 then 'empty' end as reason from orders")
def valid_docs(spark: SparkSession, folder: str) -> DataFrame:
    case, text = F.col("doc_id").cast("long") % 5, F.col("text")
    spoilt = (
        F.when(case == 0, F.concat(text, F.lit(',{"x":1}')))
        .when(case == 1, "{ }")
        .when(case == 2, F.expr("substring(text, 1, length(text) - 1)"))
        .when(case == 3, " ")
        .otherwise(text)
    )
    parsed = dox.parse_documents(inp.order_texts(spark, folder).withColumn("text", spoilt))
    good = dox.valid_docs(parsed).select("doc_id", F.lit(None).cast("string").alias("reason"))
    return dox.rejects(parsed).unionByName(good)


def _spoilt_case(key: str, cases: dict[int, str]) -> str:
    listed = " ".join(f"when {n} then '{reason}'" for n, reason in cases.items())
    return f"case {key} % 5 {listed} end as reason"


def _told(found: dox.Checked, key) -> DataFrame:
    """Documents and rejects by the key in their content."""
    good = found.docs.select(dox.field(F.col("body"), "key").alias("doc_id"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(found.rejects.select(key.alias("doc_id"), "reason"))


@register("select cast(o_orderkey as varchar) as doc_id, "
          f"{_spoilt_case('o_orderkey', {1: 'invalid', 2: 'no id', 3: 'invalid'})} from orders")
def valid_docs_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines cut short, without an id or of no JSON at all, told by their reasons."""
    orders = inp.table(spark, folder, "orders").select(F.col("o_orderkey").alias("n"), F.concat(F.lit('"key":"'), "o_orderkey", F.lit('"')).alias("key"))
    case, name = F.col("n") % 5, F.concat(F.lit('"id":"'), "n", F.lit('"'))
    line = (
        F.when(case == 1, F.concat(F.lit("{"), "key", F.lit(","), name))
        .when(case == 2, F.concat(F.lit("{"), "key", F.lit("}")))
        .when(case == 3, F.concat(F.lit("no JSON "), "key"))
        .otherwise(F.concat(F.lit("{"), name, F.lit(","), "key", F.lit("},")))
    )
    path = scratch_folder(spark)
    orders.select(line.alias("value")).write.text(path)
    return _told(dox.check_json_lines(spark, path, "id"), F.regexp_extract("text", '"key":"([^"]*)"', 1))


@register("select cast(o_orderkey as varchar) as doc_id, "
          f"{_spoilt_case('o_orderkey', {1: 'invalid', 2: 'no id'})} from orders")
def valid_docs_xml(spark: SparkSession, folder: str) -> DataFrame:
    """XML records with elements that do not close, without an id, with records of the
    same name inside and with closing tags that are text."""
    orders = inp.table(spark, folder, "orders").select(F.col("o_orderkey").alias("n"), F.concat(F.lit("<key>"), "o_orderkey", F.lit("</key>")).alias("key"))
    case, name = F.col("n") % 5, F.concat(F.lit("<id>"), "n", F.lit("</id>"))
    inner = (
        F.when(case == 1, F.concat(name, "key", F.lit("<open>")))
        .when(case == 2, F.col("key"))
        .when(case == 3, F.concat(name, "key", F.lit("<order note='a > b'><order/></order>")))
        .otherwise(F.concat(name, "key", F.lit("<note><![CDATA[</order> <order>]]></note><!-- <order> -->")))
    )
    path = scratch_folder(spark)
    record = F.concat(F.lit("<order>"), inner, F.lit("</order>"))
    orders.select(record.alias("value")).write.text(path)
    return _told(xml.check_xml_records(spark, path, "order", "id"), F.regexp_extract("text", "<key>([^<]*)<", 1))


@register("select cast(event_id as varchar) as doc_id from events where event_type <> 'error'")
def require_id(spark: SparkSession, folder: str) -> DataFrame:
    events = inp.table(spark, folder, "events")
    key = F.when(F.col("event_type") != "error", F.col("event_id").cast("string"))
    return dox.require_id(events.select(key.alias("doc_id")))


@register(orc.triples_sql(skip_nulls=False))
def skip_nulls(spark: SparkSession, folder: str) -> DataFrame:
    docs = inp.order_docs(spark, folder)
    return st.triple_text(st.triples(docs, st.Shape(skip_nulls=False)))


@register(orc.triples_sql(exclude=("price", "year")))
def exclude_keys(spark: SparkSession, folder: str) -> DataFrame:
    docs = inp.order_docs(spark, folder)
    return st.triple_text(st.triples(docs, st.Shape(exclude_keys=("price", "year"))))


_EVENT_K = "cast(json_extract(props, '$.k') as bigint)"


@register(f"select cast(event_id as varchar) as doc_id, cast(1 as bigint) as statements from events where {_EVENT_K} <> 0")
def nonempty_fp(spark: SparkSession, folder: str) -> DataFrame:
    docs = inp.event_docs(spark, folder)
    return fpr.nonempty_fp(fpr.fingerprint(docs, L)).select("doc_id", "statements")


@register("select l_orderkey, l_linenumber from lineitem where l_discount <> 0 or l_tax <> 0")
def nonzero_fp(spark: SparkSession, folder: str) -> DataFrame:
    lines = inp.table(spark, folder, "lineitem")
    fps = lines.select("l_orderkey", "l_linenumber", F.array("l_discount", "l_tax").alias("fp"))
    return fpr.nonzero_fp(fps).drop("fp")


# --- structure ----------------------------------------------------------------

_NODE_LIST = [
    ("customer", "i", "cast(cust as varchar)"), ("status", "s", "status"), ("price", "o", "null"),
    ("price/total", "f", orc._number("total")), ("price/code", "i", "cast(code as varchar)"),
    ("dates", "a", "null"), ("dates/0", "s", "day_text"), ("dates/1", "o", "null"),
    ("dates/1/year", "i", "cast(y as varchar)"), ("dates/1/month", "i", "cast(m as varchar)"),
    ("dates/1/day", "i", "cast(d as varchar)"), ("priority", "s", "prio"), ("parts", "a", "null"),
    ("parts/0", "s", "p0"), ("parts/1", "s", "p1"), ("empty", "o", "null"),
    ("nothing", "u", "null"), ("zero", "i", "'0'"),
]
_NODE_SQL = f"with {orc._ORDER} " + " union all ".join(
    f"select doc_id, '{path}' as path, {path.count('/') + 1} as depth, '{kind}' as kind, "
    f"cast({value} as varchar) as value from o"
    for path, kind, value in _NODE_LIST
)


@register(_NODE_SQL)
def nodes(spark: SparkSession, folder: str) -> DataFrame:
    found = st.nodes(inp.order_docs(spark, folder))
    return found.select("doc_id", F.array_join("path", "/").alias("path"), "depth", "kind", "value")


_LINE_DOC = "l_orderkey || '-' || l_linenumber as doc_id"


def _line_statements() -> str:
    """All statements of the line items; zeros are none in objects, and items in arrays."""
    number = lambda c: orc._number(f"cast({c} as double)")
    counted = lambda *columns: " + ".join(f"cast({c} <> 0 as int)" for c in columns)
    rows = [
        ("'root'", "'part'", f"nullif(cast({counted('l_partkey', 'l_suppkey')} as varchar), '0')", "true"),
        ("'part'", "'l_partkey'", "cast(l_partkey as varchar)", "l_partkey <> 0"),
        ("'part'", "'l_suppkey'", "cast(l_suppkey as varchar)", "l_suppkey <> 0"),
        ("'root'", "'price'", f"cast(1 + {counted('l_quantity', 'l_extendedprice')} as varchar)", "true"),
        ("'price'", "'l_quantity'", number("l_quantity"), "l_quantity <> 0"),
        ("'price'", "'l_extendedprice'", number("l_extendedprice"), "l_extendedprice <> 0"),
        ("'price'", "'rates'", "'2'", "true"),
        ("'rates'", "'0'", number("l_discount"), "true"),
        ("'rates'", number("l_discount"), number("l_tax"), "true"),
        ("'rates'", number("l_tax"), "'2'", "true"),
        ("'root'", "'flags'", "'2'", "true"),
        ("'flags'", "'0'", "l_returnflag", "true"),
        ("'flags'", "l_returnflag", "l_linestatus", "true"),
        ("'flags'", "l_linestatus", "'2'", "true"),
        ("'root'", "'ship'", "'1'", "true"),
        ("'ship'", "'date'", "strftime(l_shipdate, '%Y-%m-%d')", "true"),
    ]
    return " union all ".join(
        f"select {_LINE_DOC}, {n} as name, {k} as key, {c} as cargo from lineitem where {when}" for n, k, c, when in rows
    )


@register(_line_statements())
def flatten_singletons(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.triple_text(st.triples(inp.lineitem_docs(spark, folder)))
    return rows.select("doc_id", "name", "key", "cargo")


@register(f"with {orc._ORDER} select doc_id, '' as path, 'o' as kind, 6 + cast(cust <> 0 as int) as children from o "
          "union all select doc_id, 'price', 'o', cast(total <> 0 as int) + cast(code <> 0 as int) from o "
          "union all select doc_id, 'dates', 'a', 2 from o union all select doc_id, 'dates/1', 'o', 3 from o "
          "union all select doc_id, 'parts', 'a', 2 from o")
def child_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = st.child_counts(inp.order_docs(spark, folder))
    return found.withColumn("path", F.array_join("path", "/"))


@register(orc.triples_sql("kind = 'object'"))
def object_triples(spark: SparkSession, folder: str) -> DataFrame:
    return st.triple_text(st.triples(inp.order_docs(spark, folder), kind="object"))


@register(orc.triples_sql("kind = 'array'"))
def array_triples(spark: SparkSession, folder: str) -> DataFrame:
    return st.triple_text(st.triples(inp.order_docs(spark, folder), kind="array"))


@register(orc.triples_sql("kind = 'set'", sets=True))
def set_triples(spark: SparkSession, folder: str) -> DataFrame:
    shape = st.Shape(arrays_are_sets=True)
    return st.triple_text(st.triples(inp.order_docs(spark, folder), shape, "set"))


@register(orc.triples_sql())
def triples(spark: SparkSession, folder: str) -> DataFrame:
    return st.triple_text(st.triples(inp.order_docs(spark, folder)))


@register(orc.triples_sql(dialect="v1"))
def triples_v1(spark: SparkSession, folder: str) -> DataFrame:
    return st.triple_text(st.triples(inp.order_docs(spark, folder), V1))


_PRE = [
    ("'root'", "'customer'", "cast(cust as varchar)", "cust <> 0"), ("'root'", "'status'", "status", "true"),
    ("'root'", "'price'", "cast(cast(total <> 0 as int) + cast(code <> 0 as int) as varchar)", "true"),
    ("'price'", "'total'", orc._number("total"), "total <> 0"),
    ("'price'", "'code'", "cast(code as varchar)", "code <> 0"),
    ("'root'", "'dates'", "'2'", "true"), ("'dates'", "'0'", "day_text", "true"),
    ("'dates'", "day_text", "'3'", "true"), ("'dates'", "'3'", "'2'", "true"),
    ("'dates'", "'year'", "cast(y as varchar)", "true"), ("'dates'", "'month'", "cast(m as varchar)", "true"),
    ("'dates'", "'day'", "cast(d as varchar)", "true"), ("'root'", "'priority'", "'1'", "true"),
    ("'root'", "'parts'", "'2'", "true"), ("'parts'", "'0'", "p0", "true"), ("'parts'", "p0", "p1", "true"),
    ("'parts'", "p1", "'2'", "true"),
]


@register(f"with {orc._ORDER} " + " union all ".join(
    f"select doc_id, {n} as name, {k} as key, {c} as cargo from o where {w}" for n, k, c, w in _PRE))
def triples_preorder(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.triple_text(st.triples_preorder(inp.order_docs(spark, folder)))
    return rows.select("doc_id", "name", "key", "cargo")


@register(f"with {orc.order_statements()} select doc_id, count(*) as statements from st group by doc_id")
def statement_count(spark: SparkSession, folder: str) -> DataFrame:
    return st.statement_count(inp.order_docs(spark, folder))


# --- token vectors ------------------------------------------------------------

_STATEMENT_TOKENS = "select base as token from st union select key from st union select cargo from st"


@register(f"with {orc.order_statements()}, tok as ({_STATEMENT_TOKENS}), {orc.vector_ctes(L)} "
          f"select token, i, {orc._ROUND.format('v')} as v from vec")
def token_dim(spark: SparkSession, folder: str) -> DataFrame:
    return cells(fpr.token_dim(inp.order_docs(spark, folder), L), "vec", "token")


@register(ORACLES["token_dim"])
def token_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """The same vectors, kept from one load to the next."""
    name, docs = f"tokens_{uuid.uuid4().hex}", inp.order_docs(spark, folder)
    held = TokenDictionary(spark, name, L, buckets=8, path=scratch_folder(spark))
    held.add(fpr.tokens_of(docs.where("cast(doc_id as long) % 2 = 0")))
    held.add(fpr.tokens_of(docs))
    return cells(held.vectors(), "vec", "token")


_KIND_TOKENS = (
    "select 's' || p_size as token from part union select 's' || p_name from part union "
    "select 's' || p_brand from part union select 's-' || p_retailprice || 'e2' from part "
    "union select 's+.' || p_size from part union select 's' || p_size || '.' from part "
    "union select 's' || p_size || '-' || p_size from part"
)


def _kind_tokens(spark: SparkSession, folder: str) -> DataFrame:
    part, s = inp.table(spark, folder, "part"), F.lit("s")
    price = F.concat(F.lit("s-"), F.col("p_retailprice").cast("string"), F.lit("e2"))
    size = F.col("p_size").cast("string")
    forms = F.array(
        F.concat(s, size), F.concat(s, "p_name"), F.concat(s, "p_brand"), price,
        F.concat(F.lit("s+."), size), F.concat(s, size, F.lit(".")),
        F.concat(s, size, F.lit("-"), size),
    )
    return part.select(F.explode(forms).alias("token")).distinct()


@register(f"select token, regexp_full_match(substr(token, 2), '{orc.V1_NUMBER.strip('^$')}') as is_num, "
          f"case when regexp_full_match(substr(token, 2), '{orc.V1_NUMBER.strip('^$')}') "
          f"then round(try_cast(substr(token, 2) as double), 4) end as num from ({_KIND_TOKENS})")
def token_kind(spark: SparkSession, folder: str) -> DataFrame:
    found, enc = _kind_tokens(spark, folder), Encoding(dialect="v1")
    value = F.round(tokens.number_value(F.col("token"), enc), 4)
    return found.select(
        "token", tokens.is_number(F.col("token"), enc).alias("is_num"), value.alias("num")
    )


# signed amounts and small fractions, each as the token of a JSON number
_NUMBER_TOKENS = (
    f"select 'f' || {orc._number('round(c_acctbal - 5000, 2)')} as token from customer union "
    f"select 'f' || {orc._number('round(l_extendedprice, 2)')} from lineitem union "
    f"select 'f' || {orc._number('l_discount')} from lineitem union select 'i' || c_custkey from customer"
)


def _float_token(x) -> F.Column:
    return F.concat(F.lit("f"), F.regexp_replace(F.round(x, 2).cast("string"), r"\.0$", ""))


def _number_tokens(spark: SparkSession, folder: str) -> DataFrame:
    customer, lines = inp.table(spark, folder, "customer"), inp.table(spark, folder, "lineitem")
    some = [
        lines.select(_float_token(F.col("l_extendedprice")).alias("token")),
        lines.select(_float_token(F.col("l_discount")).alias("token")),
        customer.select(F.concat(F.lit("i"), "c_custkey").alias("token")),
        customer.select(_float_token(F.col("c_acctbal") - 5000).alias("token")),
    ]
    out = some[0]
    for more in some[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _vector_cells(found: DataFrame, **settings) -> DataFrame:
    vec = token_vector(F.col("token"), L, Encoding(**settings))
    return cells(found.withColumn("vec", vec), "vec", "token")


@register(orc.token_sql(_NUMBER_TOKENS))
def vec_num_me(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_cells(_number_tokens(spark, folder))


@register(orc.token_sql(_NUMBER_TOKENS, dialect="v1"))
def vec_num_me_v1(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_cells(_number_tokens(spark, folder), dialect="v1")


@register(orc.token_sql(_NUMBER_TOKENS, numeric="ML"))
def vec_num_ml(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_cells(_number_tokens(spark, folder), numeric="ML")


@register(orc.token_sql(_NUMBER_TOKENS, numeric="ML", dialect="v1"))
def vec_num_ml_v1(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_cells(_number_tokens(spark, folder), numeric="ML", dialect="v1")


@register(orc.token_sql(_NUMBER_TOKENS, numeric="smooth"))
def vec_num_smooth(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_cells(_number_tokens(spark, folder), numeric="smooth")


@register(orc.token_sql(_NUMBER_TOKENS, numeric="smooth", dialect="v1"))
def vec_num_smooth_v1(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_cells(_number_tokens(spark, folder), numeric="smooth", dialect="v1")


@register(orc.token_sql(_NUMBER_TOKENS, numeric="simple"))
def vec_num_simple(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_cells(_number_tokens(spark, folder), numeric="simple")


_TEXT_TOKENS = "select 's' || text as token from conversations"


def _text_tokens(spark: SparkSession, folder: str) -> DataFrame:
    turns = inp.table(spark, folder, "conversations")
    return turns.select(F.concat(F.lit("s"), "text").alias("token")).distinct()


def _hashed(found: DataFrame) -> DataFrame:
    return found.withColumn("token", F.md5("token"))


@register(orc.token_sql(_TEXT_TOKENS, columns="md5(token) as token"))
def vec_str_decay(spark: SparkSession, folder: str) -> DataFrame:
    return _hashed(_vector_cells(_text_tokens(spark, folder)))


@register(orc.token_sql(_TEXT_TOKENS, columns="md5(token) as token", string="pair_sum"))
def vec_str_pair_sum(spark: SparkSession, folder: str) -> DataFrame:
    return _hashed(_vector_cells(_text_tokens(spark, folder), string="pair_sum"))


_LONG_TOKENS = "select 's' || text as token from documents where text is not null"


def _long_tokens(spark: SparkSession, folder: str) -> DataFrame:
    texts = inp.table(spark, folder, "documents").where("text is not null")
    return inp.spread(texts.select(F.concat(F.lit("s"), "text").alias("token"))).distinct()


@register(orc.token_sql(_LONG_TOKENS, columns="md5(token) as token"))
def vec_str_decay_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of up to 20,000 words."""
    return _hashed(_vector_cells(_long_tokens(spark, folder)))


@register(orc.token_sql(_LONG_TOKENS, columns="md5(token) as token", string="pair_sum"))
def vec_str_pair_sum_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _hashed(_vector_cells(_long_tokens(spark, folder), string="pair_sum"))


@register("select l_orderkey, l_linenumber, cast(i as int) as i, round(case when total <> 0 then (v - lo) / total "
          "else v - lo end + 1e-9, 6) + 0.0 as v from (select *, unnest(range(3)) as i, unnest(a) as v, "
          "list_min(a) as lo, list_sum(a) - 3 * list_min(a) as total "
          "from (select *, [l_quantity, l_discount, l_tax] as a from lineitem))")
def stretch_unit(spark: SparkSession, folder: str) -> DataFrame:
    lines = inp.table(spark, folder, "lineitem")
    v = arrays.stretch_unit(F.array("l_quantity", "l_discount", "l_tax"))
    return cells(lines.withColumn("fp", v), "fp", "l_orderkey", "l_linenumber")


_EVENT_STATEMENTS = (
    f"st as (select cast(event_id as varchar) as doc_id, 'object' as kind, 'sroot' as name, 'sk' as key, "
    f"'i' || {_EVENT_K} as cargo, 'i0' as base from events where {_EVENT_K} <> 0)"
)


def _length_sql(length: int) -> str:
    ctes = orc.fingerprint_ctes(_EVENT_STATEMENTS, length)
    return f"(with {ctes} select doc_id, {length} as L, i, {orc._ROUND.format('v')} as v from fp)"


@register(f"{_length_sql(7)} union all {_length_sql(11)}")
def multi_length(spark: SparkSession, folder: str) -> DataFrame:
    fps = fpr.fingerprint(inp.event_docs(spark, folder), "11, 7 7", decimals=None)
    return cells(fps, "fp", "doc_id", "L")


@register(f"select doc_id, cast(i + case L when 11 then 7 else 0 end as int) as i, v from ({_length_sql(7)} union all {_length_sql(11)})")
def multi_length_side_by_side(spark: SparkSession, folder: str) -> DataFrame:
    fps = fpr.fingerprint(inp.event_docs(spark, folder), "11, 7 7", decimals=None, side_by_side=True)
    return cells(fps, "fp", "doc_id")


# --- aggregations -------------------------------------------------------------


def _combined_sql(combine: str, dialect: str) -> str:
    return (
        f"with {orc.order_statements(dialect=dialect)}, {orc._PARTS}, {orc.vector_ctes(L, dialect=dialect)}, "
        f"{orc.combined_ctes(L, combine)} select base, key, cargo, i, {orc._ROUND.format('v')} as v from cmb"
    )


def _combined(spark: SparkSession, folder: str, combine: str, dialect: str) -> DataFrame:
    enc = Encoding(dialect=dialect, combine=combine)
    rows = st.triples(inp.order_docs(spark, folder), st.Shape(dialect=dialect))
    rows = rows.select("kind", "base", "key", "cargo").distinct()
    found = fpr.combine(fpr.triple_vectors(rows, L, enc), enc)
    return cells(found, "vec", "base", "key", "cargo")


@register(_combined_sql("average", "v1"))
def combine_average(spark: SparkSession, folder: str) -> DataFrame:
    return _combined(spark, folder, "average", "v1")


@register(_combined_sql("product", "v2"))
def combine_product(spark: SparkSession, folder: str) -> DataFrame:
    return _combined(spark, folder, "product", "v2")


@register(orc.fingerprint_sql(orc.order_statements()))
def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    fps = fpr.fingerprint(inp.order_docs(spark, folder), L, decimals=None)
    return cells(fps, "fp", "doc_id")


@register(orc.fingerprint_sql(orc.order_statements(dialect="v1"), combine="average", dialect="v1"))
def fingerprint_v1(spark: SparkSession, folder: str) -> DataFrame:
    fps = fpr.fingerprint(inp.order_docs(spark, folder), L, dialect="v1", decimals=None)
    return cells(fps, "fp", "doc_id")


@register(orc.fingerprint_sql(orc.order_statements(sets=True)))
def fingerprint_sets(spark: SparkSession, folder: str) -> DataFrame:
    docs = inp.order_docs(spark, folder)
    return cells(fpr.fingerprint(docs, L, arrays_are_sets=True, decimals=None), "fp", "doc_id")


_TURN_STATEMENTS = """t as (select conv_id || '-' || turn as doc_id, role, text, turn from conversations),
st as (select doc_id, 'object' as kind, 'sroot' as name, 'srole' as key, 's' || role as cargo, 'i0' as base from t
 union all select doc_id, 'object', 'sroot', 'ssaid', 's' || text, 'i0' from t
 union all select doc_id, 'object', 'sroot', 'sturn', 'i' || turn, 'i0' from t where turn <> 0)"""


@register(orc.fingerprint_sql(_TURN_STATEMENTS, 50))
def fingerprint_texts(spark: SparkSession, folder: str) -> DataFrame:
    return cells(fpr.fingerprint(inp.turn_docs(spark, folder), 50, decimals=None), "fp", "doc_id")


@register(orc.zscored_sql(orc.fingerprint_ctes(orc.order_statements())))
def normalize_fp(spark: SparkSession, folder: str) -> DataFrame:
    docs = inp.order_docs(spark, folder)
    return cells(fpr.fingerprint(docs, L, normalize=True, decimals=None), "fp", "doc_id")


_ROW_LIST = [
    ("'sroot'", "'scustomer'", "'i' || cust", "'i0'", "true"), ("'sroot'", "'sstatus'", "'s' || status", "'i0'", "true"),
    ("'sroot'", "'sprice'", "'i' || (1 + cast(total <> 0 as int))", "'i0'", "true"),
    ("'sprice'", "'stotal'", f"'f' || {orc._number('total')}", "'sprice'", "total <> 0"),
    ("'sprice'", "'scode'", "'i' || code", "'sprice'", "true"),
    ("'sroot'", "'sdates'", "'l'", "'i0'", "true"), ("'sroot'", "'spriority'", "'l'", "'i0'", "true"),
    ("'sroot'", "'sparts'", "'l'", "'i0'", "true"), ("'sroot'", "'szero'", "'i0'", "'i0'", "true"),
]
_ROW_STATEMENTS = f"{orc._ORDER}, st as (" + " union all ".join(
    f"select doc_id, 'object' as kind, {n} as name, {k} as key, {c} as cargo, {b} as base from o where {w}"
    for n, k, c, b, w in _ROW_LIST) + ")"


@register(orc.zscored_sql(
    orc.fingerprint_ctes(_ROW_STATEMENTS, dialect="v1", text_numbers=False), "stddev_pop"))
def fingerprint_rows(spark: SparkSession, folder: str) -> DataFrame:
    return cells(fpr.fingerprint_rows(inp.order_docs(spark, folder), L, None), "fp", "doc_id")


@register(f"select round(corr, 2) + 0.0 as corr, pairs from ({_HIST})")
def corr_histogram(spark: SparkSession, folder: str) -> DataFrame:
    found = search.corr_histogram(_entries(spark, folder))
    return found.withColumn("corr", F.round("corr", 2) + F.lit(0.0))


#: Rows of a tile where a query has to fill many of them.
SMALL_TILE = 128
ORDER_CUTOFF = 0.99
MANY_PAIRS = 100_000


def _order_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Rank vectors of the order documents; ranks of rounded cells, which do not hang on
    the order in which they were summed."""
    fps = fpr.fingerprint(inp.order_docs(spark, folder), L, decimals=None)
    rounded = F.transform("fp", lambda x: F.round(x + 1e-9, 6))
    return idx.index_entries(fps.select("doc_id", rounded.alias("fp")))


@register(
    f"with {orc.order_pairs(L)} select (cast(trunc(corr * 100 + 100) as int) - 100) / 100.0 + 0.0 as corr, "
    "cast(sum(pairs) as bigint) as pairs from cp group by 1"
)
def corr_histogram_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Many tiles, some of whose pairs are counted by their sizes."""
    found = search.corr_histogram(_order_entries(spark, folder), tile_rows=SMALL_TILE)
    return found.withColumn("corr", F.round("corr", 2) + F.lit(0.0))


# --- joins --------------------------------------------------------------------


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("corr", F.round("corr", 9))


# 1.0 - 0.9 is less than 0.1: the pairs at the cutoff are told by the rounded correlation
@register(f"with {orc._SELF} select {orc._PAIR_COLUMNS} from cp where round(corr, 9) >= 0.1")
def pairs_self(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(search.class_pairs(_entries(spark, folder), cutoff=0.1))


@register(orc.pair_sql(orc.order_pairs(L), ORDER_CUTOFF))
def pairs_self_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Many tiles, most of whose pairs the cutoff drops."""
    found = search.class_pairs(_order_entries(spark, folder), cutoff=ORDER_CUTOFF, tile_rows=SMALL_TILE)
    return _rounded(found)


def _first_label(spark: SparkSession, folder: str) -> DataFrame:
    return inp.embedding_fps(spark, folder).where(F.col("statements") == 0)


@register(orc.pair_sql(orc._CROSS, CUTOFF))
def pairs_cross(spark: SparkSession, folder: str) -> DataFrame:
    query = idx.index_entries(_first_label(spark, folder))
    return _rounded(search.class_pairs(query, _entries(spark, folder), CUTOFF))


@register(orc.pair_sql(orc.RAW, CUTOFF))
def query_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors that are in no index: those of the table, turned around."""
    target = idx.read_index(spark, _stored_index(spark, folder))
    raw = inp.embedding_fps(spark, folder).where(F.col("statements") % 3 == 0)
    raw = raw.withColumn("doc_id", F.concat(F.lit("-"), "doc_id")).withColumn("fp", F.transform("fp", lambda x: -x))
    return _rounded(search.query_raw(raw, target, CUTOFF))


@register(f"with {orc._RANKS} select a.id as q, b.id as t, round({orc._CORR.format('sum((a.r - b.r) * (a.r - b.r))')}, 9) as corr "
          "from rk a join rk b on cast(b.id as bigint) = cast(a.id as bigint) + 1 and a.i = b.i group by a.id, b.id")
def rank_corr(spark: SparkSession, folder: str) -> DataFrame:
    q = _entries(spark, folder).select(F.col("id").alias("q"), F.col("ranks").alias("a"))
    t = _entries(spark, folder).select(F.col("id").alias("t"), F.col("ranks").alias("b"))
    t = t.withColumn("q", (F.col("t").cast("long") - 1).cast("string"))
    corr = arrays.rank_corr(F.col("a"), F.col("b"))
    return _rounded(q.join(t, "q").select("q", "t", corr.alias("corr")))


@register("select cast(vec_id as varchar) as id from embeddings where label <> 0")
def new_only(spark: SparkSession, folder: str) -> DataFrame:
    held = idx.index_entries(_first_label(spark, folder))
    return idx.new_only(_entries(spark, folder), held).select("id")


@register("select cast(vec_id as varchar) as id, cast(len(embedding) as int) as L from embeddings")
def check_length(spark: SparkSession, folder: str) -> DataFrame:
    return idx.check_length(_entries(spark, folder), 64).select("id", "L")


@register(f"with {orc._SELF} select q, t, round(corr, 9) as corr from cp where corr >= {CUTOFF}")
def pair_names(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs found between positions, by name."""
    index = idx.read_index(spark, _stored_index(spark, folder))
    # ids as positions of equal width, so that they sort like numbers
    placed = index.select(F.lpad(F.col("pos").cast("string"), 18, "0").alias("id"), "ranks")
    found = search.class_pairs(placed, cutoff=CUTOFF)
    by_pos = found.select(
        F.col("q").cast("long").alias("q_pos"), F.col("t").cast("long").alias("t_pos"), "corr"
    )
    named = search.pair_names(by_pos, index)
    return _rounded(named.select(F.least("q", "t").alias("q"), F.greatest("q", "t").alias("t"), "corr"))


_ROLES = " union all ".join(
    f"select t.base, t.key, t.cargo, '{role}' as role, v.i, {orc._ROUND.format('v.v')} as v "
    f"from (select distinct base, key, cargo from parts) t join vec v on v.token = t.{role}"
    for role in ("base", "key", "cargo")
)


@register(f"with {orc.order_statements()}, {orc._PARTS}, {orc.vector_ctes(L)} {_ROLES}")
def triple_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.triples(inp.order_docs(spark, folder))
    rows = rows.select("kind", "base", "key", "cargo").distinct()
    found = fpr.triple_vectors(rows, L)
    roles = F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(f"{r}_vec").alias("vec")) for r in ("base", "key", "cargo")
    ])
    found = found.select("base", "key", "cargo", F.inline(roles))
    return cells(found, "vec", "base", "key", "cargo", "role")


# --- windows ------------------------------------------------------------------


@register("select cast(conv_id as varchar) as doc_id, 'said' as name, "
          "coalesce(lag(said) over w, '0') as key, said as cargo "
          "from (select conv_id, turn, role || ' ' || turn as said from conversations) window w as (partition by conv_id order by turn) "
          "union all select cast(conv_id as varchar), 'said', arg_max(role || ' ' || turn, turn), cast(count(*) as varchar) "
          "from conversations group by conv_id having count(*) > 1")
def array_links(spark: SparkSession, folder: str) -> DataFrame:
    """Who spoke after whom, as links along one array per conversation."""
    turns = inp.table(spark, folder, "conversations")
    said = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(" ", "role", "turn").alias("said"))))
    talks = turns.groupBy("conv_id").agg(F.transform(said, lambda x: x["said"]).alias("said")).where(F.size("said") > 1)
    texts = talks.select("conv_id", F.to_json(F.struct("said", F.lit(1).alias("kept"))).alias("text"))
    rows = st.triple_text(st.triples(dox.documents_from(texts, "conv_id", "text"), kind="array"))
    return rows.select("doc_id", "name", "key", "cargo")


@register(_RANK_SQL)
def rank_fp(spark: SparkSession, folder: str) -> DataFrame:
    ranked = idx.rank_fp(inp.embedding_fps(spark, folder))
    return ranked.select(F.col("doc_id").alias("id"), F.posexplode("ranks").alias("i", "r"))


@register("select cast(vec_id as varchar) as id, label <> 0 as late, case when label = 0 then "
          "row_number() over (partition by label = 0 order by vec_id) - 1 end as pos from embeddings")
def index_pos(spark: SparkSession, folder: str) -> DataFrame:
    """Positions over two loads: the first one in order, the second one behind it."""
    path, fps = scratch_folder(spark), inp.embedding_fps(spark, folder)
    first = _first_label(spark, folder).orderBy(F.col("doc_id").cast("long"))
    idx.append_index(first, path, 64)
    held = idx.stored_index(spark, path).count()
    idx.append_index(fps, path, 64)
    late = F.col("pos") >= held
    return idx.read_index(spark, path).select(
        "id", late.alias("late"), F.when(~late, F.col("pos")).alias("pos")
    )


# --- sorts and limits ---------------------------------------------------------


@register(f"with {orc._SELF} select q, t, round(corr, 9) as corr from cp where corr >= {CUTOFF} and q <> t order by cp.corr desc, q, t")
def sort_pairs(spark: SparkSession, folder: str) -> DataFrame:
    found = search.pairs(_entries(spark, folder), cutoff=CUTOFF)
    return _rounded(search.sort_pairs(found))


@register(orc.pair_sql(orc._SELF, 0.4))
def cutoff_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(search.class_pairs(_entries(spark, folder), cutoff=0.4))


@register(orc.topk_sql(500))
def topk_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(search.topk_pairs(_entries(spark, folder), 500))


@register(orc.topk_sql(MANY_PAIRS))
def topk_pairs_many(spark: SparkSession, folder: str) -> DataFrame:
    """So many best pairs that no part of the selection holds them all."""
    return _rounded(search.topk_pairs(_entries(spark, folder), MANY_PAIRS))


@register("select cast(event_id as varchar) as doc_id from events order by 1")
def sorted_ids(spark: SparkSession, folder: str) -> DataFrame:
    return dox.sorted_ids(inp.event_docs(spark, folder)).select("doc_id")


# --- set operations and analysis ----------------------------------------------


_EVENT_FP_SQL = _length_sql(64).replace("i, round(v + 1e-9, 6) + 0.0 as v from fp", "i, round(v + 1e-9, 3) + 0.0 as v from fp")


@register(f"({_CELLS_3}) union all (select 'event ' || doc_id as doc_id, '1' as statements, i, v from {_EVENT_FP_SQL})")
def concat_collections(spark: SparkSession, folder: str) -> DataFrame:
    """A collection of vectors and one of documents, in files of their own."""
    one = tab.read_fingerprints(spark, _collection(spark, folder), 64)
    fps = fpr.fingerprint(inp.event_docs(spark, folder), 64, decimals=None)
    fps = fps.withColumn("doc_id", F.concat(F.lit("event "), "doc_id")).withColumn("fp", F.transform("fp", lambda x: x + 1e-9))
    path = scratch_folder(spark)
    sinks.write_fingerprints(fps, path, compression="bzip2")
    return _collection_cells(tab.concat_collections(one, tab.read_fingerprints(spark, path, 64)))


@register(orc.pca_sql(orc.fingerprint_ctes(orc.order_statements(), L), L))
def pca_fp(spark: SparkSession, folder: str) -> DataFrame:
    fps = fpr.fingerprint(inp.order_docs(spark, folder), L, decimals=None)
    return cells(analysis.pca_fp(fps), "pc", "doc_id")


# --- streams ------------------------------------------------------------------


@register(orc.fingerprint_sql(orc.supplier_statements(), 11))
def stream_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    out, log = scratch_folder(spark), scratch_folder(spark)
    fps = jobs.stream_json_lines(spark, _write_lines(spark, folder), "id", lengths=11, decimals=None)
    jobs.write_stream(fps, out, log).awaitTermination()
    return cells(spark.read.parquet(out), "fp", "doc_id")


@register(_RANK_SQL)
def stream_index(spark: SparkSession, folder: str) -> DataFrame:
    index, log = scratch_folder(spark), scratch_folder(spark)
    lines = _collection(spark, folder, decimals=9)
    jobs.stream_index(spark, lines, index, 64, log).awaitTermination()
    return idx.stored_index(spark, index).select("id", F.posexplode("ranks").alias("i", "r"))
