"""Physical plans: no shuffle on the way to a fingerprint, nothing computed twice."""

from pyspark.sql import functions as F

from semisketch.functions.vectors import Encoding, token_vector
from semisketch.operators.dictionary import TokenDictionary
from semisketch.operators.fingerprint import fingerprint
from semisketch.operators.search import Tree
from semisketch.operators.structure import triples
from semisketch.plans import catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprint_is_one_stage(docs):
    plan = plan_of(fingerprint(docs({"a": '{"x":1}'}), "11,13"))
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 1
    # the walk appears in its generator only, not in the filter above it
    (line,) = [s for s in plan.splitlines() if "Filter (size(parts" in s]
    assert "aggregate(" not in line


def test_triples_do_not_shuffle(docs):
    assert "Exchange" not in plan_of(triples(docs({"a": '{"x":1}'})).where(F.col("kind") == "object"))


def test_crowded_cells_are_split(spark):
    """Where a pivot does not make a node smaller, it is cut by hash."""
    rows = [(list(p), f"{i}", 1) for i, p in enumerate(_permutations(300))]
    found = spark.createDataFrame(rows, "ranks array<int>, rep string, members long")
    tree = Tree(found, 300, 50, fan=1)
    sizes = [r["count"] for r in tree.rows.groupBy("tile").count().collect()]
    assert sum(sizes) == 300 and len(sizes) == tree.tiles == 6 and max(sizes) < 100


def test_dictionary_stays_where_it_is(spark, tmp_path):
    """A second load computes new tokens only, and only the other side is moved."""
    held = TokenDictionary(spark, "tokens_of_test", 7, buckets=4, path=str(tmp_path / "d"))
    tokens = lambda *names: spark.createDataFrame([(n,) for n in names], "token string")
    assert held.vectors().collect() == []
    assert held.add(tokens("sa", "sb", "sb", None)) == 2
    assert held.add(tokens("sb", "sc", "i3")) == 2 and held.add(tokens("sc")) == 0
    want = {r.token: r.vec for r in tokens("sa", "sb", "sc", "i3").withColumn("vec", token_vector(F.col("token"), 7, Encoding())).collect()}
    assert {r.token: r.vec for r in held.vectors().collect()} == want and held.vectors().count() == 4
    joined = held.of(tokens("sa", "sa", "i3", "sx"))
    assert sorted(r.token for r in joined.collect()) == ["i3", "sa", "sa"]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in initial


def _permutations(n):
    import itertools

    return itertools.islice(itertools.permutations(range(7)), n)


def test_documents_that_become_files_are_spread_over_the_cores(spark, tmp_path):
    rows = [(i, f"Supplier#{i}", i % 3, float(i)) for i in range(40)]
    kind = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    docs = catalog._supplier_docs(spark, str(tmp_path))
    used = [r.n for r in docs.select(F.spark_partition_id().alias("n")).distinct().collect()]
    assert docs.count() == 40 and len(used) == spark.sparkContext.defaultParallelism
