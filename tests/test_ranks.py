import math
import random

from pyspark.sql import functions as F

from featurescore.operators.latency import latency_summary
from featurescore.operators.ranks import index_percentiles, number_rows
from featurescore.operators.requests import chunk_numbers


def brute(rows, share):
    v = sorted(rows, key=lambda x: (x != x, x))
    return v[math.floor(len(v) * share)]


def test_percentiles_of_skewed_keys(spark, table):
    random.seed(2)
    rows = [("hot", random.random()) for _ in range(4000)] + [("same", 3.5)] * 3000 + [(None, float(i)) for i in range(7)] + [("one", -2.0), ("none", None), ("nan", float("nan")), ("nan", 1.0)]
    got = {r.k: r for r in latency_summary(table(rows, "k string, v double"), ["k"], "v").collect()}
    for k in {r[0] for r in rows} - {"none"}:
        v = [x for q, x in rows if q == k and x is not None]
        assert got[k].n == len(v) and repr(got[k].p50) == repr(brute(v, 0.5)) and repr(got[k].p99) == repr(brute(v, 0.99))
        assert k == "nan" or abs(got[k].avg - sum(v) / len(v)) < 1e-9
    assert "none" not in got


def test_percentiles_without_keys_and_of_nothing(spark, table):
    df = table([(i, i % 5) for i in range(1001)], "v long, __value int")
    assert tuple(index_percentiles(df, [], "v", {"low": 0.0, "third": 1 / 3, "top": 0.999}).first()) == (1001, 500.0, 0, 333, 999)
    assert index_percentiles(df.where("v < 0"), ["__value"], "v", {"p": 0.5}).count() == 0


def test_one_key_of_many_different_values_is_spread(spark, tmp_path):
    # two million different values of one key: no task sorts more than a small share of them
    path = str(tmp_path / "t")
    spark.range(0, 2_000_000, 1, 8).select(F.lit("a").alias("k"), (F.xxhash64("id") / 1e6).alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    out = index_percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99})
    r = out.first()
    v = [x.v for x in df.orderBy("v").select("v").collect()]
    assert (r.n, r.p50, r.p99) == (len(v), v[len(v) // 2], v[math.floor(len(v) * 0.99)])
    plan = out._jdf.queryExecution().executedPlan()
    seen, sorted_rows = [plan], []
    while seen:
        node = seen.pop()
        name = node.getClass().getSimpleName()
        if name == "WindowExec":
            sorted_rows.append(node)
        children = node.children()
        seen += [children.apply(i) for i in range(children.size())]
        if name in ("AdaptiveSparkPlanExec",):
            seen.append(node.executedPlan())
        if name.endswith("QueryStageExec"):
            seen.append(node.plan())
    # the innermost bucket holds about a thousandth of the values; an exchange before a window carries those only
    rows = [m for w in sorted_rows for m in _exchange_rows(w)]
    assert rows and max(rows) < 2_000_000 / 50


def _exchange_rows(node):
    """Rows written by the exchanges below a node."""
    found, seen = [], [node]
    while seen:
        x = seen.pop()
        name = x.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found.append(int(x.metrics().apply("shuffleRecordsWritten").value()))
            continue
        children = x.children()
        seen += [children.apply(i) for i in range(children.size())]
        if name.endswith("QueryStageExec"):
            seen.append(x.plan())
    return found


def test_numbers_of_rows(spark, table):
    rows = [("hot", i * 7 % 5000, str(i)) for i in range(5000)] + [(None, i, "x") for i in range(10)] + [("a", None, "y"), ("a", None, "y"), ("a", 1, "z")]
    df = table(rows, "k string, o int, __at string")
    got = number_rows(df, ["k"], ["o"], "n", "total").collect()
    assert len(got) == len(rows) and {r["__at"] for r in got} == {r[2] for r in rows}
    for k, total in (("hot", 5000), (None, 10), ("a", 3)):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(total)) and {r.total for r in mine} == {total}
        assert [r.o for r in mine] == sorted((r.o for r in mine), key=lambda x: (x is not None, x or 0))


def test_numbers_stay_when_the_parallelism_changes(spark, table):
    df = number_rows(table([(i % 3, i % 50) for i in range(3000)], "k int, o int"), ["k"], ["o"])
    before = sorted(map(tuple, df.collect()))
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "13")
    try:
        assert sorted(map(tuple, df.collect())) == before
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_chunks_without_keys(spark, table):
    df = chunk_numbers(table([(i,) for i in range(25)], "v int"), [], ["v"], 10)
    assert sorted((r.v, r.chunk) for r in df.collect()) == [(i, i // 10) for i in range(25)]
    plan = df._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert chunk_numbers(df.drop("chunk").where("v < 0"), [], ["v"], 10).count() == 0


def test_chunks_are_files_without_folders(spark, table, tmp_path):
    from featurescore.sources.logs import write_chunks

    df = chunk_numbers(table([(k, i) for k in "ab" for i in range(25)], "k string, v int"), ["k"], ["v"], 10)
    path = tmp_path / "chunks"
    write_chunks(df, str(path), ["k"], 10)
    files = spark.read.parquet(str(path)).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.count_distinct("k", "chunk").alias("c")).collect()
    assert sorted(r.n for r in files) == [5, 5, 10, 10, 10, 10] and all(r.c == 1 for r in files)
    assert sorted(p.name for p in path.iterdir() if p.is_dir()) == ["k=a", "k=b"]
