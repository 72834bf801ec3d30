"""Sparse vectors against dense ones, lookups that are sent to executors, and keys that fill a table."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurescore.config import VectorizationConfig
from featurescore.operators.lookup import hot_keys, skewed_lookup_join
from featurescore.operators.scoring import Mlp, score
from featurescore.operators.transforms import Embedding, Identity, MinMax32, MinMax64, OneHot, Standardize32, Standardize64
from featurescore.operators.vectorize import dense, long_form, vectorize, vectorize_sparse
from featurescore.types import FEATURES, FIELDS

MANY = tuple(f"c{i:03}" for i in range(200))
KINDS = {
    "embedding": Embedding((9.0, 0.0), {"a": (0.0, 1.5), "b": (2.0, 0.0)}), "large": Embedding((0.0, 7.0), {f"k{i}": (float(i), 0.0) for i in range(300)}), "identity": Identity((0.0, 4.0)), "minmax32": MinMax32((0.0,), -1.0, 3.0), "minmax64": MinMax64((2.0,), 0.0, 4.0),
    "onehot": OneHot((0.0, 0.5, 0.0), ("a", "b", "c")), "many": OneHot((0.0,) * 200, MANY), "odd": OneHot((0.0, 3.0), ("a", "b", "c")), "standard32": Standardize32((1.0,), 1.0, 2.0), "standard64": Standardize64((0.0,), 2.0, 0.5),
}
VALUES = {"double_value": 2.0, "float_value": 1.0, "integer_value": 0, "long_value": 4, "string_value": "b", "double_array": [0.0, 2.0], "float_array": [], "integer_array": [1, 0, 3], "long_array": [4], "string_array": ["a", "zz", "c007", "k3"]}


def same(sparse, whole):
    assert sparse.error == whole.error
    assert (sparse.back is None) == (whole.vector is None)
    if whole.vector is not None:
        assert np.array_equal(np.array(sparse.back) + 0.0, np.array(whole.vector) + 0.0, equal_nan=True)


@pytest.fixture(scope="module")
def cells(spark):
    """A row for each kind of transformation and each alternative, unset and missing values too."""
    rows = []
    for kind, (field, x) in itertools.product(KINDS, [*VALUES.items(), (None, None), ("string_value", "7.5"), ("string_value", "c199"), ("string_value", "k299"), ("string_array", ["a", None]), ("string_array", [])]):
        rows.append((f"{kind}/{field}/{x}", {kind: {**dict.fromkeys(FIELDS), **({field: x} if field else {})}}))
    return spark.createDataFrame(rows, f"id string, features {FEATURES.simpleString()}").repartition(3).persist()


@pytest.mark.parametrize("kind", KINDS)
def test_every_cell_of_the_type_matrix(cells, kind):
    setup = VectorizationConfig({kind: KINDS[kind], "last": Identity((5.0,))}, (kind, "last"))
    rows = cells.where(F.col("id").startswith(f"{kind}/"))
    whole = {r.id: r for r in vectorize(rows, setup, features="features").collect()}
    got = vectorize_sparse(rows, setup, features="features").withColumn("back", dense(F.col("vector"))).collect()
    assert len(got) == len(whole) == 16
    for r in got:
        same(r, whole[r.id])


def test_all_kinds_at_once_wide_columns_and_scores(spark, table):
    names = ("onehot", "many", "minmax64", "embedding", "identity")
    setup = VectorizationConfig({n: KINDS[n] for n in names}, names)
    df = table([(1, "a", "c007", 2.0, "b", [1.0, 0.0]), (2, "zz", "no", 0.0, "zz", [3.0, 4.0]), (3, None, None, None, None, None), (4, "c", "c199", 4.0, "a", [1.0])], "id int, onehot string, many string, minmax64 double, embedding string, identity array<double>")
    whole = {r.id: r for r in vectorize(df, setup, 208).collect()}
    sparse = vectorize_sparse(df, setup, 208)
    for r in sparse.withColumn("back", dense(F.col("vector"))).collect():
        same(r, whole[r.id])
    one = sparse.where("id = 1").first().vector
    assert one.size == 208 and sum(3 <= p < 203 for p in one.positions) == 1
    entries = {(r.id, r.pos): r.value for r in long_form(sparse, ["id"]).collect()}
    assert entries == {(i, p): v for i, r in whole.items() if r.vector for p, v in enumerate(r.vector) if v}
    net = Mlp([(np.arange(2 * 208).reshape(2, 208) / 100, np.zeros(2))], [])
    scores = {r.id: r.scores for r in score(vectorize(df, setup, 208), net).collect()}
    assert {r.id: r.scores for r in score(sparse, net).collect()} == scores and scores[4] is None


def test_arrays_of_many_keys_on_a_stream(spark, table, tmp_path):
    t = Embedding((0.5,), {f"k{i}": (float(i),) * (1 + i % 2) for i in range(500)})
    setup = VectorizationConfig({"a": t}, ("a",))
    rows = [(1, ["k7", "x", "k498"]), (2, []), (3, None), (4, ["k1", None])]
    table(rows, "id int, a array<string>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, a array<string>").parquet(str(tmp_path / "in"))
    out = vectorize(stream, setup)
    assert "Join" not in out._jdf.queryExecution().analyzed().toString()
    out.select("id", "vector", "error").writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r.id: (r.vector, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ([7.0, 7.0, 0.5, 498.0], None), 2: ([], None), 3: ([0.5], None), 4: (None, "Null element in array")}


def test_hot_keys_do_not_fill_a_task(spark, tmp_path):
    n = 60_000
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 5000))
    spark.range(n).select("id", key.alias("k")).write.parquet(str(tmp_path / "rows"))
    spark.range(0, 5000, 2).select(F.concat(F.lit("k"), "id").alias("key"), F.array(F.col("id").cast("float")).alias("vec")).union(spark.range(1).select(F.lit("hot"), F.array(F.lit(-1.0).cast("float")))).write.parquet(str(tmp_path / "table"))
    rows, dictionary = spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "table"))
    assert [r.key for r in hot_keys(rows, F.col("k")).collect()] == ["hot"]
    out = skewed_lookup_join(rows, F.col("k"), dictionary, F.array(F.lit(0.5).cast("float")), "v")
    got = {r.id: r.v[0] for r in out.collect()}
    assert len(got) == n and out.columns == ["id", "k", "v"]
    for i, v in got.items():
        k = i % 5000
        assert v == (-1.0 if i % 3 == 0 else 0.5 if i % 3 == 1 or k % 2 else float(k))
    # rows that a join shuffles have neither the hot key nor none
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skewed_lookup_join(rows, F.col("k"), dictionary, F.array(F.lit(0.5).cast("float")), "v")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") >= 4
