"""Scores of good and bad rows, the size of plans, and joins with large tables."""

import math

import numpy as np
import pytest
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import functions as F

from featurescore.config import VectorizationConfig, validate_configs
from featurescore.operators.requests import assemble_responses, reject_requests, response_parts
from featurescore.operators.scoring import Mlp, OnnxScorer, Shared, score
from featurescore.operators.transforms import Embedding, Identity
from featurescore.operators.vectorize import vectorize
from featurescore.plans.catalogue import QUERIES
from featurescore.plans.models import FULL_LAYERS, SMALL_LAYERS, UNIT, benchmark_config, sigmoid_model, units
from featurescore.sources.logs import log_batch_parts
from featurescore.sources.tables import to_map

SF = "/root/testdata/sf0.001"


def test_bad_rows_do_not_disturb_good_ones(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], None), (2, None, "bad"), (3, [1.0], None), (4, [], None), (5, [-1.0, 0.5], None)], "id int, vector array<float>, error string")
    out = {r.id: r for r in score(rows.coalesce(1), OnnxScorer(sigmoid_model(2)), timings=True).collect()}
    for i, total in ((1, 3.0), (5, -0.5)):
        assert np.allclose(out[i].scores, [1 / (1 + math.exp(-(0.5 * total + 0.1)))] * 2, atol=1e-6) and out[i].error is None
    assert out[2].scores is out[3].scores is out[4].scores is None and out[2].error == "bad"
    assert [out[i].error for i in (3, 4)] == ["Expected feature vector length 2 but got 1", "Expected feature vector length 2 but got 0"]
    assert all(r.infer_micros >= 0 and r.tensor_micros >= 0 for r in out.values())
    none = score(rows.where("id in (2, 3)").drop("error"), OnnxScorer(sigmoid_model(2))).collect()
    assert [r.scores for r in none] == [None, None]
    assert score(rows.limit(0), OnnxScorer(sigmoid_model(2))).count() == 0


def test_models_are_read_from_storage(spark, tmp_path):
    (tmp_path / "m.onnx").write_bytes(sigmoid_model(3))
    assert OnnxScorer.from_path(spark, str(tmp_path / "m.onnx")).input_width == 3
    spark.createDataFrame(units(7, SMALL_LAYERS), UNIT).repartition(3).write.parquet(str(tmp_path / "units"))
    net = Mlp.from_table(spark.read.parquet(str(tmp_path / "units")))
    assert [w.shape for w, _ in net.layers] == [(16, 7), (8, 16), (5, 8)] and len(net.norms) == 2 and net.score(np.ones((3, 7))).shape == (3, 5)
    with pytest.raises(ValueError):
        OnnxScorer(sigmoid_model(3, free=True))
    setup = benchmark_config()
    assert len(setup.order) == 22 and sum(len(t.default_val) for t in setup.transformations.values()) == 1002 and setup.warnings() == []
    assert FULL_LAYERS[-1] == 5 and len(FULL_LAYERS) == 10


@pytest.mark.parametrize("name", ["vectorize_full", "vectorize_map"])
def test_inputs_are_not_copied(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 3 and len(plan) < 40_000


def test_large_tables_are_joined_in_maps_and_arrays(spark, table):
    t = Embedding((0.0, 0.0), {f"k{i}": (float(i), float(-i)) for i in range(2000)})
    setup = VectorizationConfig({"a": t, "s": t}, ("a", "s", "a"))
    df = table([(1, ["k7", "x", "k1999"], "k3"), (2, [], None), (3, None, "zz"), (4, ["k1", None], "k2")], "id int, a array<string>, s string")
    for rows, kw in ((df, {}), (to_map(df, ["a", "s"]).select("id", "features"), {"features": "features"})):
        out = vectorize(rows, setup, **kw)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan and "k1234" not in plan.split("LocalRelation")[0]
        got = {r.id: r for r in out.collect()}
        assert got[1].vector == [7, -7, 0, 0, 1999, -1999, 3, -3, 7, -7, 0, 0, 1999, -1999]
        assert got[2].vector == [0, 0] and got[3].vector == [0, 0, 0, 0, 0, 0] and got[4].error == "Null element in array" and got[4].vector is None


def test_requests_fail_as_a_whole(spark):
    rows = spark.createDataFrame([("a", 0, "r", [1.0], None), ("a", 1, "s", None, "e1"), ("a", 2, "t", None, "e2"), ("b", 1, "y", [2.0], None), ("b", 0, "x", [1.0], None), ("c", None, None, None, None)], "request_id string, pos int, row_id string, scores array<float>, error string")
    out = {r.request_id: r for r in assemble_responses(rows).collect()}
    assert out["a"].outputs is None and out["a"].error == "e1" and out["c"].outputs == [] and [o.row_id for o in out["b"].outputs] == ["x", "y"]
    accepted, rejected = reject_requests(rows)
    assert {r.request_id for r in accepted.collect()} == {"b", "c"} and [tuple(r) for r in rejected.collect()] == [("a", "e1")]
    accepted, rejected = reject_requests(rows, "row")
    assert accepted.count() == 4 and rejected.count() == 2


def test_configurations_in_a_table(spark):
    texts = [(1, None), (2, "{"), (3, '{"feature_transformations": {"x": {"type": "identity", "default_val": [0]}}, "feature_order": ["x", "x"]}'), (4, '{"feature_transformations": {"x": {"type": "what"}}, "feature_order": []}')]
    out = validate_configs(spark.createDataFrame(texts, "config_id int, config string")).collect()
    assert [(r.config_id, r.kind) for r in sorted(out)] == [(1, "problem"), (2, "problem"), (3, "warning"), (4, "problem")]


def test_a_users_column_named_like_a_result_is_replaced(spark):
    df = spark.createDataFrame([(1.5, "v", "e")], "x double, vector string, error string")
    r = vectorize(df, VectorizationConfig({"x": Identity((0.0,))}, ("x",)), 1).first()
    assert r.vector == [1.5] and r.error is None
    assert vectorize(df, VectorizationConfig({"x": Identity((0.0,))}, ("x",)), 2).select(F.col("error")).first().error == "Expected feature vector length 2 but got 1"


def test_a_worker_process_opens_a_model_once(spark, tmp_path):
    import os

    (tmp_path / "one.onnx").write_bytes(sigmoid_model(4))
    scorer = OnnxScorer.from_path(spark, str(tmp_path / "one.onnx"))
    rows = spark.range(0, 4000, 1, 40).select(F.array(*[F.lit(1.0).cast("float")] * 4).alias("vector"))
    assert len(CloudPickleSerializer().dumps(scorer)) < 10_000

    class Watching:
        input_width = 4

        def score(self, batch):
            before = Shared.opens
            scorer.score(batch)
            return np.tile([[os.getpid(), Shared.opens, Shared.opens - before]], (len(batch), 1))

    seen = [tuple(r.scores) for r in score(rows, Watching()).select("scores").collect()]
    assert len(seen) == 4000
    processes = {p for p, _, _ in seen}
    # forty tasks, but no process opens the session again
    for p in processes:
        assert len({n for q, n, _ in seen if q == p}) == 1


def test_networks_travel_as_files(spark, table):
    net = Mlp.from_table(table(units(64, [32, 8, 3]), UNIT), "float64")
    whole = Mlp([(w.copy(), b.copy()) for w, b in net.layers], net.norms)
    x = np.random.default_rng(1).normal(size=(50, 64))
    assert np.allclose(net.score(x), whole.score(x)) and len(CloudPickleSerializer().dumps(net)) < 10_000
    want = {(k, o): w for k, o, w, *_ in units(64, [32, 8, 3])}
    assert all(np.allclose(net.layers[k][0][o], w) for (k, o), w in want.items())


def test_a_layer_of_8192_units(spark, tmp_path):
    # made in Spark, 268 MB of 32-bit weights; mapped, so a task holds a tile of units beside its batch
    n = 8192
    weights = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: (((F.col("out") * 7 + p * 3) % 11 - 5) / 1024).cast("float"))
    made = spark.range(0, n, 1, 8).select(F.lit(0).alias("layer"), F.col("id").cast("int").alias("out")).withColumn("weights", weights)
    made.select("*", F.lit(0.5).cast("float").alias("bias"), F.lit(None).cast("float").alias("scale"), F.lit(None).cast("float").alias("shift")).write.parquet(str(tmp_path / "wide"))
    net = Mlp.from_table(spark.read.parquet(str(tmp_path / "wide")))
    assert net.input_width == n and len(CloudPickleSerializer().dumps(net)) < 10_000
    x = [[float((r + p) % 3) for p in range(n)] for r in range(3)]
    out = score(spark.createDataFrame([(r, v) for r, v in enumerate(x)], "id int, vector array<float>"), net).collect()
    for r in out:
        for o in (0, 1, 4095, 8191):
            want = 0.5 + sum(((o * 7 + p * 3) % 11 - 5) / 1024 * v for p, v in enumerate(x[r.id]))
            assert abs(r.scores[o] - want) < 1e-2


def test_requests_are_scored_in_one_pass(spark):
    from featurescore.streaming.jobs import score_requests
    from featurescore.types import FIELDS, REQUEST

    one = {"x": {**dict.fromkeys(FIELDS), "float_value": 2.0}}
    requests = spark.createDataFrame([("a", [("r", one), ("s", one)])], REQUEST)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "no job for a plan")
    out = score_requests(requests, VectorizationConfig({"x": Identity((0.0,))}, ("x",)), OnnxScorer(sigmoid_model(1)))
    assert not jobs.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") <= 2 and plan.count("Generate") == 1
    assert all(r.vec_micros >= 0 and r.infer_micros >= 0 and len(r.scores) == 2 for r in out.collect())


def test_requests_in_parts_keep_their_order(spark):
    rows = [("long", i, f"r{i}", [float(i)], None) for i in range(25)] + [("bad", 0, "x", [1.0], None), ("bad", 1, "y", None, "e1"), ("bad", 2, "z", None, "e2"), ("none", None, None, None, None)]
    parts, manifest = response_parts(spark.createDataFrame(rows, "request_id string, pos int, row_id string, scores array<float>, error string").repartition(5), 10)
    got = {(r.request_id, r.part): [o.row_id for o in r.outputs] for r in parts.collect()}
    assert got == {("long", k): [f"r{i}" for i in range(10 * k, min(25, 10 * k + 10))] for k in range(3)}
    assert {tuple(r) for r in manifest.collect()} == {("long", 3, 25, None), ("bad", 0, 0, "e1"), ("none", 0, 0, None)}
    logs = spark.createDataFrame([("q", "m", f"r{i:02}", None, None) for i in range(12)], "request_id string, model_id string, row_id string, features map<string,int>, scores array<float>")
    assert {r.part: [x.row_id for x in r.inference_log_rows] for r in log_batch_parts(logs.repartition(3), ["row_id"], 5).collect()} == {k: [f"r{i:02}" for i in range(5 * k, min(12, 5 * k + 5))] for k in range(3)}


def test_requests_are_rejected_without_a_sort(spark):
    rows = spark.createDataFrame([("a", 0, None), ("a", 1, "e1"), ("a", 2, "e2"), ("b", 0, None), (None, 1, "n"), (None, 0, None)], "request_id string, pos int, error string")
    accepted, rejected = reject_requests(rows)
    assert {tuple(r) for r in accepted.collect()} == {("b", 0, None)} and {tuple(r) for r in rejected.collect()} == {("a", "e1"), (None, "n")}
    plan = accepted._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
