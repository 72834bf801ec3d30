"""Every transformation on every alternative of a feature value, in wide and in map form, and the edges of each."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurescore.config import ConfigError, JobConfig, VectorizationConfig
from featurescore.operators.transforms import ACCEPTED, Embedding, Identity, MinMax32, MinMax64, OneHot, Standardize32, Standardize64, Transformation, register_transformation
from featurescore.operators.vectorize import vectorize
from featurescore.sources.tables import to_map
from featurescore.types import FIELDS

SAMPLE = {"double_value": 5.5, "float_value": 2.5, "integer_value": 7, "long_value": 9, "string_value": "4.5", "double_array": [0.1, 5.0], "float_array": [2.5, -1.0], "integer_array": [3, 12], "long_array": [1, 2], "string_array": ["1.5", "cat"]}
EACH = [Embedding((9.0, 9.0), {"cat": (1.0, 2.0), "4.5": (3.0, 4.0)}), Identity((0.0,)), MinMax32((0.0,), 0.0, 10.0), MinMax64((0.0,), 0.0, 10.0), OneHot((0.0, 0.0), ("4.5", "cat")), Standardize32((0.0,), 5.0, 2.0), Standardize64((0.0,), 5.0, 2.0)]


def expected(t, field, x):
    if field not in ACCEPTED[t.kind]:
        return f"Invalid data type for {t.label}"
    xs = x if isinstance(x, list) else [x]
    if t.kind in ("embedding", "one_hot_encoding"):
        return [v for e in xs for v in t.table().get(e, t.default_val)]
    if t.kind == "identity":
        return "Error in parsing StringArray: cat" if "cat" in xs else [np.float32(e) for e in xs]
    shift, scale = (t.min, t.max - t.min) if "min_max" in t.kind else (t.mean, t.std_dev)
    if t.kind.endswith("32"):
        return [(np.float32(e) - np.float32(shift)) / np.float32(scale) for e in xs]
    return [np.float32((float(e) - shift) / scale) for e in xs]


def one(spark, config, df, **kw):
    r = vectorize(df, config, **kw).first()
    return r.error if r.error is not None else r.vector


def test_matrix(spark):
    row = spark.createDataFrame([tuple(SAMPLE[f] for f in FIELDS)], T.StructType([T.StructField(n, t) for n, t in FIELDS.items()]))
    for t in EACH:
        wide = row.select(*[F.col(f) for f in FIELDS])
        mapped = to_map(wide, list(FIELDS))
        made = []
        for f in FIELDS:
            c = VectorizationConfig({f: t}, (f,))
            made += [vectorize(wide, c).select(F.lit(f).alias("f"), "vector", "error"), vectorize(mapped, c, features="features").select(F.lit(f), "vector", "error")]
        out = made[0]
        for m in made[1:]:
            out = out.union(m)
        for r in out.collect():
            got = r.error if r.error is not None else r.vector
            assert got == expected(t, r.f, SAMPLE[r.f]) if isinstance(got, str) else [np.float32(v) for v in got] == [np.float32(v) for v in expected(t, r.f, SAMPLE[r.f])], (t, r)


def test_text_as_numbers(spark):
    cases = {"42.5": 42.5, "+3": 3.0, "1.": 1.0, ".5": 0.5, "1e5": 1e5, "inf": math.inf, "-Infinity": -math.inf, "1e300": math.inf, "16777217": 16777216.0, "NaN": math.nan, "+nan": math.nan, " 1 ": None, "1.0f": None, "1d": None, "": None, ".": None, "0x10": None, "1_0": None, "1\n": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    for r in vectorize(df, VectorizationConfig({"s": Identity((0.0,))}, ("s",))).collect():
        want = cases[r.s]
        assert r.error == ("Error in parsing StringValue" if want is None else None)
        assert want is None or r.vector[0] == want or math.isnan(r.vector[0]) and math.isnan(want)


def test_defaults_order_and_lengths(spark):
    df = spark.createDataFrame([(1.0, None, [], 5), (2.0, "cat", ["a", "cat"], 6)], "x double, s string, a array<string>, unused int")
    c = VectorizationConfig({"a": Embedding((7.0,), {"cat": (1.0,)}), "s": OneHot((0.5, 0.5, 0.5), ("cat", "dog")), "x": Standardize64((0.0,), 0.0, 2.0), "gone": Identity((3.0, 4.0))}, ("x", "s", "a", "gone", "x"))
    rows = vectorize(df, c).collect()
    assert [r.vector for r in rows] == [[0.5, 0.5, 0.5, 0.5, 3.0, 4.0, 0.5], [1.0, 1.0, 0.0, 7.0, 1.0, 3.0, 4.0, 1.0]]
    assert [r.error for r in vectorize(df, c, 7).collect()] == [None, "Expected feature vector length 7 but got 8"]
    assert vectorize(df, VectorizationConfig(), 0).first().vector == []
    holes = spark.createDataFrame([(["a", None],)], "a array<string>")
    assert one(spark, VectorizationConfig({"a": Embedding((7.0,), {"cat": (1.0,)})}, ("a",)), holes) == "Null element in array"
    bad = spark.createDataFrame([("x", "y")], "p string, q string")
    assert one(spark, VectorizationConfig({"q": Standardize32((0.0,), 0.0, 1.0), "p": Identity((0.0,))}, ("q", "p")), bad) == "Invalid data type for Standardization32"
    with pytest.raises(Exception, match="Error in parsing"):
        vectorize(bad, VectorizationConfig({"p": Identity((0.0,))}, ("p",)), mode="failfast").collect()
    with pytest.raises(TypeError):
        vectorize(spark.createDataFrame([(True,)], "b boolean"), VectorizationConfig({"b": Identity((0.0,))}, ("b",)))


def test_large_table_is_joined(spark):
    t = OneHot((0.0,) * 200, tuple(f"c{i:03d}" for i in range(200)))
    df = vectorize(spark.createDataFrame([("c007",), ("zzz",), (None,)], "s string"), VectorizationConfig({"s": t}, ("s",)))
    assert "Join" in df._jdf.queryExecution().toString()
    assert [(r.vector.index(1.0) if 1.0 in r.vector else None, len(r.vector)) for r in df.collect()] == [(7, 200), (None, 200), (None, 200)]


SPECS = {
    "e": {"type": "embedding", "embeddings": {"a": [1, 2.5]}, "default_val": [0, 0]}, "i": {"type": "identity", "default_val": [0]},
    "m3": {"type": "min_max_scaling32", "min": 0, "max": 1, "default_val": [0]}, "m6": {"type": "min_max_scaling64", "min": 0, "max": 1, "default_val": [0]},
    "o": {"type": "one_hot_encoding", "categories": ["a", "b"], "default_val": [0, 0]}, "s3": {"type": "standardization32", "mean": 0, "std_dev": 1, "default_val": [0]}, "s6": {"type": "standardization64", "mean": 0, "std_dev": 1, "default_val": [0], "note": "extra"},
}


def text(features, order=None):
    return json.dumps({"feature_transformations": features, "feature_order": list(features) if order is None else order})


def test_config(spark, tmp_path):
    whole = VectorizationConfig.from_json(text(SPECS), strict=True)
    assert len(whole.transformations) == 7 and whole.warnings() == []
    (tmp_path / "c.json").write_text(text(SPECS))
    assert VectorizationConfig.from_path(spark, str(tmp_path / "c.json")) == whole
    assert VectorizationConfig.from_json(text({})).order == ()
    for bad in ("{,}", "[]", "{}", text({"x": {"type": "nope", "default_val": [0]}}), text({"x": {"type": "min_max_scaling32", "min": 0, "default_val": [0]}})):
        with pytest.raises(ConfigError):
            VectorizationConfig.from_json(bad)
    broken = [("m3", {"min": 1}), ("m6", {"min": 2}), ("m3", {"min": 0.99999999999}), ("s3", {"std_dev": 0}), ("s6", {"std_dev": -1}), ("e", {"embeddings": {}}), ("o", {"categories": []}), ("o", {"categories": ["a", "a"]}), *[(n, {"default_val": []}) for n in SPECS]]
    for name, change in broken:
        with pytest.raises(ConfigError, match=f"for {name}"):
            VectorizationConfig.from_json(text({name: SPECS[name] | change}))
    with pytest.raises(ConfigError) as e:
        VectorizationConfig.from_json(text({"i": SPECS["i"], "o": SPECS["o"]}, ["i", "z"]))
    assert e.value.problems == ["Feature z in feature_order has no transformation", "Feature o has a transformation but is not in feature_order"]
    loose = text({"o": SPECS["o"] | {"categories": ["b", "a"], "default_val": [0]}}, ["o", "o"])
    assert len(VectorizationConfig.from_json(loose).warnings()) == 3
    with pytest.raises(ConfigError):
        VectorizationConfig.from_json(loose, strict=True)


def test_job_config():
    raw = {"model_path": "m", "model_id": "i", "vectorization_instruction_path": "v"}
    assert (JobConfig.from_json(json.dumps(raw)).port_number, JobConfig.from_json(json.dumps(raw)).connection_concurrency) == (8279, 50)
    assert JobConfig.from_json(json.dumps(raw | {"port_number": 1, "other": 2})).port_number == 1
    for bad in ({"model_path": "m"}, raw | {"model_id": 3}, raw | {"port_number": "x"}):
        with pytest.raises(ConfigError):
            JobConfig.from_json(json.dumps(bad))


def test_users_transformation(spark):
    class Twice(Transformation):
        kind, label = "twice", "Twice"

        def element(self, x):
            return x.cast("float") * 2

    register_transformation("twice", Twice)
    c = VectorizationConfig.from_json(text({"x": {"type": "twice", "default_val": [0]}}))
    assert one(spark, c, spark.createDataFrame([(1.5,)], "x double")) == [3.0]
